"""The pipeline's near copies against brute force over sets of word shingles."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cairn.llm import textbytes as tb
from cairn import runtime
from cairn.llm import simhash
from tests.llm.test_operators import frame

SMALL = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def keepers(rows):
    """Smallest id of each component of rows (id, text) linked at a Jaccard of 0.8 or by equal sets."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for (doc_id, _), i in zip(rows, range(len(rows))):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def texts(seed=5):
    """Unlike texts, copies with one to twelve words replaced, a chain of copies and a dense group."""
    rng = random.Random(seed)
    out = []
    for n in range(1, 13):
        base = [f"w{rng.randrange(5000)}" for _ in range(250)]
        out += [base, edited(base, n, rng), edited(base, n, rng)]
    for _ in range(30):
        out.append(edited(out[-1], 3, rng))
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    out += [edited(base, 2 + k % 3, rng) for k in range(60)]
    out += [[], [], ["one"], ["ONE"], ["two", "words"]]
    return [" ".join(x) for x in out]


def test_stage_drops_every_near_copy(spark):
    made = texts()
    rows = list(enumerate(made))
    want = keepers(rows)
    assert 20 < len(want) < len(made) - 60
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, frame(spark, made), SMALL).collect()) == want


def test_rounds_leave_no_pair_out(spark):
    docs = frame(spark, texts(6)).repartition(3)
    distinct = simhash.set_prints(docs).groupBy("fp").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "wide", "ones")))
    one, many, small = ({r["node"]: r["root"] for r in simhash.similar_roots(distinct, docs, *how).collect()} for how in ((0,), (simhash.ROUNDS,), (2, 16, 8)))
    assert one and one == many == small


def test_candidates_hold_every_similar_pair():
    rng = random.Random(9)
    for n in (12, 40, 200, 1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        made = [base, *(edited(base, k, rng) for k in range(1, max(2, n // 40))), base[: n - n // 6], base + [f"x{k}" for k in range(n // 6)]]
        made += [[f"w{rng.randrange(10**6)}" for _ in range(n)] for _ in range(20)]
        sets = [simhash.shingle_set(" ".join(x).encode()) for x in made]
        keys = [int(np.uint64(simhash.set_key(s)).astype(np.int64)) for s in sets]
        table = pa.table({"fp": keys, "root": keys, "n": [len(s) for s in sets], "wide": [simhash.majority(iter([s]), simhash.WIDE).tobytes() for s in sets]})
        side = simhash.Side(table)
        found = {frozenset((int(side.fp[a]), int(side.fp[b]))) for r, c, _ in simhash.candidates(side, side) for a, b in zip(r, c)}
        want = {frozenset((keys[i], keys[j])) for i, j in combinations(range(len(made)), 2) if simhash.similar(sets[i], sets[j])}
        assert want and want <= found
        unlike = {frozenset((keys[i], keys[j])) for i, j in combinations(range(len(made)), 2) if 3 * len(np.intersect1d(sets[i], sets[j])) < len(np.union1d(sets[i], sets[j]))}
        assert len(unlike) > 100 and not unlike & found


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3000)).encode()
    whole = [np.concatenate(list(simhash.shingle_hashes(t, 5))) for t in (text, b"one", b"a b c d e")]
    assert len(whole[0]) == 2996 and whole[1][0] == xxhash.xxh64_intdigest(b"one", 42)
    monkeypatch.setattr(tb.spaced_words, "__defaults__", (7,))
    cut = [np.concatenate(list(simhash.shingle_hashes(t, 5))) for t in (text, b"one", b"a b c d e")]
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_rows_without_id_repeats_and_clashing_names(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 5), (1, "other words in this one here", 3), (None, "a b c d e f", 1), (None, "no id at all", 9), (None, "NO ID at all", 4), (2, None, 1), (3, "", 1), (4, "x y z x y z", 1)]
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], "doc_id long, text string, row long, id long, fp long, root long, least long, component_id long")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["row"]) for r in kept.collect()) == sorted([("1", "a b c d e f", 0), ("None", "NO ID at all", 4), ("2", None, 1), ("4", "x y z x y z", 1)])
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_tables_of_cells_need_no_python_workers(spark):
    rows = spark.range(40).selectExpr("id AS fp", "cast(id % 3 AS int) AS a", "cast(id % 2 AS int) AS b")
    met = simhash.deal(rows, "fp", lambda x, y: abs(x[0] - y[0]) <= 1, lambda _: 5)
    assert "ExistingRDD" not in met._jdf.queryExecution().toString()  # a list of rows, which workers of a pool of their own unpickle
    assert met.where("side = 0").count() and simhash.deal(rows.limit(0), "fp", lambda x, y: True, lambda _: 5).count() == 0


def test_tasks_give_back_what_they_freed():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096

    def run(batches):
        held = [np.ones(12_000) for _ in range(2_000)]  # 96 kB each
        last = np.ones(100)  # above them
        seen.append(resident())
        del held
        yield from batches
        assert len(last)

    seen = []
    list(runtime.lean(run)(iter([])))
    assert seen[0] - resident() > 100e6


def test_scans_decode_few_texts_at_once(spark):
    runtime.ship(spark)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == runtime.READ_ROWS != runtime.READ_DEFAULT
