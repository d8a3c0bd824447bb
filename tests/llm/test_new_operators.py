"""Ranked lexical search, wrapper induction and source divergence against brute force."""

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.llm import catalog, divergence, lexical, wrappers
from cairn.runtime import materialize

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=("en",), sources=("s",)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], sources[i % len(sources)], 0) for i, t in enumerate(texts)], DOC)


# --- op 11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rank_brute(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms_of(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, bag in bags:
            m = 10 + 90 * bag.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m)) for w in words if w in bag)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_lexical_equals_brute_force_with_awkward_rows(spark):
    texts = [None, "", "...", "a b c", "a b c", "A B! c", "Ünï café 漢字", "x " * 3000, "b " * 50 + "rare"] + [f"w{i % 7} w{i % 11} a " * (1 + i % 4) for i in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a b c"), (None, "rare rare"), (None, "rare rare")]
    items = [(1, "a b"), (1, "RARE"), (2, None), (3, "nowhere"), (4, "w1 w2 w3 w1"), (None, "café"), (5, "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = lexical.rank_documents(frame, asked)
    assert sorted((tuple(r) for r in got.collect()), key=str) == rank_brute(docs, items)
    index, n, _ = lexical.build_index(frame)
    rounds = lexical.search(index, n, asked, item_bytes=4)
    assert sorted((tuple(r) for r in rounds.collect()), key=str) == rank_brute(docs, items)


def test_lexical_stores_each_shard_in_a_row_group_of_its_own(spark):
    docs = docs_of(spark, [f"w{i:05d} common " * 60_000 for i in range(30)]).coalesce(1)  # 25 MB
    index, _, _ = lexical.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")) for f in index.inputFiles()]
    groups = [f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)]
    assert len(groups) == index.count() >= 3 and set(groups) == {1}


def test_lexical_empty_tables(spark):
    none = docs_of(spark, [None]).where("false")
    some = docs_of(spark, ["a b"])
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(none, item).count() == 0
    assert lexical.rank_documents(some, item.where("false")).count() == 0
    assert lexical.rank_documents(docs_of(spark, [None, ""]), item).count() == 0


def cut_brute(tops, sums, sizes):
    """The cost of the best cut of one list, by trying all sets of boundaries."""
    steps, price = len(tops), lexical.BLOCK_COST * sum(sums) / max(sum(sizes), 1)
    best = math.inf
    for mask in range(1 << (steps - 1)):
        ends = [j for j in range(1, steps) if mask >> (j - 1) & 1] + [steps]
        at, cost = 0, 0.0
        for e in ends:
            cost += sum(sizes[at:e]) * max(tops[at:e]) - sum(sums[at:e]) + price
            at = e
        best = min(best, cost)
    return best


def test_block_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 4, (20, 8))
    tops = np.where(sizes > 0, rng.integers(1, 100, (20, 8)), 0)
    sums = np.where(sizes > 0, tops + (sizes - 1) * (tops // 2), 0)
    ends = lexical.cut(tops, sums.astype(float), sizes)
    for k in range(20):
        at, cost = 0, 0.0
        price = lexical.BLOCK_COST * sums[k].sum() / max(sizes[k].sum(), 1)
        for e in np.flatnonzero(ends[k]) + 1:
            cost += sizes[k, at:e].sum() * tops[k, at:e].max() - sums[k, at:e].sum() + price
            at = e
        assert at == 8
        assert cost == pytest.approx(cut_brute(tops[k], sums[k], sizes[k]))


def test_blocks_bound_their_postings_and_steps_are_skipped():
    rng = np.random.default_rng(3)
    shard = lexical.Shard()
    words = [f"w{k}" for k in range(400)]
    share = 1 / np.arange(1, 401)
    for i in range(1500):
        topic = words[350 + i // 64 % 20]
        shard.add(i, " ".join([*rng.choice(words, 40, p=share / share.sum()), *[topic] * 6]).encode())
    row = shard.row(1500, 1500 * 46)
    terms = {w.encode(): k for k, w in enumerate(words)}
    own = lexical.Postings(row, 0, terms)
    for (docs, impacts), bounds in zip(own.lists, own.bounds):
        assert (impacts <= bounds[docs // lexical.STEP]).all()
    lists = len(own.lists)
    assert sum(len(np.unique(b)) for b in own.bounds) < lists * own.steps
    asked = [own.of[terms[w]] for w in (b"w3", b"w355")]
    docs, scores, read = own.top(asked, np.array([900, 2500]), 10)
    full = own.scores(asked, np.array([900, 2500]), np.arange(own.steps))
    best = sorted(zip((-full[1]).tolist(), full[0].tolist()))[:10]
    assert sorted(zip((-scores).tolist(), docs.tolist()))[:10] == best
    assert read < own.steps


# --- op 12

def article_of(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    got = catalog.queries()["op12_html"](spark, SMALL).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def site_page(k, extra=""):
    story = "".join(f"<div>Story {k} sentence {j} with words that no other page of this site has, number {k * 31 + j}.</div>" for j in range(3 + k % 3))
    return (
        f"<html><head><title>t{k}</title><script>if (a < b) x='<p>no</p>'</script></head><body><div id=top>Daily Paper</div>"
        f"<div class='bar'><span>Home</span> <span>World</span></div><div class='body'><div>Read this paper every day, it is printed on real paper and costs little money.</div>{story}{extra}</div>"
        f"<div>All content of this paper belongs to its owners and may not be printed elsewhere.</div></body></html>"
    )


def test_templates_without_semantic_tags_are_learned(spark):
    rows = [(k, f"https://paper.example.com/{k}", site_page(k)) for k in range(12)] + [(100 + k, f"https://paper.example.com/c{k}", site_page(3)) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages).collect()}
    for k, _, page in rows:
        story = re.findall(r"<div>(Story [^<]*)</div>", page)
        assert got[k] == "\n".join(story), k


def test_groups_give_what_a_broadcast_gives(spark, monkeypatch):
    rows = [(k, f"https://paper.example.com/{k}", site_page(k)) for k in range(12)] + [(50, None, "<p>no host"), (51, "https://alone.example.com/", "<main>one<p>two</main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = sorted(map(tuple, wrappers.main_texts(pages).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wrappers, "GROUP_PAGES", 5)
    assert sorted(map(tuple, wrappers.main_texts(pages).select("page_id", "url", "text", "n_chars").where("page_id < 50").collect())) == [r for r in near if r[0] < 50]
    assert wrappers.main_texts(pages).count() == 14


AWKWARD = [
    (None, ""),
    ("", ""),
    ("plain text  only\n here", "plain text only here"),
    ("<p>one<p>two &amp; three&nbsp;&lt;b&gt;<br>four", "one\ntwo & three <b> four"),
    ("<article><p>a<b>b</b>c</p><aside>no</aside><!-- no --><form>no</form><h2>t</h2></article><p>outside", "abc\nt"),
    ("<article>kept<div class='reader-comments'>no</div></article>", "kept"),
    ("<main><nav>no</nav>yes<p>more", "yes\nmore"),
    ("<article><header><h1>Title</h1></header><p>x</article><header>no</header>", "Title\nx"),
    ("<header>no</header><p>yes</p><footer>no", "yes"),
    ("<p>a</p><script>var x='</p>'</script><p>b<style>p{}", "a\nb"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<div>" * 500 + "deep" + "</div>" * 500, "deep"),
    ("<p " + "x" * 50 + "<p>y", "y"),
    ("a <", "a <"),
    ("<p>w</p>" * 3000, "\n".join(["w"] * 3000)),
    ("<p>&#x48;&#105; &copy &unknown; &am", "Hi © &unknown; &am"),
]


@pytest.mark.parametrize("page,text", AWKWARD)
def test_awkward_pages(page, text):
    assert wrappers.extract(page) == text


def test_pages_empty_and_repeated(spark):
    schema = "page_id long, url string, html string"
    assert wrappers.main_texts(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "https://a.example.com/1", "<p>same page here")] * 4 + [(None, "https://a.example.com/2", None)]
    got = [tuple(r) for r in wrappers.main_texts(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, "https://a.example.com/1", "same page here", 14)] * 4 + [(None, "https://a.example.com/2", "", 0)], key=str)


def match_brute(a, b):
    """Worth of the best pairing of two equally labelled nodes, by plain recursion."""
    if a.text is not None or b.text is not None:
        return 2 if a.text == b.text else 1

    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        out = max(best(i + 1, j), best(i, j + 1))
        if a.children[i].label == b.children[j].label:
            out = max(out, match_brute(a.children[i], b.children[j]) + best(i + 1, j + 1))
        return out

    return 1 + best(0, 0)


def paired_worth(pairs):
    """Worth of the leaves paired and of the elements above them that have leaves below."""
    elements = {(id(p), id(q)) for x, y in pairs for p, q in zip(up(x), up(y))}
    return sum(2 if x.text == y.text else 1 for x, y in pairs) + len(elements)


def up(node):
    while node.parent is not None:
        node = node.parent
        yield node


@pytest.mark.parametrize("wide", [24, 0])
def test_alignment_is_the_best_pairing(monkeypatch, wide):
    monkeypatch.setattr(wrappers, "WIDE", wide)
    pages = [
        ("<div><p>a<p>b<p>c</div><h1>t</h1>", "<div><p>b<p>c<p>d</div><h1>t</h1>"),
        ("<ul><li>x<li>y</ul><div><p>q</div>", "<div><p>q<p>r</div><ul><li>y</ul>"),
        ("<div><div><p>1</div><div><p>2<p>3</div></div>", "<div><div><p>2<p>3</div><div><p>1</div></div>"),
    ]
    for one, two in pages:
        a, b = wrappers.parse(one), wrappers.parse(two)
        assert paired_worth(wrappers.align(a, b)) == match_brute(a, b)


# --- op 13

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_brute(rows, least, top):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        documents[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = {w for w, n in documents[lang].items() if n >= least}
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        p, q = share(counts[lang, source]), share(whole)
        pairs = [(o, sum(abs(p[w] - x) for w, x in share(counts[lang, o]).items())) for g, o in groups if g == lang and o != source]
        terms = [(w, p[w] - q[w]) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        for part, own, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(own, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, w, v, r) for r, (w, v) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_equals_brute_force_in_small_tiles(spark):
    rng = np.random.default_rng(2)
    words = ["the", "The", "ÉTÉ", "été", "漢字", "a1b2", "x-y", "rare", "z", "Zz"] + [f"q{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "de", None][i % 3], [None, "", *"abcdefg"][rng.integers(0, 9)]) for i in range(240)]
    rows += [(None, "xx", "lonely"), ("no kept words", "yy", "a"), ("", "yy", "b"), (rows[0][0], "en", "a"), (rows[0][0], "en", "a"), ("long " * 200_000, "en", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    want = audit_brute(rows, 8, 4)
    for block, chunk in ((64, 8192), (2, 3)):
        got = divergence.audit(docs, min_documents=8, top=4, block=block, chunk=chunk).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(docs.where("false")).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**14, 3 * 10**14 + 7])
    total, terms = int(counts.sum()), 1000
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


def test_index_is_one_table(spark):
    index, n, total = lexical.build_index(docs_of(spark, ["a b a", "c", None]))
    assert (n, total) == (2, 4)
    assert materialize(index, "copy").count() == index.count()


# --- later changes of op 8 and op 10

def test_outliers_leave_candidates_few(spark):
    from cairn.llm import topk

    own = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    odd = [(10_000 + i, [1000.0 * 10**i] * len(own[0][1])) for i in range(3)] + [(10_010 + i, [float(x) for x in rng.normal(size=len(own[0][1])) * 50]) for i in range(3)]
    shares = []
    for rows in (own, own + odd):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        file = topk.VectorFile(frame)
        queries = file.entries.where("first % 20 = 0 and first < 10000").select(F.col("entry").alias("asked"), "v")
        shares.append(file.candidates(queries).count() / (queries.count() * len(rows)))
    assert shares[1] < shares[0] + 0.05
    got = topk.top_k(spark.createDataFrame(own + odd, "vec_id long, embedding array<double>"), "id % 20 = 0").collect()
    whole = {i: [math.floor(64 * x) for x in v] for i, v in own + odd}
    for q in [i for i in whole if i % 20 == 0][:12]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_cells_hold_their_values():
    from cairn.llm import topk

    rng = np.random.default_rng(6)
    v = np.floor(np.concatenate([rng.normal(size=(500, 3)) * 40, [[10**6, -(10**9), 7], [0, 0, 1e200]]]))
    grid = topk.Grid.over(v.min(axis=0), v.max(axis=0), v[:200])
    cell = grid.cells(v)
    at = np.arange(3)[None, :], cell
    gap = np.abs(v - grid.middle[at])
    assert (gap <= grid.half[at] * (1 + 1e-9) + 1e-6).all()
    assert max(map(len, grid.edges)) < 256
    assert np.median(grid.half[at][:500]) <= 1


def test_only_ids_without_a_contrary_label_are_trusted(spark):
    from cairn.llm import quality

    docs = docs_of(spark, ["a", "b", "c", "d", "e", "f"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, None), (3, 0, 0), (3, 1, 0), (4, None, 0), (5, 1, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r["text"] for r in quality.trusted_texts(docs, labels).collect()) == ["a", "f"]


# --- op 4's reliabilities

@pytest.mark.parametrize("sens,spec", [((0.5, 0.7, 0.9), (0.99, 0.95, 0.7)), ((0.4, 0.8, 0.85), (0.97, 0.9, 0.9)), ((0.5, 0.1, 0.95), (0.999, 0.5, 0.95)), ((0.6, 0.9, 0.9), (0.95, 0.8, 0.6))])
def test_reliabilities_are_estimated_from_counted_votes(sens, spec):
    from cairn.llm import pii

    rng = np.random.default_rng(0)
    true = rng.random(10_000) < 0.3
    votes = np.stack([np.where(true, rng.random(10_000) < a, rng.random(10_000) < 1 - b) for a, b in zip(sens, spec)], axis=1).astype(int)
    share, got_sens, got_spec, _ = pii.reliabilities(Counter("".join(map(str, v)) for v in votes))
    assert share == pytest.approx(0.3, abs=0.05)
    assert got_sens == pytest.approx(sens, abs=0.05) and got_spec == pytest.approx(spec, abs=0.05)
