"""SimHash near-duplicates: fingerprints of word shingles, then a tiled exact comparison.

Fingerprints are compared as numbers. They are dealt to cells by bit counts, cells are cut into blocks,
and only blocks whose bit counts can lie within the radius meet. In a meeting, rows and columns are cut
again by bit counts before exclusive-or and bit count decide.

:func:`near_duplicates` links 64-bit fingerprints within a radius. A meeting reports a spanning forest
of its links, and label rounds join the forests into components.

:func:`keep_first` keeps one document of each group of near copies: texts whose sets of 5-word shingles
have a Jaccard similarity of ``SIMILAR`` or more. Its fingerprints have ``WIDE`` words of 64 bits over the
set of shingles, and pairs within ``WIDE_RADIUS`` bits are candidates, each verified on the whole sets.
Two sets of similarity J differ in each bit with a chance of arccos(2J / (1 + J)) / pi or less, 0.152 at 0.8:
39 of 256 bits with a deviation of 6, so the radius of 72 misses about one pair in 10**8 (in a thousand
where a text has but a dozen shingles), while unlike texts differ in 128 with a deviation of 8. Sets whose
sizes rule the similarity out don't meet. Rounds first link every set to its nearest one in another
component. Then the sets that still have a candidate in another component meet, in blocks, with their
shingles, and a meeting verifies all of its candidates and reports a spanning forest of the links.

Defined results: a null text counts as empty; empty texts have fingerprint zero, are copies of each other
and link like any other. A text with fewer words than a shingle is one shingle. A row with a null doc_id
belongs to its component, whose id is the smallest doc_id in it that is not null (null if there is none).
Repeated rows are repeated in the result of :func:`near_duplicates`. Empty tables give empty results. Very
long texts are read in pieces; 8 bytes a word are held. Other columns may have any name: rows travel boxed.
Equal sets are told by the XXH64 of their sorted hashes, equal shingles by theirs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.llm import textbytes as tb
from cairn.operators.components import connected
from cairn.runtime import give_back, lean, materialize, release, ship

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints of one block of a tile; a meeting compares two blocks.
BLOCK = 16_384
#: Rows of a numpy comparison.
ROWS = 64

#: Words of a shingle and least similarity (as a fraction) of near copies.
COPY_WORDS = 5
SIMILAR = (4, 5)
WIDE, WIDE_RADIUS = 4, 72
#: Bits of the first 64 in which a candidate may differ: its mean is 10, its deviation 3.
FIRST_RADIUS = 24
#: Share of pairs that pass the first 64 bits from which on all bits are compared as whole matrices.
DENSE = 0.2
WIDE_BLOCK = 4096
#: Sets of a block that meets with its shingles, and about how many bytes of them.
SET_BLOCK, SET_BYTES = 1024, 4_000_000
#: Rounds that link sets to their nearest, before all candidates left are verified in meetings.
ROUNDS = 1
#: Ids up to which a table of them is broadcast; beyond, it is joined by shuffle.
FEW = 500_000
#: A row of :func:`deal`'s table of cells.
CELLS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("cell", pa.int64()), ("blocks", pa.int32()), ("others", pa.list_(pa.struct([("cell", pa.int64()), ("blocks", pa.int32())])))])
_SALTS = np.random.default_rng(SEED).integers(1, 2**63, WIDE, np.uint64)


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of the lower-cased words (ASCII letters), in parts."""
    held: list[bytes] = []
    made = False
    for words in tb.spaced_words(text.lower()):
        own = held + words
        if len(own) >= size:
            made = True
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(own[k : len(own) - size + 1 + k] for k in range(size)))), repeat(SEED)), np.uint64, len(own) - size + 1)
        held = own[len(own) - size + 1 :] if len(own) >= size else own
    if held and not made:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def _mixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; sums of up to 255 flags fit a byte."""
    flags = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    return np.add.reduceat(flags, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(parts: Iterator[np.ndarray], words: int = 1) -> np.ndarray:
    """Majority bits of hashes; words beyond the first are taken of hashes mixed anew."""
    bits, total = np.zeros(64 * words, np.int64), 0
    for whole in parts:
        total += len(whole)
        for k in range(0, len(whole), 8160):
            h = whole[k : k + 8160]
            for j in range(words):
                bits[64 * j : 64 * (j + 1)] += _bit_counts(_mixed(h, _SALTS[j]) if j else h)
    return np.packbits(bits * 2 > total, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    return int(majority(shingle_hashes(text, size))[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, size) for t in tb.texts(batch.column(1))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def deal(rows: DataFrame, key: str, near: Callable[[tuple, tuple], bool], block: Callable[[tuple], int]) -> DataFrame:
    """``rows`` (with cells ``a``, ``b``) once for each meeting of their block with a block of a near cell.

    Adds the two blocks (``one``, ``two``) and ``side``: 0 in the first, 1 in the second. Cells are few
    whatever the number of rows; blocks and meetings are worked out by expressions, not on the driver.
    """
    cells = {(r["a"], r["b"]): -(-r["count"] // block((r["a"], r["b"]))) for r in rows.groupBy("a", "b").count().collect()}
    number = {cell: k for k, cell in enumerate(cells)}
    table = [{"a": a, "b": b, "cell": k, "blocks": cells[a, b], "others": [{"cell": number[x], "blocks": cells[x]} for x in cells if near((a, b), x)]} for (a, b), k in number.items()]
    plan = rows.sparkSession.createDataFrame(pa.Table.from_pylist(table, CELLS))  # as Arrow: a list of rows would be read by Python workers of its own
    own = rows.join(F.broadcast(plan), ["a", "b"]).withColumn("me", F.col("cell") * 2**32 + F.pmod(F.xxhash64(key), F.col("blocks")))
    seats = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["blocks"] - 1), lambda j: o["cell"] * 2**32 + j)))
    met = own.withColumn("other", F.explode(seats))
    return met.select(*(c for c in rows.columns if c not in ("a", "b")), F.least("me", "other").alias("one"), F.greatest("me", "other").alias("two"), (F.col("me") > F.col("other")).cast("int").alias("side"))


def _spread(met: DataFrame):
    """Meetings dealt to tasks."""
    return met.repartition(4 * int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "one", "two").groupBy("one", "two")


def _near(a: np.ndarray, b: np.ndarray, radius: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as node numbers: rows of ``a`` from 0, rows of ``b`` from ``base`` (0 if they are the same rows)."""
    found: list[np.ndarray] = []
    held = 0
    qa, qb = (np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16) for x in (a, b))
    for i in range(0, len(a), ROWS):
        rows = slice(i, i + ROWS)
        low, high = qa[rows].min(axis=0), qa[rows].max(axis=0)
        apart = (np.maximum(qb - high, 0) + np.maximum(low - qb, 0)).sum(axis=1)
        cols = np.flatnonzero(apart <= radius)
        r, c = np.nonzero(np.bitwise_count(a[rows, None] ^ b[cols][None, :]) <= radius)
        x, y = r + i, cols[c] + base
        if not base:
            x, y = x[x < y], y[x < y]
        found.append(np.stack([x, y]))
        held += len(x)
        if held > 1_000_000:  # a dense meeting: go on with a forest of what was found so far
            found = [_forest(*np.concatenate(found, axis=1), base + len(b))]
            held = found[0].shape[1]
    return _forest(*np.concatenate(found, axis=1), base + len(b))


def _labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes under the edges (x, y)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """At most one edge for each node, with the same components."""
    label = _labels(x, y, n)
    own = np.flatnonzero(label != np.arange(n))
    return np.stack([label[own], own])


def link_forests(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` with the components of all links within the radius."""
    halves = distinct.select(
        "fp",
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("a"),
        F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("b"),
    )
    dealt = deal(halves, "fp", lambda x, y: abs(x[0] - y[0]) + abs(x[1] - y[1]) <= radius, lambda _: block)

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        order = lambda x: x[np.lexsort(np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).T)]
        same = table.column("one")[0] == table.column("two")[0]
        a = order(fp[side == 0])
        b = a if same else order(fp[side == 1])
        nodes = a if same else np.concatenate([a, b])
        u, v = _near(a, b, radius, 0 if same else len(a)) if len(a) and len(b) else (np.zeros(0, int),) * 2
        return pa.table({"u": nodes[u].view(np.int64), "v": nodes[v].view(np.int64)})

    return _spread(dealt).applyInArrow(meet, "u long, v long")


def components(printed: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``printed`` (doc_id, fp)."""
    distinct = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return name_components(distinct, connected(materialize(link_forests(distinct.select("fp"), radius, block), "forests")))


def name_components(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, component_id) of all of ``distinct`` (fp, least), given (node, root) of those with a link."""
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    printed = materialize(fingerprints(docs, size), "fingerprints")
    named = components(printed, radius, block)
    return printed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by similarity: wide fingerprints, every candidate verified


def shingle_set(text: bytes, size: int = COPY_WORDS) -> np.ndarray:
    """Sorted distinct hashes of all shingles."""
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def set_prints(docs: DataFrame, size: int = COPY_WORDS) -> DataFrame:
    """doc_id, the key of its set (``fp``, a signed long), the set's size, the wide fingerprint, and its bit count."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, wide, ones = [], [], [], []
            for text in tb.texts(batch.column(1)):
                own = shingle_set(text, size)
                keys.append(set_key(own))
                sizes.append(len(own))
                own = majority(iter([own] if len(own) else []), WIDE)
                wide.append(own.tobytes())
                ones.append(int(np.bitwise_count(own).sum()))
            columns = [batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), pa.array(ones, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n", "wide", "ones"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, fp long, n long, wide binary, ones int")


class Side:
    """One block of a meeting, ordered by the sizes of its sets."""

    def __init__(self, table: pa.Table):
        self.n = table.column("n").to_numpy()
        self.order = order = np.argsort(self.n, kind="stable")
        self.n = self.n[order]
        self.fp, self.root = (table.column(c).to_numpy()[order] for c in ("fp", "root"))
        self.wide = np.frombuffer(bytearray(b"".join(table.column("wide").to_pylist())), np.uint64).reshape(-1, WIDE)[order] if len(order) else np.zeros((0, WIDE), np.uint64)
        self.first = np.ascontiguousarray(self.wide[:, 0])
        self.bits = np.bitwise_count(self.wide).sum(axis=1).astype(np.int16)


def _chunks(a: Side, b: Side) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows of ``a``, the rows of ``b`` that sizes and bit counts allow for them, and which pairs pass the first 64 bits."""
    for i in range(0, len(a.fp), ROWS):
        rows = slice(i, i + ROWS)
        least, most = int(a.n[rows][0]), int(a.n[rows][-1])
        low = np.searchsorted(b.n, -(-least * SIMILAR[0] // SIMILAR[1]))
        high = np.searchsorted(b.n, most * SIMILAR[1] // SIMILAR[0], "right")
        within = (b.bits[low:high] >= a.bits[rows].min() - WIDE_RADIUS) & (b.bits[low:high] <= a.bits[rows].max() + WIDE_RADIUS)
        cols = np.flatnonzero(within) + low
        if len(cols):
            yield rows, cols, np.bitwise_count(a.first[rows, None] ^ b.first[cols][None, :]) <= FIRST_RADIUS


def _allowed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * SIMILAR[1] >= np.maximum(n, m) * SIMILAR[0]


def _listed(a: Side, b: Side, rows: slice, cols: np.ndarray, passed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, differing bits) of the pairs of a chunk that are candidates in different components."""
    r, c = np.nonzero(passed)
    r, c = r + rows.start, cols[c]
    keep = a.root[r] != b.root[c]
    r, c = r[keep], c[keep]
    bits = np.bitwise_count(a.wide[r] ^ b.wide[c]).sum(axis=1)
    keep = (bits <= WIDE_RADIUS) & _allowed(a.n[r], b.n[c])
    return r[keep], c[keep], bits[keep].astype(np.int64)


def candidates(a: Side, b: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, differing bits) of the pairs in different components, some rows of ``a`` at a time."""
    return (_listed(a, b, *chunk) for chunk in _chunks(a, b))


def _nearest(a: Side, b: Side, same: bool) -> pa.Table:
    """For each set with a candidate on the other side: the nearest (u, v), and how many it has (c)."""
    far = np.iinfo(np.int64).max
    best = [np.full(len(a.fp), far), np.full(len(b.fp), far)]
    count = [np.zeros(len(a.fp), np.int64), np.zeros(len(b.fp), np.int64)]
    for rows, cols, passed in _chunks(a, b):
        if np.count_nonzero(passed) > DENSE * passed.size:
            bits = sum(np.bitwise_count(a.wide[rows, j][:, None] ^ b.wide[cols, j][None, :]).astype(np.uint16) for j in range(WIDE))
            good = passed & (bits <= WIDE_RADIUS) & (a.root[rows, None] != b.root[cols][None, :]) & _allowed(a.n[rows, None], b.n[cols][None, :])
            bits[~good] = 999
            for side, axis, own, other in ((0, 1, np.arange(rows.start, rows.start + len(bits)), cols), (1, 0, cols, np.arange(rows.start, rows.start + len(bits)))):
                at = bits.argmin(axis=axis)
                least = np.take_along_axis(bits, np.expand_dims(at, axis), axis).ravel().astype(np.int64)
                best[side][own] = np.minimum(best[side][own], np.where(least < 999, least << 40 | other[at], far))
                count[side][own] += np.count_nonzero(good, axis=axis)
        else:
            r, c, bits = _listed(a, b, rows, cols, passed)
            for side, own, other in ((0, r, c), (1, c, r)):
                np.minimum.at(best[side], own, bits << 40 | other)
                np.add.at(count[side], own, 1)
    out = []
    for own, other, near, n in ((a, b, best[0], count[0]), (b, a, best[1], count[1]))[: 1 if same else 2]:
        hit = np.flatnonzero(near < far)
        out.append((own.fp[hit], other.fp[near[hit] & (2**40 - 1)], n[hit]))
    u, v, n = (np.concatenate(x) for x in zip(*out))
    return pa.table({"u": u, "v": v, "c": n})


def _verified_forest(a: Side, b: Side, own: list[np.ndarray], other: list[np.ndarray], same: bool) -> pa.Table:
    """A spanning forest (u, v) of the similar pairs in different components; ``own``, ``other``: the sides' sets."""
    every = own if same else own + other
    number = np.unique(np.concatenate(every), return_inverse=True)[1] if every else np.zeros(0, np.int64)
    stops = np.cumsum([len(x) for x in every])
    ids = [number[stop - len(x) : stop] for x, stop in zip(every, stops)]
    ours, theirs = ids[: len(own)], ids if same else ids[len(own) :]
    joined = np.concatenate(theirs) if theirs else number[:0]
    sizes = np.array([len(x) for x in theirs], np.int64)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(number.max(initial=-1)) + 1, bool)
    base, found = 0 if same else len(own), []
    for r, c, _ in candidates(a, b):
        for i in np.unique(r):
            cols = c[r == i]
            cols = cols[cols > i] if same else cols
            if not len(cols):
                continue
            flags[ours[i]] = True
            if 8 * len(cols) > len(theirs):
                running = np.zeros(len(joined) + 1, np.int64)
                np.cumsum(flags[joined], out=running[1:])
                both = (running[starts + sizes] - running[starts])[cols]
            else:
                both = np.array([np.count_nonzero(flags[theirs[j]]) for j in cols])
            flags[ours[i]] = False
            cols = cols[both * SIMILAR[1] >= (len(ours[i]) + sizes[cols] - both) * SIMILAR[0]]
            found.append(np.stack([np.full(len(cols), i), cols + base]))
    nodes = a.fp if same else np.concatenate([a.fp, b.fp])
    u, v = _forest(*np.concatenate(found, axis=1), len(nodes)) if found else (np.zeros(0, int),) * 2
    return pa.table({"u": nodes[u], "v": nodes[v]})


def _placed(sets: DataFrame) -> DataFrame:
    """``sets`` with cells ``a``, ``b``: classes of size and of bit count."""
    step = math.log(SIMILAR[1] / SIMILAR[0])
    return sets.withColumns({"a": F.floor(F.log(F.greatest("n", F.lit(1))) / step).cast("int"), "b": F.floor(F.col("ones") / (WIDE_RADIUS + 1)).cast("int")}).drop("ones")


def _near_cells(x: tuple, y: tuple) -> bool:
    """One class of size more than the similarity asks for, so that rounding of the logarithm can't part a pair."""
    return abs(x[0] - y[0]) <= 2 and abs(x[1] - y[1]) <= 1


def nearest(sets: DataFrame, block: int = WIDE_BLOCK) -> DataFrame:
    """(u, v, c) of :func:`_nearest` of all meetings of ``sets`` (fp, n, wide, ones, root)."""

    def meet(table: pa.Table) -> pa.Table:
        side, same = table.column("side").to_numpy(), table.column("one")[0] == table.column("two")[0]
        a = Side(table.filter(pa.array(side == 0)))
        return _nearest(a, a if same else Side(table.filter(pa.array(side == 1))), same)

    return _spread(deal(_placed(sets), "fp", _near_cells, lambda _: block)).applyInArrow(meet, "u long, v long, c long")


def verified_meetings(sets: DataFrame, block: int = SET_BLOCK) -> DataFrame:
    """Links (u, v) that join all similar pairs of ``sets`` (fp, n, wide, ones, root, shingles) that lie in different components."""

    def room(cell: tuple) -> int:
        return max(1, min(block, int(SET_BYTES / (8 * (SIMILAR[1] / SIMILAR[0]) ** (cell[0] + 1)))))

    def meet(table: pa.Table) -> pa.Table:
        side, same = table.column("side").to_numpy(), table.column("one")[0] == table.column("two")[0]
        parts = [table.filter(pa.array(side == k)) for k in range(1 if same else 2)]
        sides = [Side(x) for x in parts]
        sets_ = [[np.frombuffer(x, np.uint64) for x in part.column("shingles").take(pa.array(own.order)).to_pylist()] for part, own in zip(parts, sides)]
        found = _verified_forest(sides[0], sides[-1], sets_[0], sets_[-1], same)
        give_back()
        return found

    return _spread(deal(_placed(sets), "fp", _near_cells, room)).applyInArrow(meet, "u long, v long")


def sets_of(docs: DataFrame, need: DataFrame, size: int = COPY_WORDS) -> DataFrame:
    """(fp, shingles) of the sets of ``need`` (fp, least): only rows with their ids are read for shingles."""
    ids = need.where("least is not null").select("least")
    few = ids.limit(FEW + 1).count() <= FEW
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("least"), "left_semi").select("text")
    if need.where("least is null").limit(1).count():
        rows = rows.unionByName(own.where("id is null").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 128):
                sets = [shingle_set(t, size) for t in tb.texts(batch.column(0)[k : k + 128])]
                keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    found = rows.mapInArrow(lean(run), "fp long, shingles binary")
    wanted = need.select("fp")
    return found.join(F.broadcast(wanted) if few else wanted, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("x"))
    two = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(lean(run), "u long, v long")


def similar_roots(distinct: DataFrame, docs: DataFrame, rounds: int = ROUNDS, block: int = WIDE_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(node, root) of the distinct sets (fp, least, n, wide, ones) that have a similar one."""
    roots = distinct.select(F.col("fp").alias("node"), F.col("fp").alias("root")).where("false")
    marked = lambda sets: sets.join(roots, sets["fp"] == roots["node"], "left").select(*sets.columns, F.coalesce("root", "fp").alias("root"))
    prints = lambda sets: marked(sets.select("fp", "n", "wide", "ones"))
    wanted = lambda nodes: sets_of(docs, materialize(distinct.select("fp", "least").join(nodes.distinct(), "fp", "left_semi"), "ends"))
    active, edges, sets = distinct, None, None
    for _ in range(rounds):
        met = materialize(nearest(prints(active), block), "met")
        if sets is None:
            sets = materialize(wanted(met.select(F.col("u").alias("fp")).union(met.select(F.col("v").alias("fp")))), "sets")
        found = materialize(verified(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets), "links")
        edges = found if edges is None else edges.unionAll(found)
        # a pair that wasn't reported has two candidates or more at either end, in its meeting
        active = materialize(active.join(met.where("c > 1").select(F.col("u").alias("fp")).distinct(), "fp", "left_semi"), "active")
        release(met)
        roots = connected(edges)
    # every set with a candidate in another component reports one
    left = nearest(prints(active), block).select(F.col("u").alias("fp")).distinct()
    active = materialize(active.join(left, "fp", "left_semi"), "active")
    if not active.limit(1).count():
        return roots
    sets = sets or materialize(wanted(active.select("fp")), "sets")
    found = materialize(verified_meetings(prints(active).join(sets, "fp"), set_block), "links")
    release(sets)
    return connected(found if edges is None else edges.unionAll(found))


def near_copies(docs: DataFrame, rounds: int = ROUNDS, block: int = WIDE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of the distinct sets of ``docs``."""
    printed = materialize(set_prints(docs), "prints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("ones").alias("ones")), "distinct")
    named = materialize(name_components(distinct, similar_roots(distinct, docs, rounds, block)), "named")
    release(distinct)
    return printed.select("doc_id", "fp"), named


def keep_first(docs: DataFrame, rounds: int = ROUNDS, block: int = WIDE_BLOCK) -> DataFrame:
    """One row of each group of near copies, all its columns as they were: a row of its smallest doc_id.

    Of several rows with that doc_id one stays, the least by its columns in order. Rows with a null
    doc_id go where their group has a row with one; else the group's least row stays. Which ids go is
    settled on ids alone; only rows whose id is repeated are shuffled with their texts.
    """
    printed, named = near_copies(docs, rounds, block)
    keepers = named.where("component_id is not null").select(F.col("component_id").alias("id")).distinct()
    ids = printed.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    gone = materialize(ids.join(keepers, "id", "left_anti").select("id", F.lit(True).alias("goes")).unionByName(ids.where("n > 1").join(keepers, "id", "left_semi").select("id", F.lit(False).alias("goes"))), "gone")
    few = gone.limit(FEW + 1).count() <= FEW
    side = F.broadcast(gone) if few else gone
    boxed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    kept = boxed.where("id is not null").join(side, "id", "left_anti").select("row")
    again = gone.where("not goes").select("id")
    if again.limit(1).count():
        kept = kept.unionByName(boxed.join(F.broadcast(again) if few else again, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row")).select("row"))
    nameless = named.where("component_id is null").select("fp", "root")
    if nameless.limit(1).count():  # groups without any doc_id: their rows are found again by their sets
        kept = kept.unionByName(_with_key(boxed.where("id is null").select("row")).join(nameless, "fp").groupBy("root").agg(F.min("row").alias("row")).select("row"))
    return kept.select("row.*")


def _with_key(boxed: DataFrame) -> DataFrame:
    """``boxed`` (row) with the key of its text's set in a column ``fp``."""
    own = boxed.select("row", F.col("row.text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((set_key(shingle_set(t)) for t in tb.texts(batch.column(1))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["row", "fp"])

    return own.mapInArrow(run, T.StructType([own.schema["row"], T.StructField("fp", T.LongType())]))
