"""Exact top-k inner products by a vector-approximation file.

The file holds each distinct vector as cell numbers of one byte a component. A component's cells follow
its values: ``BODY`` of them between quantiles (of a bounded sample of ``EDGE_ROWS`` entries; only edges
come from it), and where these, or the ends of the whole table's range, are far apart, cells of doubling
width from both sides, so outliers stand in cells of their own. For a query every score lies within a distance (the slack, summed
from the widths of the candidate's own cells) of the score with the cells' middles. A first scan of the file finds, for
each query, a score that enough vectors reach for certain; a second scan reports the vectors whose upper
bound reaches it. Only for these are exact vectors read: first those with the highest upper bounds, then
those whose bound still reaches the kth score found, so that it is certain. The scans move cells and
queries, never the table's exact vectors. Queries are a stated set against all rows, in blocks of both.

Equal vectors are one entry with their ``k + 1`` smallest ids: ties go to smaller ids, so no other id
of the entry can be among the first k of any query.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or
as candidates; so do rows with a null id. Vectors of different lengths are compared as if the shorter
ended in zeros. An identical row (same id, same vector) counts once; rows that share an id are each a
candidate for other ids and never for their own; a query id with several vectors takes each candidate's
best score. Components are floored as doubles, whatever their size, products and sums are exact, and a
score beyond the range of a long is put at its end (ranks and ties go by that). An empty table gives an
empty result. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.runtime import materialize, ship

K = 20
SCALE = 64
#: Cells between quantiles, and most cells with those of doubling width in wide gaps.
BODY, MOST_CELLS = 100, 255
#: Entries whose components give the quantiles.
EDGE_ROWS = 20_000
#: Vectors of a candidate block, and queries of a query block.
BLOCK = 16_384
QUERY_BLOCK = 2048
#: Queries bounded at once; a matrix of them and a block's vectors is held.
ROWS = 128
#: Exact vectors of a query's first read, as a multiple of k + 1.
FIRST = 2
#: Whole numbers up to this are exact in doubles.
EXACT = float(2**53)


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct (id, v) with v the floors of the scaled components as doubles."""

    def whole(x: Column) -> Column:
        y = F.lit(float(SCALE)) * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # a larger double is whole

    v = F.transform(F.col(vector), whole)
    good = F.col(vector).isNotNull() & F.col(id_column).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(good).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(~F.exists("v", lambda x: F.abs(x) == float("inf"))).distinct()


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, ending in zeros where they are shorter than ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    width = max([width or 0, 1, *lengths])
    if lengths == [width]:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out = np.zeros((len(column), width))
    for i, r in enumerate(column):
        own = r.values.to_numpy(zero_copy_only=False)
        out[i, : len(own)] = own
    return out


def edges_of(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Lower ends of one component's cells, ascending from ``low``: quantiles of a sample, and in wide gaps steps of doubling width from both sides."""
    body = np.unique(np.floor(np.quantile(values, np.linspace(0, 1, BODY + 1)))) if len(values) else np.zeros(0)
    edges = np.unique(np.concatenate([[low], body[(body >= low) & (body <= high)]]))
    ends = np.append(edges[1:], high + 1)
    gaps = ends - edges
    width = max(1.0, float(np.median(gaps)))
    steps = width * 2.0 ** np.arange(60)
    found, room = [edges], MOST_CELLS - len(edges)
    for k in np.argsort(-gaps, kind="stable"):
        if gaps[k] <= 2 * width:
            break
        near = steps[steps < gaps[k] / 2]
        inner = np.floor(np.concatenate([edges[k] + near, ends[k] - near]))
        inner = inner[(inner > edges[k]) & (inner < ends[k])]
        if len(inner) <= room:
            found.append(inner)
            room -= len(inner)
    return np.unique(np.concatenate(found))


@dataclass
class Grid:
    """For each component the lower ends of its cells, their middles, half widths and largest sizes (by component and cell)."""

    edges: list[np.ndarray]
    middle: np.ndarray
    half: np.ndarray
    size: np.ndarray

    @classmethod
    def over(cls, low: np.ndarray, high: np.ndarray, sample: np.ndarray) -> Grid:
        edges = [edges_of(sample[:, k], low[k], high[k]) for k in range(len(low))]
        most = max(map(len, edges))
        middle, half, size = (np.zeros((len(low), most)) for _ in range(3))
        for k, own in enumerate(edges):
            top = np.maximum(np.append(own[1:] - 1, high[k]), own)
            middle[k, : len(own)], half[k, : len(own)] = own / 2 + top / 2, top / 2 - own / 2
            size[k, : len(own)] = np.maximum(np.abs(own), np.abs(top))
        return cls(edges, middle, half, size)

    def cells(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(v.shape, np.uint8)
        for k, own in enumerate(self.edges):
            out[:, k] = np.maximum(np.searchsorted(own, v[:, k], "right") - 1, 0)
        return out

    def of(self, cell: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths (components by vectors) of vectors' cells, rounding of scores with ``q`` included."""
        at = np.arange(len(self.edges))[None, :], cell
        middle, half = self.middle[at].T.copy(), self.half[at].T.copy()
        if not np.abs(q).max(initial=0) * self.size.max(axis=1).sum() < EXACT / 4:
            half += self.size[at].T * 1e-9
        return middle, half


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row: in doubles where these are exact, else in Python's integers, put at a long's ends beyond it."""
    with np.errstate(over="ignore"):
        safe = (np.abs(q) * np.abs(v)).sum(axis=1) < EXACT
    out = np.zeros(len(q), np.int64)
    out[safe] = (q[safe] * v[safe]).sum(axis=1).astype(np.int64)
    for i in np.flatnonzero(~safe):
        out[i] = max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], v[i]))))
    return out


class VectorFile:
    """The approximation file of a table of vectors, and searches in it."""

    def __init__(self, rows: DataFrame, k: int = K, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK):
        ship(rows.sparkSession)
        self.k, self.block, self.query_block = k, block, query_block
        self.vectors = materialize(whole_vectors(rows, id_column, vector), "vectors")
        # an entry of equal vectors: its smallest ids; an id with several vectors may count once only
        several = self.vectors.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
        least = self.vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
        least = least.join(several, "id", "left").withColumn("sure", F.col("several").isNull())
        entries = least.groupBy("v").agg(F.min("id").alias("first"), F.array_sort(F.collect_list("id")).alias("ids"), F.max("sure").alias("sure"))
        self.entries = materialize(entries.withColumn("entry", F.xxhash64("first", "v")), "entries")
        n = self.entries.count()
        self.grid = self._grid(n)
        self.file = materialize(self._cells(), "cells")
        self.blocks = max(1, -(-n // block))

    def _grid(self, n_entries: int) -> Grid:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = high = np.zeros(0)
            n = np.zeros(0, np.int64)
            total = 0
            for batch in batches:
                if len(batch):
                    lengths = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
                    v = matrix(batch.column(0))
                    grow = max(0, v.shape[1] - len(low))
                    low, high, n = np.append(low, np.full(grow, np.inf)), np.append(high, np.full(grow, -np.inf)), np.append(n, np.zeros(grow, np.int64))
                    total += len(v)
                    low[: v.shape[1]], high[: v.shape[1]] = np.minimum(low[: v.shape[1]], v.min(axis=0)), np.maximum(high[: v.shape[1]], v.max(axis=0))
                    n[: v.shape[1]] += (lengths[:, None] > np.arange(v.shape[1])).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(low)), pa.int32()), pa.array([0.0, *low]), pa.array([0.0, *high]), pa.array([total, *n], pa.int64())], ["at", "low", "high", "n"])

        seen = self.entries.select("v").mapInArrow(run, "at int, low double, high double, n long")
        rows = {r["at"]: r for r in seen.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()}  # a row for each component
        width = max([1, *(at + 1 for at in rows)])
        low, high = np.zeros(width), np.zeros(width)
        total = rows[-1]["n"] if -1 in rows else 0
        for at in range(width):
            if at in rows and rows[at]["n"]:
                shorter = rows[at]["n"] < total  # shorter vectors have a zero here
                low[at], high[at] = (min(rows[at]["low"], 0), max(rows[at]["high"], 0)) if shorter else (rows[at]["low"], rows[at]["high"])
        drawn = self.entries.where(F.pmod(F.xxhash64("entry", F.lit(2)), F.lit(max(1, -(-n_entries // EDGE_ROWS)))) == 0).select("v")
        sample = matrix(pa.array([r["v"] for r in drawn.collect()], pa.list_(pa.float64())), width)  # about EDGE_ROWS
        return Grid.over(low, high, sample)

    def _cells(self) -> DataFrame:
        grid = self.grid

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    own = grid.cells(matrix(batch.column(2), len(grid.edges)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in own], pa.binary())], ["entry", "sure", "cell"])

        return self.entries.select("entry", "sure", "v").mapInArrow(run, "entry long, sure boolean, cell binary")

    def _meetings(self, queries: DataFrame, extra: list[str]) -> DataFrame:
        """Each block of the file with each block of queries (asked, v, and ``extra``)."""
        spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(n)).cast("int")
        n_queries = max(1, -(-queries.count() // self.query_block))
        over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.select(F.lit(0).alias("side"), F.col("asked").alias("entry"), "v", *extra, spread("asked", n_queries).alias("q")).withColumn("d", over(self.blocks))
        right = self.file.select(F.lit(1).alias("side"), "entry", "sure", "cell", spread("entry", self.blocks).alias("d")).withColumn("q", over(n_queries))
        return left.unionByName(right, allowMissingColumns=True).groupBy("q", "d")

    def _bounds(self, table: pa.Table) -> Iterator[tuple]:
        """(queries' part of the table, data's, least scores, most scores) for some queries at a time."""
        side = table.column("side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not len(a) or not len(b):
            return
        cell = np.frombuffer(b"".join(b.column("cell").to_pylist()), np.uint8).reshape(len(b), -1)
        q = matrix(a.column("v"), len(self.grid.edges))
        middle, half = self.grid.of(cell, q)
        for i in range(0, len(q), ROWS):
            part = q[i : i + ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                score, slack = part @ middle, np.abs(part) @ half
                low, high = score - slack, score + slack
            low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
            yield a.slice(i, len(part)), b, low, high

    def floors(self, queries: DataFrame) -> DataFrame:
        """(asked, floor): a score that k + 1 ids reach for certain; no row where there are fewer."""
        kernel = _Scan(self)
        lower = self._meetings(queries, []).applyInArrow(lambda table: kernel.lower(table), "asked long, lower double")
        ranked = lower.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("lower"))))
        return ranked.where(F.col("r") == self.k + 1).select("asked", F.col("lower").alias("floor"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(asked, entry, upper) of all entries whose upper bound reaches the query's floor."""
        bounded = materialize(queries.join(self.floors(queries), "asked", "left"), "floors")
        kernel = _Scan(self)
        return self._meetings(bounded, ["floor"]).applyInArrow(lambda table: kernel.upper(table), "asked long, entry long, upper double")

    def read(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(asked, id, score) of pairs (asked, entry), from exact vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    q, v = matrix(batch.column(1)), matrix(batch.column(2))
                    width = max(q.shape[1], v.shape[1])
                    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(exact_scores(q, v))], ["asked", "ids", "score"])

        met = pairs.select("asked", "entry").join(self.entries.select("entry", "v", "ids"), "entry").join(queries.select("asked", F.col("v").alias("qv")), "asked")
        scored = met.select("asked", "qv", "v", "ids").mapInArrow(run, "asked long, ids array<long>, score long")
        return scored.select("asked", F.explode("ids").alias("id"), "score").groupBy("asked", "id").agg(F.max("score").alias("score"))

    def best(self, scored: DataFrame) -> DataFrame:
        """The k + 1 first of each query, with their rank ``r``."""
        order = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
        return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.k + 1)

    def search(self, is_query) -> DataFrame:
        """query_id, rank, vec_id, score; ``is_query`` is a condition on the column ``id``."""
        own = self.vectors.where(is_query).join(self.entries.select("entry", F.col("v").alias("ev")), F.col("v") == F.col("ev"))
        asked = materialize(own.select(F.col("id").alias("query_id"), F.col("entry").alias("asked")), "asked")
        queries = materialize(self.entries.join(asked.select(F.col("asked").alias("entry")).distinct(), "entry", "left_semi").select(F.col("entry").alias("asked"), "v"), "queries")
        found = self.candidates(queries)
        found = materialize(found.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("upper"), "entry"))), "candidates")
        nearest = F.col("r") <= FIRST * (self.k + 1)
        first = materialize(self.best(self.read(found.where(nearest), queries)).drop("r"), "first")
        certain = self.best(first).where(F.col("r") == self.k + 1).select("asked", F.col("score").alias("least"))
        rest = found.where(~nearest).join(certain, "asked", "left").where("least is null or upper >= least")
        every = self.best(first.unionByName(self.read(rest, queries)).groupBy("asked", "id").agg(F.max("score").alias("score")))
        told = asked.join(every.drop("r"), "asked").where("id <> query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
        ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


class _Scan:
    """The kernels of the two scans; holds only what they need, since it travels to the tasks."""

    def __init__(self, of: VectorFile):
        self.grid, self.k = of.grid, of.k

    _bounds = VectorFile._bounds

    def lower(self, table: pa.Table) -> pa.Table:
        ids, low = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b, least, _ in self._bounds(table):
            least = least[:, b.column("sure").to_numpy(zero_copy_only=False).astype(bool)]
            n = min(self.k + 1, least.shape[1])
            if n:
                top = np.partition(least, least.shape[1] - n, axis=1)[:, -n:]
                ids.append(np.repeat(a.column("entry").to_numpy(), n))
                low.append(top.ravel())
        return pa.table({"asked": np.concatenate(ids), "lower": np.concatenate(low)})

    def upper(self, table: pa.Table) -> pa.Table:
        ids, entries, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b, _, most in self._bounds(table):
            floor = np.array([-np.inf if x is None else x for x in a.column("floor").to_pylist()])
            r, c = np.nonzero(most >= floor[:, None])
            ids.append(a.column("entry").to_numpy()[r])
            entries.append(b.column("entry").to_numpy()[c])
            high.append(most[r, c])
        return pa.table({"asked": np.concatenate(ids), "entry": np.concatenate(entries), "upper": np.concatenate(high)})


def top_k(rows: DataFrame, is_query, k: int = K, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on the column ``id``."""
    return VectorFile(rows, k, id_column, vector, block, query_block).search(is_query)
