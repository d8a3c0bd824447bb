"""Blocks of near rows: reference points, distance rings, and the block pairs that the triangle inequality leaves.

A few rows far apart are reference points. A row's cell is its nearest reference point; rows are cut
into blocks by ranges of (cell, distance to it, id), and a block knows the least and largest distance
of its rows to every reference point. Two rows are at least as far apart as their blocks' intervals
are for any reference point, so pairs of blocks beyond a limit are dropped before they are dealt.

Intervals of all blocks (at most ``MAX_BLOCKS``) go to every task, lists of partners never to the
driver. Larger tables get larger blocks, which meet in tiles. Both metrics obey the inequality.

Blocks travel in runs of neighbouring ones (:func:`sides`), so that a row is sent once for each run that
holds a partner and not for each partner; which blocks meet is settled inside the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.functions.vectors import distances, matrix
from cairn.operators.cleaning import hash_order
from cairn.runtime import materialize

REFERENCES, DRAWN = 12, 300
MAX_BLOCKS = 20_000
#: Parts that a table is cut into for meeting another, if they have at most ``PART_ROWS`` rows; more parts otherwise.
SIDES, PART_ROWS = 12, 65_536
#: Rounding of distances may differ by this part between passes.
SLACK = 1e-7


@dataclass
class Blocks:
    """A table with the column ``_block``, and for each block its number, intervals and rows."""

    table: DataFrame
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray


def reference_points(rows: DataFrame, count: int = REFERENCES, metric: str = "euclidean", seed: int = 42) -> np.ndarray:
    """``count`` of ``DRAWN`` hashed rows, each the farthest from those before."""
    got = rows.select("id", "v").orderBy(hash_order(F.col("id"), seed), "id").limit(DRAWN).collect()
    x = np.array([r["v"] for r in got], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    chosen = [0]
    best = distances(x, x[:1], metric)[:, 0]
    while len(chosen) < min(count, len(x)) and best.max() > 0:
        chosen.append(int(best.argmax()))
        best = np.minimum(best, distances(x, x[chosen[-1:]], metric)[:, 0])
    return x[chosen]


def deal(rows: DataFrame, points: np.ndarray, block: int, metric: str = "euclidean") -> Blocks:
    """``rows`` (id, v, ...) in blocks of about ``block`` rows."""
    names = rows.columns
    at = names.index("v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(at)), points, metric) if len(batch) else np.zeros((0, len(points)))
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            ring = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(points)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), ring], [*names, "_cell", "_near", "_ring"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_near", T.DoubleType()), T.StructField("_ring", T.ArrayType(T.DoubleType()))])
    n_blocks = max(1, min(MAX_BLOCKS, -(-rows.count() // block)))
    ranged = rows.mapInArrow(place, schema).repartitionByRange(n_blocks, "_cell", "_near", "id")
    table = materialize(ranged.withColumn("_block", F.spark_partition_id()).drop("_cell", "_near"), "blocks")
    ends = table.select("_block", F.posexplode("_ring").alias("p", "d")).groupBy("_block", "p").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    got = ends.collect()  # MAX_BLOCKS by REFERENCES at most
    number = np.array(sorted({r["_block"] for r in got}), np.int64)
    seat = {b: k for k, b in enumerate(number.tolist())}
    low, high, size = np.zeros((len(number), len(points))), np.zeros((len(number), len(points))), np.zeros(len(number), np.int64)
    for r in got:
        k = seat[r["_block"]]
        low[k, r["p"]], high[k, r["p"]], size[k] = r["low"], r["high"], r["n"]
    return Blocks(table.drop("_ring"), number, low, high, size)


def apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least distance from one block (intervals) to each of many."""
    gap = np.maximum(low - other_high, other_low - high)
    return np.maximum(gap, 0).max(axis=1, initial=0.0)


def partners(own: Blocks, other: Blocks, limit: np.ndarray, by_own: bool) -> DataFrame:
    """(_block, _other): for each block of ``own`` those of ``other`` that are within the limit; limits belong to
    the blocks of ``own`` (``by_own``) or of ``other``."""
    spark = own.table.sparkSession
    known = spark.sparkContext.broadcast((own.number, own.low, own.high, other.number, other.low, other.high, limit))  # intervals of MAX_BLOCKS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high, far_number, far_low, far_high, most = known.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                near = apart(low[k], high[k], far_low, far_high) <= (most[k] if by_own else most) * (1 + SLACK) + SLACK
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), number[k]), pa.int32()), pa.array(far_number[near], pa.int32())], ["_block", "_other"])

    return spark.range(len(own.number)).mapInArrow(run, "_block int, _other int")


def sides(n: int, block: int, part: int = PART_ROWS) -> int:
    """Parts for ``n`` rows that meet all parts of another table: a row is sent once for each of those."""
    return max(1, min(-(-n // block), SIDES), -(-n // part))


def tiles(table: pa.Table, tile: int) -> list[pa.Table]:
    return [table.slice(k, tile) for k in range(0, max(len(table), 1), tile)]


def _runs(blocks: Blocks, tile: int) -> np.ndarray:
    """The part of each block: runs of neighbouring blocks with about as many rows."""
    n = int(blocks.size.sum())
    return ((np.cumsum(blocks.size) - blocks.size) * sides(n, tile) // max(n, 1)).astype(np.int64)


def meet(left: Blocks, right: Blocks, limit: np.ndarray, kernel: Callable[[pa.Table, list[pa.Table]], pa.Table], schema: str, tile: int) -> DataFrame:
    """``kernel`` on each tile of at most ``tile`` rows of a left block and the tiles of the right blocks within the left block's limit."""
    spark = left.table.sparkSession
    runs = [_runs(side, tile) for side in (left, right)]
    known = spark.sparkContext.broadcast((left.number, left.low, left.high, right.number, right.low, right.high, limit))  # intervals of MAX_BLOCKS at most
    part_of = [spark.createDataFrame([(int(b), int(r)) for b, r in zip(side.number, own)], "_block int, _part int") for side, own in zip((left, right), runs)]

    def span(side: Blocks, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.unique(own)
        return np.array([side.low[own == p].min(axis=0) for p in parts]), np.array([side.high[own == p].max(axis=0) for p in parts])

    met = []
    if len(left.number) and len(right.number):
        (low, high), (far_low, far_high) = (span(*x) for x in zip((left, right), runs))
        far_parts = np.unique(runs[1])
        for k, p in enumerate(np.unique(runs[0])):
            near = apart(low[k], high[k], far_low, far_high) <= limit[runs[0] == p].max() * (1 + SLACK) + SLACK
            met += [(int(p), int(q)) for q in far_parts[near]]
    pairs = F.broadcast(spark.createDataFrame(met, "bl int, br int"))  # parts by parts
    a = left.table.join(F.broadcast(part_of[0]), "_block").withColumn("side", F.lit(0)).withColumnRenamed("_part", "bl").join(pairs, "bl")
    b = right.table.join(F.broadcast(part_of[1]), "_block").withColumn("side", F.lit(1)).withColumnRenamed("_part", "br").join(pairs, "br")

    def blocks_of(table: pa.Table) -> dict[int, list[pa.Table]]:
        own = table.column("_block").to_numpy()
        order = np.argsort(own, kind="stable")
        table, own = table.take(pa.array(order)), own[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        return {int(own[x]): tiles(table.slice(x, y - x), tile) for x, y in zip(first, [*first[1:], len(own)])}

    def work(table: pa.Table) -> pa.Table:
        number, low, high, far_number, far_low, far_high, most = known.value
        side = table.column("side").to_numpy()
        one, two = (blocks_of(table.filter(pa.array(side == k))) for k in (0, 1))
        seats = {b: k for k, b in enumerate(number.tolist())}
        far = np.flatnonzero(np.isin(far_number, list(two)))
        out = [kernel(table.slice(0, 0), [])]
        for block, own in one.items():
            k = seats[block]
            near = apart(low[k], high[k], far_low[far], far_high[far]) <= most[k] * (1 + SLACK) + SLACK
            partners = [t for b in far_number[far[near]].tolist() for t in two[b]]
            if partners:
                out += [kernel(x, partners) for x in own]
        return pa.concat_tables(out)

    return a.unionByName(b, allowMissingColumns=True).groupBy("bl", "br").applyInArrow(work, schema)


def pairs_met(own: Blocks, other: Blocks, limit: np.ndarray) -> tuple[int, int]:
    """(pairs of blocks within the limits, all pairs)."""
    return partners(own, other, limit, True).count(), len(own.number) * len(other.number)


def worst_neighbour(own: Blocks, k: int, metric: str, tile: int) -> np.ndarray:
    """For each block the largest distance of a row to its ``k``-th neighbour inside the block; infinite where rows are too few."""

    def kernel(table: pa.Table) -> pa.Table:
        n = len(table)
        worst = np.inf
        if n > k:
            x, worst = matrix(table.column("v")), 0.0
            for at in range(0, n, tile):
                rows, best = x[at : at + tile], None
                for to in range(0, n, tile):
                    d = distances(rows, x[to : to + tile], metric)
                    d = d if best is None else np.concatenate([best, d], axis=1)
                    best = np.partition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k + 1 else d
                worst = max(worst, float(best.max(axis=1).max()))  # a row itself is one of k + 1
        return pa.table({"_block": pa.array([table.column("_block")[0].as_py()], pa.int32()), "worst": pa.array([worst], pa.float64())})

    got = {r["_block"]: r["worst"] for r in own.table.select("_block", "v").groupBy("_block").applyInArrow(kernel, "_block int, worst double").collect()}  # a row for each block
    return np.array([got.get(b, np.inf) for b in own.number.tolist()])
