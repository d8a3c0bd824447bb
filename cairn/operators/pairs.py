"""All-pairs work on vectors in blocks: distances are made, reduced and dropped inside a task.

Rows are dealt to a few large blocks (:func:`sides`) by a hash of their id. Each ordered pair of blocks
is one task, which meets in tiles of ``block`` rows: a kernel gets a tile of the first block and all
tiles of the second, and returns rows for the first only, already reduced over the second (sums by
label, nearest k, counts). A row is sent once for each block, not for each tile. Nothing of the size
of all pairs is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.vectors import distances, matrix
from cairn.operators import rings
from cairn.operators.quantiles import exact_quantiles
from cairn.runtime import materialize

BLOCK = 2048
#: Gets a tile of left rows and the tiles of right rows that it meets.
Kernel = Callable[[pa.Table, list[pa.Table]], pa.Table]


def held(rows: DataFrame) -> DataFrame:
    """``rows`` as a table of the shared folder; as they are if they already are one."""
    return rows if getattr(rows, "_cairn_path", None) else materialize(rows, "block-rows")


def block_pairs(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, block: int = BLOCK, within: float | None = None, part: int = rings.PART_ROWS) -> DataFrame:
    """``kernel(a tile of a left block, the tiles of a right block)`` for every pair of blocks. Both frames have ``id``.

    They are written once, so that counting and pairing read a table instead of working it out again. With
    ``within``, only pairs of rows up to this Euclidean distance matter: tiles that are farther apart don't meet.
    ``part`` is the most rows that a block may have.
    """
    same = right is left
    left = held(left)
    right = left if same else held(right)
    counts = [df.count() for df in (left, right)]
    if within is not None and min(counts) > block:
        points = rings.reference_points(left)
        own = rings.deal(left, points, block)
        other = own if same else rings.deal(right, points, block)
        return rings.meet(own, other, np.full(len(own.number), within), kernel, schema, block)
    n_left, n_right = (rings.sides(n, block, part) for n in counts)
    seat = lambda n: F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select(F.lit(0).alias("side"), *left.columns).withColumn("bl", seat(n_left)).withColumn("br", others(n_right))
    b = right.select(F.lit(1).alias("side"), *right.columns).withColumn("br", seat(n_right)).withColumn("bl", others(n_left))

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        one, two = (rings.tiles(table.filter(pa.array(side == k)), block) for k in (0, 1))
        return pa.concat_tables([kernel(x, two) for x in one])

    return a.unionByName(b, allowMissingColumns=True).groupBy("bl", "br").applyInArrow(meet, schema)


def vectors_of(rows: DataFrame, key: str, vector: str, *extra: str) -> DataFrame:
    """(id, v, extra...) of rows with a key and a vector."""
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), *extra)


def label_sums(rows: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """For rows (id, v, run_id, cluster): (id, run_id, other, n, total): to each cluster of the run, how many
    rows and the sum of the distances. Distances are made once for all runs."""
    spark = rows.sparkSession
    rows = held(rows.select("id", "v", "run_id", "cluster"))
    known = sorted(tuple(r) for r in rows.groupBy("run_id", "cluster").agg(F.count("*").alias("n")).collect())  # a row for each cluster of each run
    names = {run: x for x, run in enumerate(sorted({r for r, _, _ in known}))}
    run_of = np.array([names[r] for r, _, _ in known], np.int64)
    numbered = spark.createDataFrame([(*k, x) for x, k in enumerate(known)], "run_id string, cluster long, n long, code int")
    coded = rows.join(F.broadcast(numbered.drop("n")), ["run_id", "cluster"])  # as above
    boxed = coded.groupBy("id").agg(F.first("v").alias("v"), F.collect_list("code").alias("codes"))

    def kernel(a: pa.Table, tiles: list[pa.Table]) -> pa.Table:
        x, ids = matrix(a.column("v")), a.column("id").to_numpy()
        total, met = np.zeros((len(a), len(known))), np.zeros(len(known), bool)
        for b in tiles:
            if len(a) and len(b):
                at, code = _flat(b.column("codes"))
                here, seat = np.unique(code, return_inverse=True)
                total[:, here] += label_totals(distances(x, matrix(b.column("v")), metric), at, seat, run_of[here])
                met[here] = True
        at, code = _flat(a.column("codes"))
        takes = np.zeros((len(a), len(names)), bool)
        takes[at, run_of[code]] = True
        i, c = np.nonzero(takes[:, run_of] & met)
        return pa.table({"id": ids[i], "code": c.astype(np.int32), "total": total[i, c]})

    sums = block_pairs(boxed, boxed, kernel, "id long, code int, total double", block).groupBy("id", "code").agg(F.sum("total").alias("total"))
    return sums.join(F.broadcast(numbered), "code").select("id", "run_id", F.col("cluster").alias("other"), "n", "total")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists."""
    own = lists.combine_chunks()
    return np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()


def label_totals(d: np.ndarray, at: np.ndarray, seat: np.ndarray, run_of: np.ndarray) -> np.ndarray:
    """For each row of ``d`` and each label its sum over the columns ``at`` that have the label ``seat``; ``run_of`` are the labels' runs."""
    runs = np.unique(run_of)
    if len(run_of) <= 24 * len(runs):
        hot = np.zeros((d.shape[1], len(run_of)))
        np.add.at(hot, (at, seat), 1)
        out = d @ hot
        if np.isfinite(out).all():  # else a row's infinity would be in all sums
            return out
    out = np.zeros((len(d), len(run_of)))
    for run in runs:  # columns in the order of their label, summed where it changes
        own = np.flatnonzero(run_of[seat] == run)
        own = own[np.argsort(seat[own], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], np.diff(seat[own]) != 0]))
        out[:, seat[own][first]] = np.add.reduceat(d[:, at[own]], first, axis=1)
    return out


def nearest(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean", skip_own: bool = True, block: int = BLOCK) -> DataFrame:
    """(id, rank, other, distance): the k nearest right rows of each left row; ties to the smaller id.

    Neighbours inside one frame of several blocks are looked for in blocks of near rows (:mod:`rings`), which meet
    only those that can hold a nearer row than the block's own kth neighbours.
    """

    def kernel(a: pa.Table, tiles: list[pa.Table]) -> pa.Table:
        x, i = matrix(a.column("v")), a.column("id").to_numpy()
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # row, other, distance of the k nearest so far
        limit = np.full(len(a), np.inf)
        for b in tiles if len(a) else []:
            if not len(b):
                continue
            d, j = distances(x, matrix(b.column("v")), metric), b.column("id").to_numpy()
            if skip_own:
                for c in np.flatnonzero(np.isin(j, i)):
                    d[i == j[c], c] = np.inf
            most = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1]) if len(b) > k and not np.isfinite(limit).all() else limit
            p, q = np.nonzero(d <= most[:, None])
            value = d[p, q]
            keep = np.isfinite(value)
            p, other, value = (np.concatenate([was, new[keep]]) for was, new in zip(best, (p, j[q], value)))
            order = np.lexsort((other, value, p))
            first = np.searchsorted(p[order], p[order])
            order = order[np.arange(len(order)) - first < k]
            best = p[order], other[order], value[order]
            have = np.bincount(best[0], minlength=len(a))
            limit = np.full(len(a), np.inf)
            full = np.flatnonzero(have == k)
            limit[full] = best[2][np.cumsum(have)[full] - 1]
        return pa.table({"id": i[best[0]], "other": best[1], "distance": best[2]})

    schema = "id long, other long, distance double"
    if left is right and skip_own and (rows := held(left)).count() > block:
        own = rings.deal(rows, rings.reference_points(rows, metric=metric), block, metric)
        found = rings.meet(own, own, rings.worst_neighbour(own, k, metric, block), kernel, schema, block)
    else:
        found = block_pairs(left, right, kernel, schema, block)
    order = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("id", "rank", "other", "distance")


def k_distance(rows: DataFrame, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(id, distance) to the min_samples-th neighbour, a row being its own first."""
    if min_samples <= 1:
        return rows.select("id", F.lit(0.0).alias("distance"))
    return nearest(rows, rows, min_samples - 1, block=block).where(F.col("rank") == min_samples - 1).select("id", "distance")


def nearest_centroid(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster, distance) by the closest of a few centroids (cluster, c); ties to the smaller cluster."""
    got = sorted((r["cluster"], list(r["c"])) for r in centroids.collect())
    names, points = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.float64)

    def run(batches):
        for batch in batches:
            if len(batch):
                d = distances(matrix(batch.column(1)), points)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[at]), pa.array(d[np.arange(len(d)), at])], ["id", "cluster", "distance"])

    return rows.select("id", "v").mapInArrow(run, "id long, cluster long, distance double")


def metric_diagnostics(rows: DataFrame, metrics=("euclidean", "manhattan"), ranks=(1, 5), block: int = BLOCK) -> DataFrame:
    """(metric, rank, mean, median, q95) of the distances to the first and fifth neighbour."""
    out = None
    for metric in metrics:
        own = materialize(nearest(rows, rows, max(ranks), metric, block=block).where(F.col("rank").isin(*ranks)), "neighbours")
        q = exact_quantiles(own, ["rank"], "distance", [0.5, 0.95]).select("rank", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("q95"))
        table = own.groupBy("rank").agg(F.avg("distance").alias("mean")).join(q, "rank").select(F.lit(metric).alias("metric"), "rank", "mean", "median", "q95")
        out = table if out is None else out.unionByName(table)
    return out


def whiten(rows: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Rows turned so that Euclidean distance is the Mahalanobis distance under their own covariance."""
    from cairn.operators.scaling import apply_pca, mean_and_covariance

    mean, covariance, _ = mean_and_covariance(rows)
    covariance = covariance + ridge * np.eye(len(mean))
    values, vectors = np.linalg.eigh(np.linalg.pinv(covariance))
    return apply_pca(rows, mean, (vectors * np.sqrt(np.maximum(values, 0))).T, len(mean))
