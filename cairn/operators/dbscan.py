"""DBSCAN over all rows, for a grid of settings at once: neighbour counts in blocks, then components of core points.

A pair of blocks makes its distances once for all settings, tile by tile, and works on the pairs within the largest
radius. It counts neighbours for every radius; then it reports, for each setting, a spanning forest of the links
between core points within the radius, one for all tiles. Label rounds join the forests of all settings together. Clusters are numbered by their smallest core row; a border row goes
to the neighbouring cluster with the smallest number; the rest is noise (-1).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.vectors import distances, matrix
from cairn.operators import rings
from cairn.operators.cleaning import dense_key
from cairn.operators.components import connected
from cairn.operators.pairs import BLOCK, block_pairs, held, nearest
from cairn.operators.quantiles import exact_quantiles
from cairn.runtime import materialize, sweep

#: Parts whose core points are joined first, if they have at most ``rings.PART_ROWS`` rows; more parts otherwise.
PARTS = 4


def _near(a: np.ndarray, b: pa.Table, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the pairs up to ``most``."""
    d = distances(a, matrix(b.column("v"))) if len(a) and len(b) else np.zeros((0, 0))
    p, q = np.nonzero(d <= most)
    return p, q, d[p, q]


def neighbour_counts(rows: DataFrame, radii: Sequence[float], block: int = BLOCK) -> DataFrame:
    """(id, e, n) of rows within each radius (e: its number), itself included."""
    order = np.argsort(radii, kind="stable")
    ascending = np.array(radii, np.float64)[order]

    def kernel(a: pa.Table, tiles: list[pa.Table]) -> pa.Table:
        x, n = matrix(a.column("v")), np.zeros((len(a), len(radii)), np.int64)
        for b in tiles:
            p, _, d = _near(x, b, ascending[-1])
            first = np.searchsorted(ascending, d)  # the smallest radius that holds the pair
            n += np.bincount(p * len(radii) + first, minlength=n.size).reshape(n.shape)
        n = n.cumsum(axis=1)
        return pa.table({"id": np.tile(a.column("id").to_numpy(), len(radii)), "e": np.repeat(order, len(a)), "n": n.T.ravel()})

    return block_pairs(rows, rows, kernel, "id long, e long, n long", block, max(radii)).groupBy("id", "e").agg(F.sum("n").alias("n"))


def join_links(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of ``label`` (each node's smallest node) by the links, in place."""
    while True:
        u, v = label[u], label[v]
        apart = u != v
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _cores(column: pa.ChunkedArray, settings: int) -> np.ndarray:
    """Which rows are core points of which setting."""
    out = np.zeros((settings, len(column)), bool)
    own = column.combine_chunks()
    out[own.flatten().to_numpy(), np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))] = True
    return out


def _local_roots(core: DataFrame, radii: Sequence[float], n: int, block: int) -> DataFrame:
    """(id, at, v, core, root): rows are dealt to a few parts, and for each setting of ``core`` the node of the first core
    point that a row reaches inside its part. What follows links components of parts, which are far fewer than rows."""
    rows = core.count()
    parts = max(min(PARTS, -(-rows // block)), -(-rows // rings.PART_ROWS), 1)

    def work(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["part"]).combine_chunks()
        place, own, list_of = table.column("at").to_numpy(), _cores(table.column("core"), len(radii)), table.column("core").combine_chunks()
        labels = np.tile(np.arange(len(table)), (len(radii), 1))
        cut = rings.tiles(table, block)
        for i, x in enumerate(cut):
            left = matrix(x.column("v"))
            for j in range(i, len(cut)):
                p, q, d = _near(left, cut[j], max(radii))
                p, q = p + i * block, q + j * block
                for s, eps in enumerate(radii):
                    near = (d <= eps) & own[s, p] & own[s, q]
                    join_links(labels[s], p[near], q[near])
        s, row = list_of.flatten().to_numpy(), np.repeat(np.arange(len(table)), np.diff(list_of.offsets.to_numpy()))
        return table.append_column("root", pa.ListArray.from_arrays(list_of.offsets, pa.array(s * n + place[labels[s, row]])))

    dealt = core.select("id", "at", "v", "core", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInArrow(work, "id long, at long, v array<double>, core array<long>, root array<long>")


def _core_links(core: DataFrame, radii: Sequence[float], block: int) -> DataFrame:
    """Links (u, v) between the ``root`` nodes of core points (v, core, root) of :func:`_local_roots`."""

    def kernel(a: pa.Table, tiles: list[pa.Table]) -> pa.Table:
        x, sides = matrix(a.column("v")), [a, *tiles]
        known, flat = np.unique(np.concatenate([t.column("root").combine_chunks().flatten().to_numpy() for t in sides]), return_inverse=True)
        seats, start = [], 0
        for t in sides:
            own = t.column("core").combine_chunks()
            s, seat = own.flatten().to_numpy(), np.full((len(radii), len(t)), -1)
            seat[s, np.repeat(np.arange(len(t)), np.diff(own.offsets.to_numpy()))] = flat[start : start + len(s)]
            start += len(s)
            seats.append(seat)
        ends = [(int(own.min(initial=len(known), where=own >= 0)), int(own.max(initial=-1)) + 1) for own in (np.concatenate([t[s] for t in seats]) for s in range(len(radii)))]
        label = np.arange(len(known))
        for b, seat in zip(tiles, seats[1:]):
            p, q, d = _near(x, b, max(radii))
            for s, eps in enumerate(radii):
                u, v = seats[0][s, p], seat[s, q]
                near = (d <= eps) & (u >= 0) & (v >= 0)
                low, high = ends[s]  # a setting's nodes stand together
                own = label[low:high] - low
                join_links(own, u[near] - low, v[near] - low)
                label[low:high] = own + low
        moved = np.flatnonzero(label != np.arange(len(known)))
        return pa.table({"u": known[label[moved]], "v": known[moved]})

    return block_pairs(core, core, kernel, "u long, v long", block, max(radii))


def fit(rows: DataFrame, settings: Sequence[tuple[float, int]], block: int = BLOCK) -> DataFrame:
    """(id, s, cluster, core) of every row (id, v) under every setting (eps, min_samples), numbered from 0."""
    rows = held(rows.select("id", "v"))
    spark = rows.sparkSession
    radii = [eps for eps, _ in settings]
    distinct = sorted(set(radii))
    counts = materialize(neighbour_counts(rows, distinct, block), "neighbours")
    sweep(spark)  # each pass over the pairs has sent all rows
    wanted = spark.createDataFrame([(s, distinct.index(eps), least) for s, (eps, least) in enumerate(settings)], "s long, e long, least long")
    is_core = counts.join(F.broadcast(wanted), "e").where(F.col("n") >= F.col("least")).select("id", "s")  # a row for each setting
    n = rows.count()
    placed = materialize(dense_key(rows, ["id"], "at"), "placed")
    core = materialize(placed.join(is_core.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("core")), "id"), "core")
    core = materialize(_local_roots(core, radii, n, block), "core")
    roots = connected(_core_links(core, radii, block))
    sweep(spark)
    nodes = core.select("id", F.explode(F.arrays_zip("core", "root")).alias("z")).select("id", F.col("z.core").alias("s"), F.col("z.root").alias("node"))
    named = materialize(nodes.join(roots, "node", "left").select("id", "s", F.coalesce("root", "node").alias("root")), "named")
    order = named.groupBy("s", "root").agg(F.min("id").alias("first"))
    numbers = order.withColumn("cluster", (F.row_number().over(Window.partitionBy("s").orderBy("first")) - 1).cast("long")).drop("first")  # a row for each cluster
    labelled = materialize(named.join(numbers, ["s", "root"]).select("id", "s", "cluster"), "labels")

    def border(a: pa.Table, tiles: list[pa.Table]) -> pa.Table:
        x, mine, none = matrix(a.column("v")), _cores(a.column("core"), len(radii)), np.iinfo(np.int64).max
        least = np.full(mine.shape, none)
        for b in tiles:
            p, q, d = _near(x, b, max(radii))
            own = b.column("labels").combine_chunks()
            theirs = np.full((len(radii), len(b)), none)
            if len(b):
                theirs[own.flatten().field("s").to_numpy(), np.repeat(np.arange(len(b)), np.diff(own.offsets.to_numpy()))] = own.flatten().field("cluster").to_numpy()
            for s, eps in enumerate(radii):
                at = (d <= eps) & ~mine[s, p]
                np.minimum.at(least[s], p[at], theirs[s, q[at]])
        s, i = np.nonzero(least < none)
        return pa.table({"id": a.column("id").to_numpy()[i], "s": s, "cluster": least[s, i]})

    every = placed.join(core.select("id", "core"), "id", "left").select("id", "v", F.coalesce("core", F.array().cast("array<long>")).alias("core"))
    known = core.select("id", "v").join(labelled.groupBy("id").agg(F.collect_list(F.struct("s", "cluster")).alias("labels")), "id")
    edge = block_pairs(every, known, border, "id long, s long, cluster long", block, max(radii)).groupBy("id", "s").agg(F.min("cluster").alias("cluster"))
    found = labelled.withColumn("core", F.lit(True)).unionByName(edge.withColumn("core", F.lit(False)))
    whole = rows.select("id").crossJoin(F.broadcast(wanted.select("s")))  # rows by settings: the result
    return whole.join(found, ["id", "s"], "left").select("id", "s", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def dbscan(rows: DataFrame, eps: float, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(id, cluster, core)."""
    return fit(rows, [(eps, min_samples)], block).drop("s")


def eps_grids(rows: DataFrame, min_samples: Sequence[int], quantiles=(0.85, 0.90, 0.95, 0.97, 0.99), block: int = BLOCK) -> dict[int, list[float]]:
    """For each number of samples the distinct quantiles of the distances to that neighbour (a row being its own first), from one pass."""
    out = {m: [0.0] for m in min_samples if m <= 1}
    ranks = [m - 1 for m in min_samples if m > 1]
    if ranks:
        near = nearest(rows, rows, max(ranks), block=block).where(F.col("rank").isin(ranks))
        for r in exact_quantiles(materialize(near, "neighbours"), ["rank"], "distance", quantiles).collect():  # a row for each number
            out[r["rank"] + 1] = sorted(set(r["q"]))
    return out


def eps_grid(rows: DataFrame, min_samples: int, quantiles=(0.85, 0.90, 0.95, 0.97, 0.99), block: int = BLOCK) -> list[float]:
    return eps_grids(rows, [min_samples], quantiles, block).get(min_samples, [])


def search(rows: DataFrame, min_samples=(10, 20, 30), quantiles=(0.85, 0.90, 0.95, 0.97, 0.99), block: int = BLOCK) -> DataFrame:
    """(id, run_id, cluster) for every configuration; run_id is min_samples/eps."""
    rows = held(rows)
    grids = eps_grids(rows, min_samples, quantiles, block)
    settings = [(eps, m) for m in min_samples for eps in grids.get(m, [])]
    if not settings:
        return rows.sparkSession.createDataFrame([], "id long, run_id string, cluster long")
    names = F.array(*(F.lit(f"{m}/{eps:.9g}") for eps, m in settings))
    return fit(rows, settings, block).select("id", F.get(names, F.col("s").cast("int")).alias("run_id"), "cluster")


def choose(table: DataFrame) -> DataFrame:
    """The preferred configuration of (run_id, n_clusters, noise_fraction, silhouette): of those with two
    clusters, under 95 % noise and a silhouette the best one (then least noise); else most clusters, least noise."""
    good = (F.col("n_clusters") >= 2) & (F.col("noise_fraction") < 0.95) & F.col("silhouette").isNotNull()
    marked = table.withColumn("fallback", ~good)
    order = (F.col("fallback"), F.desc(F.when(good, F.col("silhouette"))), F.desc(F.when(~good, F.col("n_clusters"))), F.col("noise_fraction"), F.col("run_id"))
    return marked.orderBy(*order).limit(1)
