"""Pairs in blocks: how often rows are sent, sums and neighbours against brute force, and what follows from counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import runtime
from cairn.functions.vectors import distances
from cairn.operators import agreement, dbscan, kmeans, metrics, pairs, rings, tendency
from cairn.runtime import ship


def frame(spark, x):
    ship(spark)
    return spark.createDataFrame([(i, [float(q) for q in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)


def test_a_row_is_sent_once_for_each_part_not_for_each_block(spark):
    assert rings.sides(600_000, 2048) <= rings.SIDES and rings.sides(100, 2048) == 1
    rows = frame(spark, np.arange(400, dtype=float)[:, None])

    def kernel(a, tiles):
        return a.select(["id"])

    got = pairs.block_pairs(rows, rows, kernel, "id long", block=8)
    assert got.count() == 400 * rings.SIDES  # 50 blocks of 8
    own = rings.deal(rows, rings.reference_points(rows), 8)
    met = rings.meet(own, own, np.full(len(own.number), np.inf), kernel, "id long", 8)
    assert met.count() == 400 * rings.SIDES


def test_sums_and_neighbours_of_many_tiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    x[20:30] = x[20]
    cluster = {"a": rng.integers(0, 3, 150), "b": rng.integers(0, 90, 150)}
    d = distances(x, x)
    rows = frame(spark, x)
    labels = spark.createDataFrame([(i, r, int(c)) for r, own in cluster.items() for i, c in enumerate(own)], "id long, run_id string, cluster long")
    for r in pairs.label_sums(rows.join(labels, "id"), block=9).collect():
        own = cluster[r["run_id"]] == r["other"]
        assert r["n"] == own.sum() and r["total"] == pytest.approx(d[r["id"], own].sum(), abs=1e-9)
    np.fill_diagonal(d, np.inf)
    got = pairs.nearest(rows, rows, 4, block=9).orderBy("id", "rank").collect()
    for i in range(150):
        want = np.lexsort((np.arange(150), d[i].round(12)))[:4]
        assert [r["other"] for r in got[4 * i : 4 * i + 4]] == want.tolist()


def test_dbscan_joins_parts(spark, monkeypatch):
    """A chain of near rows that lies in all parts is one cluster."""
    monkeypatch.setattr(dbscan, "PARTS", 3)
    x = np.concatenate([np.arange(60.0), 500 + np.arange(30.0)])[:, None]
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan(frame(spark, x), 1.5, 2, block=7).collect()}
    assert len({got[i] for i in range(60)}) == 1 and len({got[i] for i in range(60, 90)}) == 1 and got[0] != got[89]


def test_diagnostics_from_counts_are_those_of_the_pairs(spark):
    ship(spark)
    rng = np.random.default_rng(8)
    runs = spark.createDataFrame([(i, r, int(rng.integers(0, k))) for r, k in (("a", 3), ("b", 2), ("c", 3)) for i in range(90)], "id long, run_id string, cluster long")
    held = runs.where("(id + ascii(run_id)) % 3 <> 0")
    want = agreement.pair_diagnostics(agreement.coclustering(held), runs.where("run_id = 'a'").select("id", "cluster"), "probability").first().asDict()
    assert agreement.coclustering_diagnostics(held, runs.where("run_id = 'a'")).first().asDict() == pytest.approx(want)
    rows = {}
    for r in held.collect():
        rows.setdefault(r["id"], {})[r["run_id"]] = r["cluster"]
    got = {(r["i"], r["j"]): (r["together"], r["both"]) for r in agreement.co_membership(held).collect()}
    for i in rows:
        for j in rows:
            if i < j:
                both = rows[i].keys() & rows[j].keys()
                assert got.pop((i, j)) == (sum(rows[i][r] == rows[j][r] for r in both), len(both))
    assert not got


def test_fits_of_several_tables_advance_together(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    rows = frame(spark, x).withColumn("part", (F.col("id") % 2).cast("int"))
    alone = [kmeans.lloyd(own, kmeans.start(own, [(3, 1), (2, 1)])) for own in (rows.where(f"part = {p}").select("id", "v") for p in (0, 1))]
    fits = []
    for p in (0, 1):
        for f in kmeans.start(rows.where(f"part = {p}"), [(3, 1), (2, 1)]):
            f.draw = p
            fits.append(f)
    for one, two in zip([f for own in alone for f in own], kmeans.lloyd(rows, fits, part="part")):
        assert one.n_iter == two.n_iter and one.inertia == pytest.approx(two.inertia) and two.centers == pytest.approx(one.centers)
    assert metrics.silhouette_summary(metrics.silhouette_points(kmeans.assign(rows, fits[:1]).join(rows.select("id", "v"), "id"))).count() == 3


def test_rounds_of_a_tree_leave_no_copies_of_the_rows(spark):
    x = np.random.default_rng(6).normal(size=(60, 2))
    edges = tendency.spanning_tree(frame(spark, x), block=20).collect()
    assert len(edges) == 59 and sum(r["weight"] for r in edges) == pytest.approx(sum(w for *_, w in tendency.vat(distances(x, x))[1]))
    assert not any("placed-parts" in path for _, path in runtime._owned)
