"""Hand-computed micro fixtures and properties of the library's operators."""

from collections import Counter
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.features import build_features, default_features
from cairn.operators import agreement, cleaning, dbscan, drift, ensemble, hierarchy, interpret, kmeans, metrics, mixture, pairs, profiling, scaling, selection, serving, tendency
from cairn.sources import tables as io
from cairn.streaming import monitor


def points(spark, xs, clusters=None, labels=None, run="r"):
    rows = [(i, [float(x)] if not isinstance(x, (list, tuple)) else [float(y) for y in x], run, int(clusters[i]) if clusters else 0, int(labels[i]) if labels else 0) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "id long, v array<double>, run_id string, cluster long, label long")


LINE = [0, 1, 2, 10, 11, 12]


def test_internal_measures_by_hand(spark):
    rows = points(spark, LINE, [0, 0, 0, 1, 1, 1])
    s = {r["id"]: r["silhouette"] for r in metrics.silhouette_points(rows, block=2).collect()}
    assert s[0] == pytest.approx((11 - 1.5) / 11) and s[1] == pytest.approx((10 - 1) / 10)
    assert metrics.davies_bouldin(rows).collect()[0][1] == pytest.approx((2 / 3 + 2 / 3) / 10)
    assert metrics.calinski_harabasz(rows).collect()[0][1] == pytest.approx((150 / 1) / (4 / 4))


def test_singleton_noise_and_single_cluster(spark):
    single = metrics.silhouette_points(points(spark, [*LINE, 30], [0, 0, 0, 1, 1, 1, 2])).where("id = 6").collect()[0]
    assert single["silhouette"] == 0
    noisy = metrics.internal(points(spark, [*LINE, 30], [0, 0, 0, 1, 1, 1, -1])).collect()[0]
    clean = metrics.internal(points(spark, LINE, [0, 0, 0, 1, 1, 1])).collect()[0]
    assert noisy["silhouette"] == pytest.approx(clean["silhouette"]) and noisy["davies_bouldin"] == pytest.approx(clean["davies_bouldin"])
    one = metrics.internal(points(spark, LINE, [0] * 6)).collect()[0]
    assert one["silhouette"] is None and one["davies_bouldin"] is None and one["calinski_harabasz"] is None


@pytest.mark.parametrize("clusters,labels,ari,nmi", [([0, 0, 1, 1], [0, 0, 1, 1], 1, 1), ([1, 1, 0, 0], [0, 0, 1, 1], 1, 1), ([0, 1, 0, 1], [0, 0, 1, 1], -0.5, 0), ([0, 0, 0, 0], [0, 0, 1, 1], 0, 0)])
def test_external_measures(spark, clusters, labels, ari, nmi):
    r = metrics.external(points(spark, range(4), clusters, labels)).collect()[0]
    assert r["ari"] == pytest.approx(ari, abs=1e-9) and r["nmi"] == pytest.approx(nmi, abs=1e-9)
    assert r["ami"] == pytest.approx(1 if ari == 1 else (0 if ari == 0 else -0.5), abs=1e-6)


def test_homogeneity_is_completeness_the_other_way_round(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 40).tolist(), rng.integers(0, 4, 40).tolist()
    x, y = metrics.external(points(spark, range(40), a, b)).collect()[0], metrics.external(points(spark, range(40), b, a)).collect()[0]
    assert x["homogeneity"] == pytest.approx(y["completeness"]) and x["ari"] == pytest.approx(y["ari"]) and x["ami"] == pytest.approx(y["ami"])


def test_coassociation_by_hand(spark):
    runs = spark.createDataFrame([(i, r, c) for r, cs in {"a": [0, 0, 1, 1, 1], "b": [0, 0, 0, 1, 1], "c": [2, 1, 1, 0, 0]}.items() for i, c in enumerate(cs)], "id long, run_id string, cluster long")
    got = {(r["i"], r["j"]): r["share"] for r in agreement.coassociation(runs).collect()}
    assert got[0, 1] == pytest.approx(2 / 3) and got[3, 4] == 1 and got[0, 4] == 0 and len(got) == 10


@pytest.mark.parametrize("method,heights", [("single", [1, 2, 3, 4]), ("complete", [1, 2, 7, 10]), ("average", [1, 2, 5.0, 41 / 6])])
def test_linkage_heights(method, heights):
    x = np.array([[0.0], [1], [5], [8], [10]])
    d = np.abs(x - x.T)
    tree = hierarchy.linkage_tree(d, method)
    if method == "single":
        assert tree[:, 2].tolist() == [1, 2, 3, 4]
    assert tree[:2, 2].tolist() == [1, 2] and np.all(np.diff(tree[:, 2]) >= 0) and tree[-1, 3] == 5
    assert set(hierarchy.cut_tree(tree, 2).tolist()) == {0, 1} and len(set(hierarchy.cut_tree(tree, 5))) == 5


def test_linkage_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for method in hierarchy.LINKAGES:
        groups, heights = [[i] for i in range(25)], []
        while len(groups) > 1:
            def far(a, b):
                own = d[np.ix_(a, b)]
                if method == "ward":
                    ca, cb = x[a].mean(0), x[b].mean(0)
                    return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(ca - cb)
                return {"single": own.min(), "complete": own.max(), "average": own.mean()}[method]
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: far(groups[p[0]], groups[p[1]]))
            heights.append(far(groups[i], groups[j]))
            groups[i] += groups.pop(j)
        assert np.allclose(hierarchy.linkage_tree(d, method)[:, 2], heights)


def test_vat_tree_is_minimal(spark):
    x = np.random.default_rng(1).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    order, edges = tendency.vat(d)
    parent = list(range(12))
    find = lambda i: i if parent[i] == i else find(parent[i])
    total = 0.0
    for w, i, j in sorted((d[i, j], i, j) for i in range(12) for j in range(i)):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += w
    assert sorted(order.tolist()) == list(range(12)) and sum(e[2] for e in edges) == pytest.approx(total)


def test_dbscan_by_hand(spark):
    rows = points(spark, [0, 1, 2, 3.4, 10, 11, 12, 50]).select("id", "v")
    got = {r["id"]: (r["cluster"], r["core"]) for r in dbscan.dbscan(rows, 1.5, 3, block=3).collect()}
    assert got[1] == (0, True) and got[3] == (0, False) and got[5] == (1, True) and got[7] == (-1, False)


def test_kmeans_inertia_falls_and_recovers_clusters(spark):
    rng = np.random.default_rng(5)
    xs = [[*(rng.normal(size=2) + c)] for c in ((0, 0), (20, 0), (0, 20)) for _ in range(30)]
    rows = points(spark, xs).select("id", "v")
    fits = kmeans.lloyd(rows, kmeans.start(rows, [(3, s) for s in range(4)]), 30)
    assert all(np.all(np.diff(f.inertia) <= 1e-9) for f in fits)
    best = min(fits, key=lambda f: f.inertia[-1])
    labels = [r["cluster"] for r in kmeans.assign(rows, [best]).orderBy("id").collect()]
    assert len(set(labels[:30])) == 1 and len(set(labels)) == 3


@pytest.mark.parametrize("kind", mixture.KINDS)
def test_mixture_bounds_rise(spark, kind):
    rng = np.random.default_rng(6)
    rows = points(spark, [[*(rng.normal(size=2) + c)] for c in ((0, 0), (8, 8)) for _ in range(50)]).select("id", "v")
    m = mixture.fit(rows, 2, kind, steps=15, tolerance=0)
    assert np.all(np.diff(m.bounds) > -1e-6)
    bic, aic = mixture.criteria(m)
    assert bic - aic == pytest.approx(m.parameters * (math.log(100) - 2))


def test_grid_has_322_members():
    grid = ensemble.base_grid()
    assert len(grid) == 322 and [sum(g[1] == a for g in grid) for a in ("kmeans", "gmm", "ward")] == [140, 168, 14]


# behaviours of the feature and drift contracts


def raw(spark):
    vs = [f"V{i}" for i in range(1, 29)]
    rows = [(k, t, a, *(s * i for i in range(1, 29))) for k, (t, a, s) in enumerate([(0.0, 0.0, 0.0), (21600.0, 9.0, 1.0), (43200.0, 99.0, -1.0)])]
    return spark.createDataFrame([tuple(float(x) if i else x for i, x in enumerate(r)) for r in rows], ["row_id", "Time", "Amount", *vs])


def test_feature_build(spark):
    rows = raw(spark)
    names = default_features(rows)
    built = build_features(rows, names)
    assert built.columns == ["row_id", *names] and len(names) == 31
    got = built.orderBy("row_id").collect()
    assert [r["Amount_log1p"] for r in got] == pytest.approx([0, math.log(10), math.log(100)])
    assert [(r["Time_sin"], r["Time_cos"]) for r in got] == [pytest.approx(x, abs=1e-12) for x in ((0, 1), (1, 0), (0, -1))]
    with pytest.raises(KeyError):
        build_features(rows, ["V99"])
    with pytest.raises(ValueError):
        build_features(rows.withColumn("Class", F.lit(1)), ["Class"])


def long(spark, values, name="f"):
    return spark.createDataFrame([(name, float(v)) for v in values], "feature string, value double")


def test_psi_contract(spark):
    rng = np.random.default_rng(42)
    same = long(spark, np.linspace(0, 1, 1000))
    assert drift.psi(same, same).collect()[0]["psi"] < 1e-10
    a, b, c = rng.normal(0, 1, 3000), rng.normal(2, 1, 3000), rng.normal(0.2, 1, 1000)
    assert drift.psi(long(spark, a), long(spark, b)).collect()[0]["psi"] > 0.25
    assert drift.psi(long(spark, a), long(spark, c)).collect()[0]["psi"] >= 0
    assert drift.psi(long(spark, [3] * 9), long(spark, [3] * 5)).collect()[0]["psi"] == 0
    assert drift.psi(long(spark, [3] * 9), long(spark, [3, 4, 5])).collect()[0]["psi"] > 0
    d = drift.ks(long(spark, a), long(spark, b)).collect()[0]
    assert d["ks_statistic"] > 0.5 and d["ks_pvalue"] < 1e-6


@pytest.mark.parametrize("gaps,k,rule", [([(2, 1.0, 0.1), (3, 1.05, 0.1), (4, 2.0, 0.1)], 2, "gap_rule"), ([(2, 0.1, 0.01), (3, 0.5, 0.01), (4, 0.4, 0.01)], 3, "gap_rule"), ([(2, 0.1, 0.01), (3, 0.5, 0.01), (4, 0.9, 0.01)], 4, "max_gap")])
def test_gap_rule(spark, gaps, k, rule):
    assert tuple(selection.gap_rule(spark.createDataFrame(gaps, "k long, gap double, s double")).collect()[0]) == (k, rule)


def test_dense_key_and_split(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000 / 10).alias("Time"), F.col("id").alias("pos"))
    keyed = cleaning.dense_key(rows, ["Time", "pos"], partitions=7).orderBy("row_id").collect()
    assert [r["row_id"] for r in keyed] == list(range(1000)) and [r["Time"] for r in keyed] == sorted(r["Time"] for r in keyed)
    assert cleaning.temporal_split(rows.withColumnRenamed("pos", "row_id")).where("split = 'train'").count() == 800


def test_scalers_and_components(spark):
    rows = spark.createDataFrame([(i, [float(i), 5.0, float(i % 3)]) for i in range(1, 9)], "id long, v array<double>")
    scaled = scaling.apply_scaler(rows, scaling.fit_standard(rows))
    x = np.array([r["v"] for r in scaled.collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), [1, 0, 1])
    assert [r["center"] for r in scaling.fit_robust(rows).orderBy("dim").collect()][0] == 4.5
    mean, loadings, share, kept = scaling.fit_pca(rows)
    back = np.array([r["v"] for r in scaling.apply_pca(rows, mean, loadings, 3).orderBy("id").collect()]) @ loadings + mean
    assert np.allclose(back, [r["v"] for r in rows.orderBy("id").collect()]) and share.sum() == pytest.approx(1) and kept <= 3


def test_significance_agrees_with_known_values():
    assert profiling.t_two_sided(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    assert profiling.critical_r(20, 0.05) == pytest.approx(0.4438, abs=2e-4)


def test_medoid_exemplars_and_anomalies(spark):
    rows = points(spark, [0, 1, 2, 3, 20], [0] * 5)
    assert metrics.medoids(rows).collect()[0]["id"] == 2
    pts = spark.createDataFrame([(0, i, float(x), None) for i, x in enumerate([1, 2, 3, 4, 100])], "cluster long, id long, distance double, silhouette double")
    kinds = {r["kind"]: r["id"] for r in interpret.exemplars(pts).collect()}
    assert kinds == {"closest": 0, "boundary": 4}
    first = interpret.anomalies(pts.drop("silhouette")).where("anomaly_rank = 1").collect()[0]
    assert first["id"] == 4 and first["score"] == pytest.approx(97 / 1.4826)


def test_registry_round_trip_and_stream(spark, tmp_path):
    e = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") * 400.0).alias("Time"), (F.col("id") % 17 * 3.0).alias("Amount"))
    names = ["Amount_log1p", "Time_sin", "Time_cos"]
    own = build_features(e, names)
    fitted = scaling.fit_columns(own, names)
    v = scaling.apply_columns(own, fitted).select(F.col("row_id").alias("id"), F.array(*names).alias("v"), (F.col("row_id") % 2).alias("cluster"))
    serving.save_registry(str(tmp_path / "reg"), serving.fit_registry(v.select("id", "v"), v.select("id", "cluster")), fitted, names)
    reg = serving.Registry.load(spark, str(tmp_path / "reg"))
    batch = reg.assign(e)
    assert "Exchange" not in batch._jdf.queryExecution().executedPlan().toString()
    e.write.parquet(str(tmp_path / "in"))
    stream = monitor.assign_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), reg)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_drift_stream(spark, tmp_path):
    rows = spark.range(1000).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 300).alias("ts"), F.lit("x").alias("feature"), (F.col("id") % 10).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    counts = monitor.windowed_bins(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), {"x": [2.0, 5.0]}, "ts")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("w")
    assert got.agg(F.sum("n")).collect()[0][0] == 1000
    psi = monitor.window_psi(got, {"x": [0.2, 0.3, 0.5]}).collect()
    assert len(psi) == 4 and max(r["psi"] for r in psi) < 0.05


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Time,Amount\n1,2.5\n3,4\n")
    assert io.read_csv(spark, str(tmp_path / "t.csv")).count() == 2
    assert io.read_optional(spark, str(tmp_path / "none.json"), "a long", "json").count() == 0
    assert io.read_text_optional(spark, str(tmp_path / "none.txt")) == ""
    import hashlib

    m = io.file_manifest(spark, str(tmp_path / "t.csv"), str(tmp_path / "none")).collect()
    assert len(m) == 1 and m[0]["sha256"] == hashlib.sha256((tmp_path / "t.csv").read_bytes()).hexdigest()
    v = spark.createDataFrame([(1, [1.0])], "row_id long, x array<double>")
    io.write(io.as_floats(v, "x"), str(tmp_path / "v"))
    assert io.read_vectors(spark, str(tmp_path / "v"), ["x"]).count() == 1
    with pytest.raises(KeyError):
        io.read_vectors(spark, str(tmp_path / "v"), ["y"])
    assert io.preflight(spark, [str(tmp_path / "gone")]) == [f"missing: {tmp_path / 'gone'}"]


def test_prune_and_push_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = pairs_plan = build_features(df.select(F.col("event_id").alias("row_id"), F.col("value").alias("Amount"), F.lit(0.0).alias("Time")).where("Amount > 10"), ["Amount_log1p"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in text and "user_id" not in text and pairs_plan is plan


def test_nearest_ties_go_to_the_smaller_id(spark):
    rows = points(spark, [0, 1, -1, 2]).select("id", "v")
    got = {(r["id"], r["rank"]): r["other"] for r in pairs.nearest(rows, rows, 2, block=2).collect()}
    assert got[0, 1] == 1 and got[0, 2] == 2


def test_starts_drawn_apart_follow_the_race(spark):
    from hashlib import md5

    from cairn.operators import kmeans

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    fits = kmeans.start_apart(rows.repartition(5), [(4, 1), (3, 1), (2, 7)])
    assert [len(f.centers) for f in fits] == [4, 3, 2] and np.allclose(fits[0].centers[:3], fits[1].centers)
    for fit in fits:
        own = [kmeans.seed_rows(rows, 1, fit.seed)[0]]
        for step in range(1, fit.k):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in own], axis=0)
            u = [(int(md5(f"{fit.seed}:{step}:{i}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1) for i in range(60)]
            own.append(x[min(range(60), key=lambda i: (-math.log(u[i]) / d[i] if d[i] > 0 else math.inf, i))])
        assert np.allclose(fit.centers, own)


def test_consensus_and_bases_against_brute_force(spark):
    from cairn.operators import ensemble, hierarchy, metrics, selection

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.3, (12, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    rows = spark.createDataFrame([(i, [float(v) for v in r], i // 12) for i, r in enumerate(x)], "id long, v array<double>, label long")
    bases = ensemble.base_clusterings(rows.select("id", "v"), ensemble.base_grid((2,), (2, 3), 2, 1)).cache()
    got = {r["base_id"]: r for r in ensemble.evaluate_bases(bases, rows).collect()}
    assert len(got) == bases.count()
    shared = np.zeros((36, 36))
    for r in bases.collect():
        at = np.array(r["clusters"])[np.argsort(r["ids"])]
        shared += at[:, None] == at[None, :]
        a, b = Counter(at.tolist()), Counter(zip(at.tolist(), [i // 12 for i in range(36)]))
        assert math.isclose(got[r["base_id"]]["purity"], sum(max(n for (c, _), n in b.items() if c == k) for k in a) / 36, abs_tol=1e-9)
    tree = hierarchy.linkage_tree(1 - shared / bases.count(), "average")
    cuts = ensemble.consensus(bases, (2, 3))
    for k in (2, 3):
        own = {r["id"]: r["cluster"] for r in cuts.where(F.col("run_id") == str(k)).collect()}
        assert [own[i] for i in range(36)] == hierarchy.cut_tree(tree, k).tolist()
    chosen = metrics.evaluate(cuts.where("run_id = '3'").join(rows, "id")).withColumn("requested_k", F.lit(3).cast("long"))
    both = {r["algorithm"].split(":")[0]: r for r in ensemble.against_best_base(ensemble.evaluate_bases(bases, rows), chosen).collect()}
    measured = [r for r in got.values() if r["silhouette"] is not None]
    ranks = {r["base_id"]: sum(sum((o[c] > r[c]) if up else (o[c] < r[c]) for o in measured) for c, up in selection.DIRECTIONS.items()) for r in measured}
    best = min(measured, key=lambda r: (ranks[r["base_id"]], -r["silhouette"], r["base_id"]))
    assert both["Best base"]["parameters"] == best["parameters"] and both["Consensus"]["purity"] == 1.0
    assert selection.compare(ensemble.best_base(ensemble.evaluate_bases(bases, rows)), chosen).collect()[0]["improved"] in range(4)


def test_refits_by_family(spark):
    from cairn.operators.refit import refit

    rows = spark.createDataFrame([(i, [float(i // 5) * 10 + i % 5 * 0.1, 0.0]) for i in range(15)], "id long, v array<double>")
    for family, how in (("kmeans", {"k": 3}), ("hierarchical", {"k": 3, "linkage": "single"}), ("gmm", {"k": 3, "covariance": "spherical"}), ("dbscan", {"eps": "1.0", "min_samples": "3"})):
        got = {r["id"]: r["cluster"] for r in refit(rows, family, **how).collect()}
        assert len(got) == 15 and len({(i // 5, c) for i, c in got.items()}) == len(set(got.values()))
    for bad in ({"algorithm": "kmeans"}, {"algorithm": "unknown", "k": 2}):
        with pytest.raises(ValueError):
            refit(rows, **bad)


def test_walked_quantiles_equal_percentiles(spark):
    from cairn.operators import profiling

    rng = np.random.default_rng(9)
    rows = [(f, float(v)) for f, n in (("a", 1), ("b", 2), ("c", 500), ("d", 301)) for v in (rng.integers(0, 40, n) if f == "d" else rng.normal(size=n))] + [("c", None)]
    long = spark.createDataFrame(rows, "feature string, value double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["feature"]: r["q"] for r in profiling.walked_quantiles(*profiling.walked(profiling.value_counts_of(long), ["n"]), shares).collect()}
    for f in "abcd":
        assert np.allclose(got[f], np.quantile([v for g, v in rows if g == f and v is not None], shares))


def test_correlation_p_values_by_integration(spark):
    from cairn.operators import profiling

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    x[:, 1] += 0.4 * x[:, 0]
    rows = spark.createDataFrame([tuple(float(v) for v in r) + (1.0,) for r in x] + [(None, 1.0, 2.0, 1.0)], "a double, b double, c double, d double")
    got = {(r["left"], r["right"]): r for r in profiling.correlation_significance(rows, ["a", "b", "c", "d"], 0.05).collect()}
    assert len(got) == 12 and got["a", "d"]["p_value"] is None and not got["a", "d"]["significant"]
    r, n = np.corrcoef(x[:, 0], x[:, 1])[0, 1], 40
    u = np.linspace(abs(r), 1, 200_001)
    norm = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2) - math.lgamma(0.5))
    y = norm * (1 - u**2) ** ((n - 4) / 2)
    assert got["a", "b"]["n"] == 40 and math.isclose(got["a", "b"]["p_value"], 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(u)).sum()), rel_tol=1e-6)
    assert (got["a", "b"]["masked"] is None) == (got["a", "b"]["p_value"] > 0.05)


def test_dbscan_grid_equals_single_fits(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-3, 6, (15, 2))])
    rows = spark.createDataFrame([(1000 - i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    settings = [(0.5, 4), (0.9, 4), (0.9, 8), (9.0, 3), (0.01, 2)]
    got = {}
    for r in dbscan.fit(rows, settings, block=40).collect():
        got.setdefault(r["s"], {})[r["id"]] = (r["cluster"], r["core"])
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    ids = [1000 - i for i in range(len(x))]
    for s, (eps, least) in enumerate(settings):
        near = d <= eps
        core = near.sum(axis=1) >= least
        root = {i: i for i in range(len(x)) if core[i]}
        for _ in range(len(x)):
            root = {i: min([root[j] for j in root if near[i, j]], key=lambda j: ids[j]) for i in root}
        firsts = sorted({ids[r] for r in root.values()})
        want = {}
        for i in range(len(x)):
            reach = [firsts.index(ids[root[j]]) for j in root if near[i, j]]
            want[ids[i]] = (firsts.index(ids[root[i]]) if core[i] else min(reach, default=-1), bool(core[i]))
        assert got[s] == want


def test_dense_key_with_clashing_names(spark):
    rows = spark.createDataFrame([(5, 1, 1, 1, 1), (3, 2, 2, 2, 2)], "k long, part_ long, place_ long, before_ long, n_ long")
    got = sorted(tuple(r) for r in cleaning.dense_key(rows, ["k"], "at").collect())
    assert got == [(3, 2, 2, 2, 2, 0), (5, 1, 1, 1, 1, 1)]


def test_fetch_goes_on_to_the_next_address(tmp_path):
    import hashlib

    source, target = tmp_path / "source.csv", tmp_path / "target.csv"
    source.write_bytes(b"a,b" * 1000)
    (tmp_path / "empty").write_bytes(b"")
    digest = hashlib.sha256(source.read_bytes()).hexdigest()
    urls = [f"file://{tmp_path}/none.csv", f"file://{tmp_path}/empty", f"file://{source}"]
    assert io.fetch(urls, str(target), digest) == urls[2] and target.read_bytes() == source.read_bytes()
    assert io.fetch(urls, str(target), digest) == ""
    with pytest.raises(OSError, match="none.csv.*empty"):
        io.fetch(urls[:2], str(tmp_path / "other"))
    with pytest.raises(OSError, match="digest"):
        io.fetch(urls[2:], str(tmp_path / "other"), "0" * 64)
    assert not list(tmp_path.glob("*.part"))


def test_records_and_aligned_tables(spark, tmp_path):
    io.write_record(spark, f"{tmp_path}/record", {"seconds": 1.5, "rows": 3})
    assert io.read_record(spark, f"{tmp_path}/record") == {"seconds": 1.5, "rows": 3} and io.read_record(spark, f"{tmp_path}/none") == {}
    for name, ids in (("a", [1, 2]), ("b", [2, 1]), ("c", [1, 3])):
        io.write(spark.createDataFrame([(i, i * 10) for i in ids], f"row_id long, {name} long"), f"{tmp_path}/{name}")
    assert sorted(tuple(r) for r in io.read_aligned(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}).collect()) == [(1, 10, 10), (2, 20, 20)]
    with pytest.raises(ValueError, match="c hasn't"):
        io.read_aligned(spark, {"a": f"{tmp_path}/a", "c": f"{tmp_path}/c"})
    rows = io.file_manifest(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
    assert len({r["path"] for r in rows}) == len(rows) > 1 and all(len(r["sha256"]) == 64 for r in rows)
