"""Partition quality: internal measures over (id, v, run_id, cluster), external ones over two labels.

A run's noise (cluster -1) is left out of internal measures and is a cluster like any other in
external ones. A measure that isn't defined is null.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.pairs import BLOCK, held, label_sums
from cairn.operators.quantiles import exact_quantiles
from cairn.runtime import materialize


def silhouette_points(rows: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(id, run_id, cluster, a, b, silhouette); 0 in a cluster of one, null in a run of one cluster."""
    rows = rows.where("cluster >= 0")
    sums = label_sums(rows, metric, block).join(rows.select("id", "run_id", "cluster"), ["id", "run_id"])
    own = F.col("other") == F.col("cluster")
    ab = sums.groupBy("id", "run_id", "cluster").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    s = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("size") == 1, 0.0).when(top == 0, 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return ab.select("id", "run_id", "cluster", "a", "b", s.cast("double").alias("silhouette"))


def silhouette_summary(points: DataFrame) -> DataFrame:
    """For each run and cluster: size, mean, median, extremes, shares below 0 and within 0.1 of it."""
    points = held(points)  # it is read twice
    s = F.col("silhouette")
    own = points.groupBy("run_id", "cluster").agg(
        F.count("*").alias("size"), F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.avg((s < 0).cast("double")).alias("negative_fraction"), F.avg((F.abs(s) <= 0.10).cast("double")).alias("boundary_fraction"),
    )
    median = exact_quantiles(points, ["run_id", "cluster"], "silhouette", [0.5]).select("run_id", "cluster", F.get("q", F.lit(0)).alias("median"))
    return own.join(median, ["run_id", "cluster"], "left").select("run_id", "cluster", "size", "mean", "median", "min", "max", "negative_fraction", "boundary_fraction")


def centroids(rows: DataFrame) -> DataFrame:
    """(run_id, cluster, n, c): the mean vector of each cluster."""
    long = rows.select("run_id", "cluster", F.posexplode("v").alias("dim", "x"))
    means = long.groupBy("run_id", "cluster", "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("run_id", "cluster").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("c"))


def scatter(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters with their mean distance to the centroid (s) and squared sum (w); the clusters' centroids again."""
    from cairn.functions.vectors import euclidean

    rows = rows.where("cluster >= 0")
    cents = materialize(centroids(rows), "centroids")  # Spark broadcasts it by its size
    d = rows.join(cents, ["run_id", "cluster"]).withColumn("d", euclidean(F.col("v"), F.col("c")))
    return d.groupBy("run_id", "cluster").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"), F.count("*").alias("n")), cents


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """(run_id, davies_bouldin), null unless 2 <= k < n."""
    from cairn.functions.vectors import euclidean

    spread, cents = scatter(rows)
    k = spread.join(cents.select("run_id", "cluster", "c"), ["run_id", "cluster"])
    a, b = k.alias("a"), k.alias("b")
    m = euclidean(F.col("a.c"), F.col("b.c"))
    worst = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.cluster") != F.col("b.cluster"))).groupBy(F.col("a.run_id").alias("run_id"), F.col("a.cluster").alias("cluster")).agg(F.max(F.when(m > 0, (F.col("a.s") + F.col("b.s")) / m)).alias("r"))
    sizes = spread.groupBy("run_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    out = worst.groupBy("run_id").agg(F.avg("r").alias("db"))
    return sizes.join(out, "run_id", "left").select("run_id", F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("db")).alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """(run_id, calinski_harabasz), null unless 2 <= k < n; 1 without spread inside clusters."""
    spread, cents = scatter(rows)
    long = cents.select("run_id", "n", F.posexplode("c").alias("dim", "x"))
    between = long.groupBy("run_id", "dim").agg((F.sum(F.col("n") * F.col("x") * F.col("x")) - F.pow(F.sum(F.col("n") * F.col("x")), 2) / F.sum("n")).alias("b")).groupBy("run_id").agg(F.sum("b").alias("b"))
    w = spread.groupBy("run_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    value = F.when(F.col("w") == 0, 1.0).otherwise(F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k"))))
    return w.join(between, "run_id").select("run_id", F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), value).alias("calinski_harabasz"))


def internal(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, silhouette, davies_bouldin, calinski_harabasz)."""
    points = silhouette_points(rows, block=block)
    sizes = rows.where("cluster >= 0").groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"))
    mean = points.groupBy("run_id").agg(F.avg("silhouette").alias("s")).join(sizes, "run_id")
    sil = mean.select("run_id", F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("s")).alias("silhouette"))
    return sil.join(davies_bouldin(rows), "run_id", "full").join(calinski_harabasz(rows), "run_id", "full")


def contingency(rows: DataFrame) -> DataFrame:
    """(run_id, cluster, label, n)."""
    return rows.groupBy("run_id", "cluster", "label").agg(F.count("*").alias("n"))


def _choose2(c: Column) -> Column:
    return c.cast("double") * (c - 1) / 2


def external(rows: DataFrame, ami: bool = True) -> DataFrame:
    """purity, ari, nmi, ami, fowlkes_mallows, homogeneity, completeness, v_measure of (run_id, cluster, label)."""
    return external_of(materialize(contingency(rows), "contingency"), ami)


def external_of(table: DataFrame, ami: bool = True) -> DataFrame:
    """The same of counted cells (run_id, cluster, label, n)."""
    by_run = lambda *k: Window.partitionBy("run_id", *k)  # noqa: E731  a table of clusters by labels
    t = table.select("*", F.sum("n").over(by_run("cluster")).alias("a"), F.sum("n").over(by_run("label")).alias("b"), F.sum("n").over(by_run()).alias("total"), F.row_number().over(by_run("cluster").orderBy(F.desc("n"))).alias("ra"), F.row_number().over(by_run("label").orderBy(F.desc("n"))).alias("rb"))
    p, pa_, pb = (F.col(c) / F.col("total") for c in ("n", "a", "b"))
    sums = t.groupBy("run_id").agg(
        F.max("total").alias("total"),
        F.sum(F.when(F.col("ra") == 1, F.col("n"))).alias("most"),
        F.sum(_choose2(F.col("n"))).alias("tk"),
        F.sum(F.when(F.col("ra") == 1, _choose2(F.col("a")))).alias("pk"),
        F.sum(F.when(F.col("rb") == 1, _choose2(F.col("b")))).alias("qk"),
        F.sum(p * F.log(p / (pa_ * pb))).alias("mi"),
        F.sum(F.when(F.col("ra") == 1, -pa_ * F.log(pa_))).alias("hk"),
        F.sum(F.when(F.col("rb") == 1, -pb * F.log(pb))).alias("hc"),
    )
    pairs = _choose2(F.col("total"))
    expected = F.when(pairs > 0, F.col("pk") * F.col("qk") / pairs).otherwise(0.0)
    most = (F.col("pk") + F.col("qk")) / 2
    h = F.when(F.col("hc") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("hc"))
    c = F.when(F.col("hk") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("hk"))
    out = sums.select(
        "run_id",
        (F.col("most") / F.col("total")).alias("purity"),
        F.when(most == expected, 1.0).otherwise((F.col("tk") - expected) / (most - expected)).alias("ari"),
        F.when((F.col("hk") <= 1e-15) & (F.col("hc") <= 1e-15), 1.0).when(F.col("hk") + F.col("hc") <= 1e-15, 0.0).otherwise(2 * F.col("mi") / (F.col("hk") + F.col("hc"))).alias("nmi"),
        F.when((F.col("pk") > 0) & (F.col("qk") > 0), F.col("tk") / F.sqrt(F.col("pk") * F.col("qk"))).otherwise(0.0).alias("fowlkes_mallows"),
        h.alias("homogeneity"),
        c.alias("completeness"),
        F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"),
    )
    if not ami:
        return out
    margins: dict[str, tuple[dict, dict, float]] = {}
    for r in table.collect():  # clusters by labels of each run
        a, b, _ = margins.setdefault(r["run_id"], ({}, {}, 0.0))
        a[r["cluster"]] = a.get(r["cluster"], 0) + r["n"]
        b[r["label"]] = b.get(r["label"], 0) + r["n"]
    chance = table.sparkSession.createDataFrame([(k, expected_mutual_information(list(a.values()), list(b.values()))) for k, (a, b, _) in margins.items()], "run_id string, emi double")
    mean = (F.col("hk") + F.col("hc")) / 2
    adjusted = sums.join(F.broadcast(chance), "run_id").select("run_id", F.when(F.abs(mean - F.col("emi")) <= 1e-12, 1.0).otherwise((F.col("mi") - F.col("emi")) / (mean - F.col("emi"))).alias("ami"))
    return out.join(adjusted, "run_id")


def expected_mutual_information(a: list[int], b: list[int]) -> float:
    """Mean mutual information of random tables with these margins (hypergeometric).

    Equal margins give equal terms, so each pair of different sizes is worked out once. A cell's chances
    follow each other by a ratio from the likeliest count outwards, as far as they matter.
    """
    n = sum(a)
    f = lambda x: math.lgamma(x + 1)
    out = 0.0
    for x, times_x in Counter(a).items():
        for y, times_y in Counter(b).items():
            low, high = max(0, x + y - n), min(x, y)
            mode = min(high, max(low, (x + 1) * (y + 1) // (n + 2)))
            top = math.exp(f(x) + f(y) + f(n - x) + f(n - y) - f(n) - f(mode) - f(x - mode) - f(y - mode) - f(n - x - y + mode))
            gain = lambda k: k / n * math.log(n * k / (x * y)) if k else 0.0  # noqa: B023, E731
            cell = top * gain(mode)
            p, k = top, mode
            while k < high and p > 1e-25:
                p *= (x - k) * (y - k) / ((k + 1) * (n - x - y + k + 1))
                k += 1
                cell += p * gain(k)
            p, k = top, mode
            while k > low and p > 1e-25:
                p *= k * (n - x - y + k) / ((x - k + 1) * (y - k + 1))
                k -= 1
                cell += p * gain(k)
            out += times_x * times_y * cell
    return out


def cluster_counts(rows: DataFrame) -> DataFrame:
    """(run_id, n_records, n_clusters, noise_fraction)."""
    return rows.groupBy("run_id").agg(F.count("*").alias("n_records"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.avg((F.col("cluster") < 0).cast("double")).alias("noise_fraction"))


def size_statistics(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("run_id", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("run_id").agg(F.count("*").alias("k"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.percentile("n", 0.5).alias("median_size"), (F.min("n") / F.sum("n")).alias("smallest_fraction"), (F.max("n") / F.sum("n")).alias("largest_fraction"))


def evaluate(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The full evaluation row of every run of (id, v, run_id, cluster, label). The label is used only here."""
    return cluster_counts(rows).join(internal(rows, block), "run_id", "left").join(external(rows), "run_id", "left")


def medoids(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, cluster, id, total, mean): the member with the least sum of distances; ties to the smaller id."""
    own = label_sums(rows, block=block).join(rows.select("id", "run_id", "cluster"), ["id", "run_id"]).where("other = cluster")
    best = own.groupBy("run_id", "cluster").agg(F.min(F.struct("total", "id", "n")).alias("m"))
    return best.select("run_id", "cluster", "m.id", "m.total", (F.col("m.total") / F.greatest(F.col("m.n") - 1, F.lit(1))).alias("mean"))
