"""Choosing k, parameters and winners from small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Internal measures and whether more is better.
DIRECTIONS = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True}


def rank_sum(table: DataFrame, measures: dict[str, bool] | None = None, partition: Sequence[str] = (), ties: Sequence[Column] = (), drop_null: bool = True) -> DataFrame:
    """Adds competition ranks of each measure, their sum ``rank_score``, and ``final_order`` by it (then ``ties``)."""
    measures = measures or DIRECTIONS
    if drop_null:
        table = table.na.drop(subset=list(measures))
    for name, more in measures.items():
        order = F.col(name).desc_nulls_last() if more else F.col(name).asc_nulls_last()
        table = table.withColumn(f"rank_{name}", F.rank().over(Window.partitionBy(*partition).orderBy(order)).cast("long"))
    table = table.withColumn("rank_score", sum((F.col(f"rank_{m}") for m in measures), F.lit(0)).cast("long"))
    order = Window.partitionBy(*partition).orderBy("rank_score", *ties)
    return table.withColumn("final_order", F.row_number().over(order).cast("long"))


def best_in(table: DataFrame, partition: Sequence[str], measures: dict[str, bool] | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """The first row of each part by its sum of ranks, then by ``ties``."""
    return rank_sum(table, measures, partition, ties).where("final_order = 1").drop("final_order")


def rank_winners(table: DataFrame, measures: dict[str, bool] | None = None) -> DataFrame:
    """Every row at the least rank score is a winner; null measures rank last."""
    scored = rank_sum(table, measures, drop_null=False, ties=[F.lit(0)])
    return scored.withColumn("winner", F.col("rank_score") == F.min("rank_score").over(Window.partitionBy())).drop("final_order")


def gap_rule(gaps: DataFrame) -> DataFrame:
    """(k, rule) of (k, gap, s): the smallest k with gap(k) >= gap(k+1) - s(k+1), else the largest gap."""
    ahead = F.lead(F.col("gap") - F.col("s")).over(Window.orderBy("k"))
    marked = gaps.withColumn("fires", F.coalesce(F.col("gap") >= ahead, F.lit(False)))
    got = marked.agg(F.min(F.when(F.col("fires"), F.col("k"))).alias("first"), F.max_by("k", F.struct("gap", -F.col("k"))).alias("top"))
    return got.select(F.coalesce("first", "top").alias("k"), F.when(F.col("first").isNotNull(), "gap_rule").otherwise("max_gap").alias("rule"))


def elbow(curve: DataFrame) -> DataFrame:
    """(k, method) of (k, inertia): the largest local maximum of the gap under the chord of the normalised curve
    (decreasing, convex); without one the largest second difference, else the first k."""
    every = Window.partitionBy()
    x = (F.col("k") - F.min("k").over(every)) / F.nullif(F.max("k").over(every) - F.min("k").over(every), F.lit(0))
    y = (F.col("inertia") - F.min("inertia").over(every)) / F.nullif(F.max("inertia").over(every) - F.min("inertia").over(every), F.lit(0.0))
    order = Window.orderBy("k")
    c = curve.withColumn("below", (F.lit(1) - y) - x).withColumn("bend", F.abs(F.lead("inertia").over(order) - 2 * F.col("inertia") + F.lag("inertia").over(order)))
    peak = (F.col("below") > F.lag("below").over(order)) & (F.col("below") >= F.lead("below").over(order))
    c = c.withColumn("peak", F.coalesce(peak, F.lit(False)))
    got = c.agg(F.max_by(F.when(F.col("peak"), F.col("k")), F.when(F.col("peak"), F.struct("below", -F.col("k")))).alias("knee"), F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", -F.col("k")))).alias("bent"), F.min("k").alias("first"))
    return got.select(F.coalesce("knee", "bent", "first").alias("k"), F.when(F.col("knee").isNotNull(), "knee").when(F.col("bent").isNotNull(), "second_difference").otherwise("first").alias("method"))


def best_k(table: DataFrame) -> DataFrame:
    """k of the best silhouette; the smaller k wins a tie."""
    return table.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"), F.max("silhouette").alias("silhouette"))


def k_summary(search: DataFrame, gaps: DataFrame, bics: DataFrame) -> DataFrame:
    """One row with what each rule says about k."""
    a = search.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("silhouette_k"), F.min("k").alias("k_min"), F.max("k").alias("k_max"))
    b = gap_rule(gaps).select(F.col("k").alias("gap_k"))
    c = bics.agg(F.min_by("k", F.struct("bic", "k")).alias("bic_k"))
    return a.crossJoin(b).crossJoin(c)  # one row each


COLUMNS = (
    "algorithm", "parameters", "n_records", "n_clusters", "noise_fraction", "runtime_seconds", "silhouette", "davies_bouldin", "calinski_harabasz",
    "ari", "nmi", "ami", "fowlkes_mallows", "homogeneity", "completeness", "v_measure", "purity", "source",
)


def standardise(table: DataFrame, source: str, algorithm: str | None = None) -> DataFrame:
    """A result table in the fixed columns: default algorithm, parameters made from k, *_external names undone, missing as null."""
    for c in table.columns:
        if c.endswith("_external") and c[: -len("_external")] not in table.columns:
            table = table.withColumnRenamed(c, c[: -len("_external")])
    there = set(table.columns)
    if "algorithm" not in there:
        table = table.withColumn("algorithm", F.lit(algorithm or source))
    if "parameters" not in there:
        table = table.withColumn("parameters", F.concat(F.lit("k="), F.col("k").cast("string")) if "k" in there else F.lit(""))
    table = table.withColumn("source", F.lit(source))
    text = ("algorithm", "parameters", "source")
    return table.select(*((F.col(c) if c in table.columns else F.lit(None)).cast("string" if c in text else "double").alias(c) for c in COLUMNS))


def unify(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        own = standardise(df, name)
        out = own if out is None else out.unionByName(own)
    return out


def stability_summary(ari: DataFrame, jaccard: DataFrame) -> DataFrame:
    """By k: count and spread of ARI to the reference, mean and least Jaccard, and the worst cluster's mean."""
    a = ari.groupBy("k").agg(F.count("*").alias("runs"), F.avg("ari").alias("ari_mean"), F.stddev_samp("ari").alias("ari_std"), F.min("ari").alias("ari_min"), F.max("ari").alias("ari_max"))
    each = jaccard.groupBy("k", "cluster").agg(F.avg("jaccard").alias("m"))
    worst = each.groupBy("k").agg(F.min("m").alias("worst_cluster_jaccard"), F.max("m").alias("best_cluster_jaccard"))
    mean = jaccard.groupBy("k").agg(F.avg("jaccard").alias("jaccard_mean"), F.min("jaccard").alias("jaccard_min"))
    return a.join(mean, "k", "left").join(worst, "k", "left")


def compare(winner: DataFrame, challenger: DataFrame) -> DataFrame:
    """Differences challenger - winner of one-row tables (Davies-Bouldin so that more is better), how many improve, a verdict."""
    own = winner.select(*(F.col(c).alias(f"w_{c}") for c in (*DIRECTIONS, "ari", "nmi"))).crossJoin(challenger.select(*DIRECTIONS, "ari", "nmi"))  # one row each
    out = own.select(
        (F.col("silhouette") - F.col("w_silhouette")).alias("silhouette_delta"),
        (F.col("w_davies_bouldin") - F.col("davies_bouldin")).alias("davies_bouldin_improvement"),
        (F.col("calinski_harabasz") - F.col("w_calinski_harabasz")).alias("calinski_harabasz_delta"),
        (F.col("ari") - F.col("w_ari")).alias("ari_delta"),
        (F.col("nmi") - F.col("w_nmi")).alias("nmi_delta"),
    )
    better = sum((F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in ("silhouette_delta", "davies_bouldin_improvement", "calinski_harabasz_delta")), F.lit(0))
    return out.withColumn("improved", better.cast("long")).withColumn("conclusion", F.when(F.col("improved") >= 2, "improves").when(F.col("improved") == 1, "mixed").otherwise("does not improve"))


def recommendation(scoreboard: DataFrame, stability: DataFrame) -> DataFrame:
    """The winner and runner-up of a scoreboard, with the winner's stability level, the reasons and the limits of the choice."""
    from cairn.functions.text import silhouette_class, stability_class

    own = scoreboard.join(stability, "algorithm", "left")
    top = own.orderBy("final_order").limit(2)
    first, second = F.col("final_order") == 1, F.col("final_order") == 2
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    got = top.agg(pick(first, "algorithm").alias("winner"), pick(second, "algorithm").alias("runner_up"), pick(first, "silhouette").alias("silhouette"), pick(first, "ari_mean").alias("ari_mean"), pick(second, "rank_score").alias("r2"), pick(first, "rank_score").alias("r1"))
    got = got.select("*", (F.col("r2") - F.col("r1")).alias("rank_margin"), silhouette_class(F.col("silhouette")).alias("structure"), F.coalesce(stability_class(F.col("ari_mean")), F.lit("unknown")).alias("stability"))
    said = lambda text, c: F.concat(F.lit(text), F.col(c).cast("string"))
    reasons = F.array(said("sum of ranks: ", "r1"), F.when(F.col("r2").isNotNull(), said("runner-up's sum of ranks: ", "r2")), said("structure by silhouette: ", "structure"), said("stability: ", "stability"))
    limits = F.array(
        F.when(F.col("runner_up").isNull(), "there was nothing to compare it with"),
        F.when(F.col("rank_margin") == 0, "the runner-up has the same sum of ranks; a tie rule decided"),
        F.when(F.col("silhouette") < 0.25, "clusters overlap: the silhouette is below 0.25"),
        F.when(F.col("ari_mean").isNull(), "agreement between runs wasn't measured"),
        F.when(F.col("ari_mean") < 0.5, "runs agree little: their mean adjusted Rand index is below 0.5"),
        F.lit("internal measures rank partitions; they don't say what the clusters mean"),
    )
    joined = lambda c: F.array_join(F.filter(c, lambda x: x.isNotNull()), "; ")
    return got.select("winner", "runner_up", "rank_margin", "structure", "stability", joined(reasons).alias("reasons"), joined(limits).alias("limitations"))
