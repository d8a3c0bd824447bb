"""Drift of features between two splits: PSI and Kolmogorov-Smirnov over one long table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.profiling import quantile, walked, walked_quantiles
from cairn.runtime import materialize

FLOOR = 1e-8
#: Values of a side up to which the two-sample p is exact; the time is their product.
EXACT_ROWS = 10_000


def steps_of(reference: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walked counts (feature, value, r, c, r_before, c_before) of two (feature, value) tables without their nulls,
    and (feature, r, c) in all. Both tables are read once; everything about drift follows from these counts."""
    counts = _marked(reference, 1, 0).unionByName(_marked(current, 0, 1)).groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    walk, totals = walked(counts, ["r", "c"])
    return materialize(walk, "walk"), materialize(totals, "totals")


def psi_edges(walk: DataFrame, totals: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges, constant): inner edges of distinct linear quantiles of the reference; with fewer than three
    distinct ones equal widths over the joint range, or constant if that has none."""
    quantiles = walked_quantiles(walk, totals, [i / bins for i in range(bins + 1)], "r")
    return _edges(quantiles, walk.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high")), bins)


def _edges(quantiles: DataFrame, span: DataFrame, bins: int) -> DataFrame:
    own = quantiles.select("feature", F.array_sort(F.array_distinct("q")).alias("q")).join(span, "feature")
    width = (F.col("high") - F.col("low")) / bins
    equal = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("low") + i * width)
    inner = F.slice("q", F.lit(2), F.greatest(F.size("q") - 2, F.lit(0)))
    few = F.size("q") < 3
    return own.select("feature", F.when(few, equal).otherwise(inner).alias("edges"), (few & (F.col("low") == F.col("high"))).alias("constant"))


def psi_of(walk: DataFrame, totals: DataFrame, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(feature, psi) of counts (feature, value, r, c), with the edges of :func:`psi_edges` unless others are given."""
    edges = materialize(psi_edges(walk, totals, bins) if edges is None else edges, "edges")
    placed = walk.join(F.broadcast(edges), "feature").select("feature", "r", "c", F.aggregate("edges", F.lit(0), lambda s, e: s + F.when(F.col("value") >= e, 1).otherwise(0)).alias("bin"))  # a row for each feature
    counts = placed.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    sizes = totals.select("feature", F.col("r").alias("nr"), F.col("c").alias("nc"))
    every = edges.select("feature", "constant", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    full = every.join(counts, ["feature", "bin"], "left").join(sizes, "feature")
    r, c = (F.greatest(F.coalesce(x, F.lit(0)) / n, F.lit(FLOOR)) for x, n in ((F.col("r"), F.col("nr")), (F.col("c"), F.col("nc"))))
    out = full.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.bool_or("constant").alias("constant"))
    return out.select("feature", F.when(F.col("constant"), 0.0).otherwise(F.col("psi")).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """(feature, psi) of (feature, value) tables. Bins are [a, b); an empty one counts with a floor of 1e-8.

    With ``accuracy`` the edges come from a mergeable sketch of the reference, and no counts of values are made.
    """
    if not accuracy:
        return psi_of(*steps_of(reference, current), bins)
    rows = _marked(reference, 1, 0).unionByName(_marked(current, 0, 1))
    quantiles = reference.groupBy("feature").agg(quantile("value", [i / bins for i in range(bins + 1)], accuracy).alias("q"))
    sides = rows.groupBy("feature").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
    return psi_of(rows, sides, bins, _edges(quantiles, sides.select("feature", "low", "high"), bins))


def _marked(rows: DataFrame, r: int, c: int) -> DataFrame:
    return rows.where(F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value"), F.lit(r).alias("r"), F.lit(c).alias("c"))


def kolmogorov(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p of a two-sample statistic (a series of 100 terms)."""
    x = d * F.sqrt(n * m / (n + m))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def exact_kolmogorov(d: float, n: int, m: int) -> float:
    """Exact two-sided p of a two-sample statistic: the share of all orders of n and m values whose distance reaches ``d``.

    An order is a lattice path from (0, 0) to (n, m). The last step into (i, j) came from (i - 1, j) with chance
    i / (i + j), so the chance that a path into (i, j) has been outside follows from two neighbours on the diagonal
    before. All terms are positive, so small values keep their digits.
    """
    reach = round(d * n * m)
    if reach <= 0:
        return 1.0
    outside = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        low, high = max(0, s - m), min(n, s)
        i = np.arange(low, high + 1)
        came = np.zeros(high - low + 1)
        first = max(low, 1)
        came[first - low :] = i[first - low :] / s * outside[first - 1 : high]
        stay = i <= s - 1
        came[stay] += (s - i[stay]) / s * outside[i[stay]]
        came[np.abs(i * m - (s - i) * n) >= reach] = 1.0
        outside[low : high + 1] = came
    return float(outside[n])


def with_exact_p(table: DataFrame) -> DataFrame:
    """Rows (feature, ks_statistic, ks_pvalue, nr, nc) with the exact p where both sides have at most ``EXACT_ROWS`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            p = [exact_kolmogorov(r["ks_statistic"], r["nr"], r["nc"]) if max(r["nr"], r["nc"]) <= EXACT_ROWS and min(r["nr"], r["nc"]) > 0 else r["ks_pvalue"] for r in rows]
            yield batch.set_column(batch.schema.names.index("ks_pvalue"), "ks_pvalue", pa.array(p, pa.float64()))

    return table.repartition("feature").mapInArrow(run, table.schema)


def ks_of(walk: DataFrame, totals: DataFrame, method: str = "auto") -> DataFrame:
    """``method`` auto: exact p for small samples, else asymptotic; or asymptotic throughout."""
    sizes = totals.select("feature", F.col("r").alias("nr"), F.col("c").alias("nc"))  # a row for each feature
    apart = F.abs((F.col("r_before") + F.col("r")) / F.col("nr") - (F.col("c_before") + F.col("c")) / F.col("nc"))
    top = walk.join(F.broadcast(sizes), "feature").groupBy("feature").agg(F.max(apart).alias("d"), F.max("nr").alias("nr"), F.max("nc").alias("nc"))
    out = top.select("feature", F.col("d").alias("ks_statistic"), kolmogorov(F.col("d"), F.col("nr"), F.col("nc")).alias("ks_pvalue"), "nr", "nc")
    return (with_exact_p(out) if method == "auto" else out).drop("nr", "nc")


def ks(reference: DataFrame, current: DataFrame, method: str = "auto") -> DataFrame:
    """(feature, ks_statistic, ks_pvalue): distances of the empirical distributions, from counts of distinct values."""
    return ks_of(*steps_of(reference, current), method)


def moments_of(walk: DataFrame, totals: DataFrame) -> DataFrame:
    """(feature, reference_mean, current_mean, reference_std, current_std): population deviations, about the means."""
    v = F.col("value")
    means = walk.groupBy("feature").agg(*((F.sum(v * F.col(s)) / F.sum(s)).alias(f"{name}_mean") for s, name in (("r", "reference"), ("c", "current"))))
    about = walk.join(F.broadcast(means), "feature")  # a row for each feature
    spread = lambda s, name: F.sqrt(F.sum(F.pow(v - F.col(f"{name}_mean"), 2) * F.col(s)) / F.sum(s)).alias(f"{name}_std")
    return about.groupBy("feature", "reference_mean", "current_mean").agg(spread("r", "reference"), spread("c", "current"))


def status(psi_value: Column, d: Column, p: Column) -> Column:
    return F.when(psi_value >= 0.25, "refit").when((psi_value >= 0.10) | ((d >= 0.10) & (p <= 0.01)), "warning").otherwise("stable")


def drift_report(reference: DataFrame, current: DataFrame, bins: int = 10, method: str = "auto") -> DataFrame:
    """One row for each feature: PSI, KS, status, and both sides' mean and population deviation, from one pass over the tables."""
    walk, totals = steps_of(reference, current)
    out = psi_of(walk, totals, bins).join(ks_of(walk, totals, method), "feature").join(moments_of(walk, totals), "feature")
    return out.select("feature", "psi", "ks_statistic", "ks_pvalue", status(F.col("psi"), F.col("ks_statistic"), F.col("ks_pvalue")).alias("status"), "reference_mean", "current_mean", "reference_std", "current_std")


def drift_summary(report: DataFrame) -> DataFrame:
    s = F.col("status")
    return report.agg(F.count_if(s == "stable").alias("n_stable"), F.count_if(s == "warning").alias("n_warning"), F.count_if(s == "refit").alias("n_refit"), F.max("psi").alias("max_psi"), F.max("ks_statistic").alias("max_ks"), F.bool_or(s == "refit").alias("any_refit"))
