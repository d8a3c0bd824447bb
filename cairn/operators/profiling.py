"""Column profiles, summaries, correlation and data behind plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.quantiles import exact_quantiles
from cairn.runtime import materialize


def g1(c: str) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def g2(c: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def quantile(c: str | Column, share, accuracy: int | None = None) -> Column:
    """Exact interpolated quantiles, or with ``accuracy`` those of a mergeable sketch (bounded memory at any size)."""
    if accuracy:
        return F.percentile_approx(c, share, accuracy).cast("array<double>" if isinstance(share, (list, tuple)) else "double")
    return F.percentile(c, F.array(*map(F.lit, share)) if isinstance(share, (list, tuple)) else share)


def _long(rows: DataFrame, columns: Sequence[str], measures) -> DataFrame:
    """A row for each column from one aggregation over all of them."""
    made = rows.agg(F.array(*(F.struct(F.lit(c).alias("feature"), *(m.alias(n) for n, m in measures(c).items())) for c in columns)).alias("a"))
    return made.select(F.inline("a"))


def unpivot(rows: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each id and column, in a single pass (an array in the same row, exploded)."""
    boxed = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns))
    return rows.select(*ids, F.explode(boxed).alias("_x")).select(*ids, f"_x.{name}", f"_x.{value}")


def row_to_long(row: DataFrame, suffix: str = "", columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, value) of a wide row (or of each, if there are several): columns that end with ``suffix``, named without it."""
    names = [c for c in (columns or row.columns) if c.endswith(suffix) and len(c) > len(suffix)]
    boxed = F.array(*(F.struct(F.lit(c[: len(c) - len(suffix)]).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in names))
    return row.select(F.inline(boxed if names else boxed.cast("array<struct<feature:string,value:double>>")))


def value_counts_of(long: DataFrame) -> DataFrame:
    """(feature, value, n) of a (feature, value) table without its nulls, combined before the shuffle."""
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))


def walked(counts: DataFrame, sums: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(feature, value) counts in order, and (feature, total...) of them.

    Each of the columns ``sums`` gets a running total ``<column>_before`` of the smaller values of its
    feature. Ranges of (feature, value) are walked each by itself, from the sums of the ranges before: no
    task walks a whole feature, however many distinct values it has.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counts.repartitionByRange(n, "feature", "value").withColumn("part", F.spark_partition_id()), "steps")
    parts = dealt.groupBy("feature", "part").agg(*(F.sum(c).alias(c) for c in sums))
    order = Window.partitionBy("feature").orderBy("part")  # a row for each range
    before = parts.select("feature", "part", *((F.sum(c).over(order) - F.col(c)).alias(f"{c}_ahead") for c in sums))
    running = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    walk = dealt.select("*", *((F.sum(c).over(running) - F.col(c)).alias(f"{c}_own") for c in sums)).join(F.broadcast(before), ["feature", "part"])  # rows of ranges
    walk = walk.select(*counts.columns, *((F.col(f"{c}_own") + F.col(f"{c}_ahead")).alias(f"{c}_before") for c in sums))
    return walk, parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in sums))


def walked_quantiles(walk: DataFrame, totals: DataFrame, shares: Sequence[float], count: str = "n") -> DataFrame:
    """(feature, q): exact interpolated quantiles, by the ranks around each, from a walked table."""
    share = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)))).alias("s")
    wanted = totals.where(F.col(count) > 0).select("feature", ((F.col(count) - 1).cast("double")).alias("last"), share).select("feature", "s.i", (F.col("last") * F.col("s.p")).alias("at"))
    wanted = wanted.withColumns({"low": F.floor("at"), "high": F.ceil("at")})  # a row for each feature and share
    near = walk.where(F.col(count) > 0).select(F.col("feature").alias("of"), "value", F.col(f"{count}_before").alias("first"), (F.col(f"{count}_before") + F.col(count)).alias("stop"))
    inside = lambda c: (F.col(c) >= F.col("first")) & (F.col(c) < F.col("stop"))
    hit = near.join(F.broadcast(wanted), (F.col("of") == F.col("feature")) & (inside("low") | inside("high")))
    found = hit.groupBy("feature", "i", "at", "low", "high").agg(F.max(F.when(inside("low"), F.col("value"))).alias("a"), F.max(F.when(inside("high"), F.col("value"))).alias("b"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b"))
    return found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))).alias("x")).select("feature", F.transform("x", lambda s: s["q"]).alias("q"))


def value_steps(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """(feature, n_distinct, q): distinct values and exact quantiles, both from one walk over counts of equal values, or both from sketches.

    Profiles ask for many quantiles of columns with repeated values: one walk gives all of them, where selection pays for each.
    """
    long = unpivot(rows, columns)
    if accuracy:
        return long.groupBy("feature").agg(F.approx_count_distinct("value").alias("n_distinct"), quantile("value", list(shares), accuracy).alias("q"))
    walk, totals = walked(value_counts_of(long).withColumn("d", F.lit(1).cast("long")), ["n", "d"])
    every = rows.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    known = totals.select("feature", F.col("d").alias("n_distinct")).join(walked_quantiles(walk, totals, shares), "feature")
    return every.join(F.broadcast(known), "feature", "left").select("feature", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "q")  # a row for each column


def column_profile(rows: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """n, missing, distinct, duplicates and moments for each column; distinct and median from sketches with ``accuracy``."""

    def measures(c: str) -> dict[str, Column]:
        n, there = F.count("*"), F.count(c)
        return {"n": n, "n_missing": n - there, "missing_percent": (n - there) * 100.0 / n, "min": F.min(c).cast("double"), "max": F.max(c).cast("double"), "mean": F.avg(c), "std": F.stddev_samp(c), "skew": g1(c)}

    out = _long(rows, columns, measures).join(value_steps(rows, columns, [0.5], accuracy), "feature")
    spare = F.col("n") - F.col("n_distinct") - F.when(F.col("n_missing") > 0, 1).otherwise(0)
    return out.select("feature", "n", "n_missing", "missing_percent", "n_distinct", spare.alias("n_duplicates"), "min", "max", "mean", F.get("q", F.lit(0)).alias("median"), "std", "skew")


def eda_summary(rows: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    shares = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}

    def measures(c: str) -> dict[str, Column]:
        return {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c).cast("double"), "max": F.max(c).cast("double"), "skew": g1(c), "kurtosis": g2(c)}

    out = _long(rows, columns, measures).join(value_steps(rows, columns, list(shares.values()), accuracy), "feature")
    q = [F.get("q", F.lit(i)) for i in range(len(shares))]
    return out.select("feature", "n", "mean", "std", "min", *(v.alias(name) for name, v in zip(shares, q)), "max", "skew", "kurtosis", (q[4] - q[2]).alias("iqr"))


def scaler_summary(rows: DataFrame, columns: Sequence[str], scaler: str) -> DataFrame:
    out = _long(rows, columns, lambda c: {"mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "max": F.max(c)}).join(value_steps(rows, columns, [0.25, 0.5, 0.75]), "feature")
    q = [F.get("q", F.lit(i)) for i in range(3)]
    return out.select("feature", "mean", "std", q[1].alias("median"), q[0].alias("q25"), q[2].alias("q75"), "min", "max", F.lit(scaler).alias("scaler"))


def informative_features(rows: DataFrame, columns: Sequence[str], count: int = 8, preferred: Sequence[str] = ()) -> DataFrame:
    """(position, feature, spread): preferred ones first, then by interquartile range; none without spread."""
    steps = value_steps(rows, columns, [0.25, 0.75])
    spread = steps.select("feature", (F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("spread")).where("spread > 0")
    rank = F.lit(len(preferred))
    for i, name in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("feature") == name, i).otherwise(rank)
    order = Window.orderBy(rank, F.desc("spread"), "feature")  # a row for each column
    return spread.withColumn("position", F.row_number().over(order)).where(F.col("position") <= count).select("position", "feature", "spread")


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows in which both have a value; null without spread."""
    of = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x).cast("double")))
    return F.try_divide(F.covar_pop(a, b), of(a, b) * of(b, a))


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, r) for every ordered pair, from one aggregation; r is null without spread."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    made = rows.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (pearson(a, b) if a != b else F.when(F.stddev_pop(a) > 0, 1.0)).alias("r")) for a, b in pairs)).alias("x"))
    half = made.select(F.inline("x"))
    whole = half.select(F.col("a").alias("left"), F.col("b").alias("right"), "r")
    return whole.unionByName(half.where("a <> b").select(F.col("b").alias("left"), F.col("a").alias("right"), "r"))


def t_two_sided(r: float, n: int) -> float:
    """p of a Pearson r on n rows: the regularised incomplete beta function at 1 - r*r, by continued fraction."""
    if n < 3 or abs(r) >= 1:
        return 1.0 if n < 3 else 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(p: float, q: float, y: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (p + q) * y / (p + 1))
        out = d
        for m in range(1, 500):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def critical_r(n: int, alpha: float = 0.01) -> float:
    """The least |r| on n rows whose two-sided p is at most alpha (bisection)."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if t_two_sided(mid, n) <= alpha else (mid, high)
    return high


def correlation_significance(rows: DataFrame, columns: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """(left, right, n, r, p_value, significant, masked) off the diagonal: p is two-sided, of the rows in which
    both have a value; ``masked`` is r where it is significant, else null."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"), pearson(a, b).alias("r")) for a, b in pairs]
    out = []
    for x in rows.agg(F.array(*both).alias("x")).collect()[0]["x"] if pairs else []:  # a row for each pair of columns
        known = x["r"] is not None and not math.isnan(x["r"]) and x["n"] >= 3
        r = x["r"] if known else None
        p = t_two_sided(r, x["n"]) if known else None
        out += [(a, b, x["n"], r, p, bool(known and p <= alpha), r if known and p <= alpha else None) for a, b in ((x["a"], x["b"]), (x["b"], x["a"]))]
    return rows.sparkSession.createDataFrame(out, "left string, right string, n long, r double, p_value double, significant boolean, masked double")


def histogram(rows: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """(bin, n) over equal widths between minimum and maximum; the maximum is in the last bin."""
    low, high = rows.agg(F.min(column), F.max(column)).collect()[0]
    if low is None:
        return rows.sparkSession.createDataFrame([], "bin long, n long")
    width = (high - low) / bins or 1.0
    bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("long")
    return rows.where(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def grid_counts(rows: DataFrame, x: str, y: str, size: int = 70) -> DataFrame:
    """(gx, gy, n, log_n): counts on a square grid, the data of a density plot."""
    a, b, c, d = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).collect()[0]
    cell = lambda v, low, high: F.least(F.floor((F.col(v) - low) / ((high - low) / size or 1.0)), F.lit(size - 1)).cast("long")
    out = rows.groupBy(cell(x, a, b).alias("gx"), cell(y, c, d).alias("gy")).agg(F.count("*").alias("n"))
    return out.withColumn("log_n", F.log10(F.col("n").cast("double")))


def box_statistics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, quartiles and the whiskers at 1.5 interquartile ranges, as far as there are values."""
    steps = value_steps(rows, columns, [0.25, 0.5, 0.75])
    q = steps.select("feature", *(F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "median", "q75"))))
    inside = unpivot(rows, columns).join(F.broadcast(q), "feature").where("value >= q25 - 1.5 * (q75 - q25) and value <= q75 + 1.5 * (q75 - q25)")  # a row for each column
    whiskers = inside.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return q.join(whiskers, "feature", "left")


def quantile_plot(rows: DataFrame, column: str, steps: int = 99) -> DataFrame:
    """(share, empirical, theoretical): quantiles of a column beside those of a normal with its mean and deviation."""
    from statistics import NormalDist

    shares = [i / (steps + 1) for i in range(1, steps + 1)]
    z = [NormalDist().inv_cdf(p) for p in shares]
    lit = lambda xs: F.array(*map(F.lit, xs))
    own = exact_quantiles(rows, [], column, shares).select("q")
    made = own.crossJoin(F.broadcast(rows.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))))  # one row each
    point = F.explode(F.arrays_zip(lit(shares).alias("share"), F.col("q").alias("empirical"), lit(z).alias("z"))).alias("p")
    return made.select("m", "s", point).select("p.share", "p.empirical", (F.col("m") + F.col("s") * F.col("p.z")).alias("theoretical"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
