"""Scalar expressions over experiment tables: parameter text, names, buckets, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_parameter(text: Column, name: str) -> Column:
    """The value of ``name=value`` in a comma-separated parameter text, null if absent."""
    found = F.regexp_extract(text, rf"(?i)(?:^|,)\s*{name}\s*=\s*([^,]+)", 1)
    return F.when(found != "", F.trim(found))


def parse_int(text: Column, name: str, default: int | None = None) -> Column:
    return F.coalesce(parse_parameter(text, name).try_cast("bigint"), F.lit(default).cast("bigint"))


def parse_float(text: Column, name: str, default: float | None = None) -> Column:
    return F.coalesce(parse_parameter(text, name).try_cast("double"), F.lit(default).cast("double"))


def detect_k(k: Column, requested: Column, n_clusters: Column, actual: Column, parameters: Column) -> Column:
    """The first number of clusters that a result row states, else the one in its parameters."""
    return F.coalesce(*(c.cast("bigint") for c in (k, requested, n_clusters, actual)), parse_int(parameters, "k"))


def normalise_algorithm(name: Column, strict: bool = False) -> Column:
    """Family of an algorithm's name: kmeans, hierarchical, dbscan or gmm; else the trimmed lower-case name, or with ``strict`` an error."""
    own = F.lower(F.trim(name))
    holds = lambda *words: F.greatest(*(F.contains(own, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1
    return (
        F.when(holds("kmeans", "k-means", "k_means"), "kmeans")
        .when(holds("hierarch", "agglom", "ward"), "hierarchical")
        .when(holds("dbscan"), "dbscan")
        .when(holds("gmm", "gaussian", "mixture"), "gmm")
        .otherwise(F.raise_error(F.concat(F.lit("unknown algorithm: "), F.coalesce(name, F.lit("null")))) if strict else own)
    )


def buckets(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step whose bound the value reaches; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        out = out.when(value >= bound, name)
    return out.otherwise(otherwise)


def stability_class(v: Column) -> Column:
    return buckets(v, [(0.90, "very high"), (0.75, "high"), (0.50, "moderate")], "low")


def silhouette_class(v: Column) -> Column:
    return buckets(v, [(0.70, "strong"), (0.50, "reasonable"), (0.25, "weak")], "none")


def sensitivity_class(v: Column) -> Column:
    return buckets(v, [(0.90, "low"), (0.70, "moderate")], "high")


def misassignment_class(silhouette: Column) -> Column:
    return F.when(silhouette < 0, "probable_misassignment").when(silhouette <= 0.10, "boundary_case").when(silhouette.isNotNull(), "weakly_separated")


def finite(v: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def markdown(df, limit: int = 20, digits: int = 6) -> str:
    """The first rows of a small frame as a Markdown table (a report, so the limit is the feature)."""
    rows = df.limit(limit).collect()
    show = lambda v: "N/A" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
