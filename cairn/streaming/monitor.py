"""Streaming use: assignment as a narrow transform, and drift of features by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.operators.drift import FLOOR
from cairn.operators.serving import Registry


def assign_stream(rows: DataFrame, registry: Registry, time: str = "Time", amount: str = "Amount") -> DataFrame:
    """Assignment of a stream: the batch projection, without state."""
    return registry.assign(rows, time=time, amount=amount)


def windowed_bins(long: DataFrame, edges: dict[str, list[float]], event_time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, feature, bin, n) of (event_time, feature, value): counts in the reference's bins, for rows that are
    at most ``late`` behind. ``edges`` are a few numbers for each feature."""
    bins = F.create_map(*(x for f, e in edges.items() for x in (F.lit(f), F.array(*map(F.lit, e)))))
    own = long.withColumn("bin", F.aggregate(bins[F.col("feature")], F.lit(0), lambda s, e: s + F.when(F.col("value") >= e, 1).otherwise(0)))
    return own.withWatermark(event_time, late).groupBy(F.window(event_time, window), "feature", "bin").agg(F.count("*").alias("n"))


def window_psi(counts: DataFrame, reference: dict[str, list[float]]) -> DataFrame:
    """(start, feature, psi) of windowed counts against the reference's shares by bin (written output of the stream).

    A window holds a few bins for each feature; one that it lacks counts with the floor.
    """
    own = counts.select(F.col("window.start").alias("start"), "feature", "bin", "n")
    boxed = own.groupBy("start", "feature").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    shares = F.create_map(*(x for f, s in reference.items() for x in (F.lit(f), F.array(*(F.lit(float(v)) for v in s)))))
    boxed = boxed.withColumn("shares", shares[F.col("feature")])

    def term(r, i):
        c = F.greatest(F.coalesce(F.try_element_at("held", i), F.lit(0)) / F.col("total"), F.lit(FLOOR))
        r = F.greatest(r, F.lit(FLOOR))
        return (c - r) * F.log(c / r)

    return boxed.select("start", "feature", F.aggregate(F.transform("shares", term), F.lit(0.0), lambda a, x: a + x).alias("psi"))
