"""Plans and shapes that must hold at size: no one-partition windows over data, sketches close to exact."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import cleaning, drift, profiling, scaling


def test_sketches_are_close(spark):
    rows = spark.range(20_000).select((F.col("id") * 37 % 20_000).cast("double").alias("x"))
    exact, fast = (profiling.column_profile(rows, ["x"], a).collect()[0] for a in (None, 10_000))
    assert fast["median"] == pytest.approx(exact["median"], rel=1e-2) and fast["n_distinct"] == pytest.approx(exact["n_distinct"], rel=0.1)
    assert profiling.eda_summary(rows, ["x"], 10_000).collect()[0]["iqr"] == pytest.approx(10_000, rel=1e-2)
    a, b = (scaling.fit_columns(rows, ["x"], True, acc).collect()[0]["scale"] for acc in (None, 10_000))
    assert a == pytest.approx(b, rel=1e-2)
    long = rows.select(F.lit("x").alias("feature"), F.col("x").alias("value"))
    moved = long.withColumn("value", F.col("value") + 4000)
    e, s = (drift.psi(long, moved, accuracy=acc).collect()[0]["psi"] for acc in (None, 10_000))
    assert e == pytest.approx(s, rel=0.05)


def test_dense_key_has_no_single_partition_window(spark):
    rows = spark.range(0, 5_000, 1, 8).select((F.col("id") * 7 % 5_000).alias("k"))
    plan = cleaning.dense_key(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the offsets of the ranges
    hot = spark.range(3_000).select(F.col("id"), F.when(F.col("id") < 2_900, "hot").otherwise("rare").alias("label"))
    split = cleaning.stratified_split(hot, "label", 0.75, 1, "id")
    got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert got == {("hot", "train"): 2175, ("hot", "test"): 725, ("rare", "train"): 75, ("rare", "test"): 25}


def test_stratified_split_keeps_null_labels(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id long, label string")
    assert cleaning.stratified_split(rows, "label", 0.5, 1, "id").count() == 40
