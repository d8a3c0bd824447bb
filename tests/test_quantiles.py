"""Exact quantiles by selection, and cells of run pairs by products."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import agreement, quantiles
from cairn.runtime import ship

SHARES = [0.0, 0.01, 0.25, 0.5, 0.731, 0.95, 1.0]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(11)
    return {
        "even": rng.random(3000), "heavy": rng.normal(size=2000) ** 5 * 1e6, "tied": np.repeat([1.0, 2.0, 7.0], [1500, 3, 900]), "one": np.array([4.0]), "two": np.array([1.0, 9.0]),
        "whole": rng.integers(0, 40, 2500).astype(float), "same": np.full(800, -2.5),
    }


@pytest.mark.parametrize("accuracy,limit", [(10_000, 100_000), (50, 100_000), (50, 30)])
def test_selected_quantiles_equal_sorted_ones(spark, values, accuracy, limit):
    rows = [(k, None if i % 97 == 5 and len(v) > 100 else float(x)) for k, v in values.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows + [(None, 3.0), (None, 5.0), ("void", None)], "key string, x double").repartition(5)
    got = {r["key"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(frame, ["key"], "x", SHARES, accuracy, limit).collect()}
    assert set(got) == {*values, None}
    for k in values:
        own = np.array([x for key, x in rows if key == k and x is not None])
        assert got[k][0] == len(own)
        assert got[k][1] == pytest.approx(np.quantile(own, SHARES).tolist(), rel=1e-12, abs=1e-9)
    assert got[None][1][3] == 4.0


def test_quantiles_without_keys_and_of_nothing(spark):
    frame = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert quantiles.exact_quantiles(frame, [], "x", [0.5, 0.99]).first()["q"] == [50.0, 99.0]
    assert quantiles.exact_quantiles(frame.where("false"), [], "x", [0.5]).count() == 0


def test_a_sketch_that_is_off_is_noticed(spark):
    frame = spark.range(20_000).select((F.col("id") * 7 % 20_000).cast("double").alias("x"))
    got = quantiles.exact_quantiles(frame, [], "x", [0.37], accuracy=20, margin=0.0).first()["q"]
    assert got == [pytest.approx(np.quantile(np.arange(20_000), 0.37))]


@pytest.mark.parametrize("every,codes", [(False, 4096), (True, 4096), (False, 8), (True, 8)])
def test_cells_of_run_pairs(spark, every, codes):
    ship(spark)
    rng = np.random.default_rng(3)
    labels = {f"r{k}": {int(i): int(rng.integers(-1, 2 + k)) for i in range(200) if (i + k) % 11} for k in range(5)}
    runs = spark.createDataFrame([(i, r, c) for r, own in labels.items() for i, c in own.items()], "id long, run_id string, cluster long").repartition(3)
    got = {(r["left"], r["right"], r["cluster"], r["label"]): r["n"] for r in agreement.run_cells(runs, every, codes).collect()}
    pairs = [(a, b) for a in labels for b in labels] if every else list(combinations(labels, 2))
    want = {}
    for a, b in pairs:
        for i in labels[a].keys() & labels[b].keys():
            key = (a, b, labels[a][i], labels[b][i])
            want[key] = want.get(key, 0) + 1
    assert got == want
