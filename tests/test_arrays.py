"""Array files, digests of long files, and the exact two-sample p."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import drift
from cairn.sources import arrays
from cairn.sources import tables as io


@pytest.mark.parametrize("packed", [False, True])
def test_npz_is_read_by_ranges(spark, tmp_path, packed):
    rng = np.random.default_rng(0)
    x, y, name = rng.normal(size=(1000, 3)), np.arange(1000, dtype=np.int8) % 5, np.array([f"n{i}" for i in range(1000)])
    (np.savez_compressed if packed else np.savez)(tmp_path / "a.npz", X=x, y=y, name=name, F=np.asfortranarray(x))
    df = arrays.read_arrays(spark, str(tmp_path / "a.npz"), ("X", "y", "name", "F"), rows=170)
    assert df.rdd.getNumPartitions() == 6
    got = sorted(df.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in got] == list(range(1000))
    assert np.array_equal([r["X"] for r in got], x) and np.array_equal([r["F"] for r in got], x)
    assert [r["y"] for r in got] == y.tolist() and [r["name"] for r in got] == name.tolist()


def test_npy_and_missing_arrays(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(10, dtype=np.float32))
    assert sorted(r["value"] for r in arrays.read_arrays(spark, str(tmp_path / "v.npy"), rows=3).collect()) == list(range(10))
    np.savez(tmp_path / "b.npz", X=np.zeros((3, 2)), short=np.zeros(2), cube=np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="lacks Z"):
        arrays.read_arrays(spark, str(tmp_path / "b.npz"), ("X", "Z")).count()
    with pytest.raises(Exception, match="side by side"):
        arrays.read_arrays(spark, str(tmp_path / "b.npz"), ("X", "short")).count()
    with pytest.raises(Exception, match="axes"):
        arrays.read_arrays(spark, str(tmp_path / "b.npz"), ("cube",)).count()


def test_arrays_written_and_read_again(spark, tmp_path):
    df = spark.range(200).select("id", F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v"), (F.col("id") % 3).cast("string").alias("s")).repartition(4)
    arrays.write_arrays(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*.npz"))) == 4
    back = arrays.read_arrays(spark, str(tmp_path / "out")).drop("row")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    arrays.write_arrays(df.limit(5).coalesce(1), str(tmp_path / "out"))
    assert arrays.read_arrays(spark, str(tmp_path / "out")).count() == 5


def test_square_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 5, 0.25), (5, 9, 1.0)], "i long, j long, share double")
    ids = spark.createDataFrame([(1,), (5,), (9,)], "id long")
    got = {r["i"]: r["values"] for r in arrays.square(pairs, ids, "share").collect()}
    assert got == {1: [1.0, 0.25, 0.0], 5: [0.25, 1.0, 1.0], 9: [0.0, 1.0, 1.0]}


def test_long_files_are_streamed(spark, tmp_path):
    (tmp_path / "short").write_bytes(b"abc")
    (tmp_path / "long").write_bytes(b"xyz" * 100_000)
    got = {r["name"]: (r["size_bytes"], r["sha256"]) for r in io.file_manifest(spark, str(tmp_path), whole=1000).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("short", b"abc"), ("long", b"xyz" * 100_000))}


@pytest.mark.parametrize("n,m", [(1, 1), (3, 4), (5, 5), (2, 7), (6, 4)])
def test_exact_p_equals_enumeration(n, m):
    def distance(first):
        i = j = worst = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        return worst

    every = [distance(set(c)) for c in combinations(range(n + m), n)]
    for t in sorted(set(every)):
        assert drift.exact_kolmogorov(t / (n * m), n, m) == pytest.approx(sum(x >= t for x in every) / len(every), rel=1e-12)
    assert drift.exact_kolmogorov(0.0, n, m) == 1.0


def test_exact_p_nears_the_asymptotic_one(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=900), rng.normal(0.08, 1, size=700)
    frame = lambda x: spark.createDataFrame([("f", float(v)) for v in x], "feature string, value double")
    exact, rough = (drift.ks(frame(a), frame(b), method=m).first() for m in ("auto", "asymptotic"))
    assert exact["ks_statistic"] == rough["ks_statistic"]
    assert exact["ks_pvalue"] == pytest.approx(rough["ks_pvalue"], rel=0.1) and exact["ks_pvalue"] != rough["ks_pvalue"]
