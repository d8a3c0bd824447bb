"""Readers and writers: CSV with an explicit schema, Parquet, JSON, optional artifacts, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import urllib.request
from collections.abc import Sequence
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Files up to this many bytes are one value each while they are hashed.
WHOLE_FILE = 1 << 30
RAW_COLUMNS = ("Time", *(f"V{i}" for i in range(1, 29)), "Amount", "Class")


def raw_schema(text: bool = False) -> T.StructType:
    """The transaction table: doubles and an integer label; all text where junk is to be counted first."""
    kind = lambda c: T.StringType() if text else T.IntegerType() if c == "Class" else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in RAW_COLUMNS])


def fetch(urls: Sequence[str], target: str, sha256: str | None = None, timeout: float = 60.0) -> str:
    """Download a file to ``target`` on the driver from the first address that gives it whole; returns that address.

    A file that is already there (with the digest, where one is given) isn't fetched again: the answer is then
    empty. Bytes go to a file beside the target that takes its place at the end, so a broken download leaves
    nothing behind. If no address serves, the error names what went wrong at each.
    """

    def digest(path: str) -> str:
        with open(path, "rb") as data:
            return hashlib.file_digest(data, "sha256").hexdigest()

    if os.path.exists(target) and (sha256 is None or digest(target) == sha256):
        return ""
    failed = []
    for url in urls:
        part = f"{target}.part"
        try:
            with urllib.request.urlopen(url, timeout=timeout) as data, open(part, "wb") as out:
                while block := data.read(1 << 20):
                    out.write(block)
            if sha256 is not None and digest(part) != sha256:
                raise OSError("its digest isn't the expected one")
            if not os.path.getsize(part):
                raise OSError("it is empty")
            os.replace(part, target)
            return url
        except (OSError, ValueError) as error:
            failed.append(f"{url}: {error}")
            if os.path.exists(part):
                os.remove(part)
    raise OSError("; ".join(failed) or "no address given")


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """The record of a run, as one JSON document in whatever store the session writes."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    """A record that :func:`write_record` wrote; empty where there is none."""
    rows = spark.read.text(path).limit(1).collect() if exists(spark, path) else []
    return json.loads(rows[0][0]) if rows else {}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store the session reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one of the schema where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return getattr(reader.option("header", True) if kind == "csv" else reader, kind)(path)


def read_text_optional(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if exists(spark, path) else ""


def read_vectors(spark: SparkSession, path: str, required: Sequence[str], key: str = "row_id") -> DataFrame:
    """A keyed vector table; a missing column is a KeyError, a repeated key a ValueError."""
    df = spark.read.parquet(path)
    missing = [c for c in (key, *required) if c not in df.columns]
    if missing:
        raise KeyError(f"{path} lacks {', '.join(missing)}")
    n, distinct = df.agg(F.count("*"), F.count_distinct(key)).collect()[0]
    if n != distinct:
        raise ValueError(f"{path}: {n - distinct} rows repeat a {key}")
    return df.select(key, *required)


def read_aligned(spark: SparkSession, paths: dict[str, str], key: str = "row_id") -> DataFrame:
    """Keyed tables side by side. Each must have the same keys, once each; else a ValueError says which doesn't."""
    out, first = None, None
    for name, path in paths.items():
        own = read_vectors(spark, path, [c for c in spark.read.parquet(path).columns if c != key], key)
        if out is None:
            out, first = own, name
            continue
        if own.join(out.select(key), key, "left_anti").limit(1).count() or out.join(own.select(key), key, "left_anti").limit(1).count():
            raise ValueError(f"{name} hasn't the same rows as {first}")
        out = out.join(own, key)
    return out


def write(df: DataFrame, path: str, kind: str = "parquet", single: bool = False) -> None:
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    getattr(out.option("header", True) if kind == "csv" else out, kind)(path)


def as_floats(df: DataFrame, *vectors: str) -> DataFrame:
    """Vector columns in single precision, for storage."""
    return df.withColumns({v: F.col(v).cast("array<float>") for v in vectors})


def stream_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any length, in whatever store the session reads, in bounded memory."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    data = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(data)
    finally:
        data.close()


def file_manifest(spark: SparkSession, *paths: str, whole: int = WHOLE_FILE) -> DataFrame:
    """(name, path, size_bytes, modified, sha256) of the files below the paths that exist. Names may repeat, paths don't.

    Tasks hash the files up to ``WHOLE_FILE`` bytes, each as one value. Longer ones can't be a value: the session's file
    system streams them through a digest one after another, in a buffer's memory.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "name string, path string, size_bytes long, modified timestamp, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    told = [F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    short = files.where(F.col("length") <= whole).select(*told, F.sha2("content", 256).alias("sha256"))
    long = files.where(F.col("length") > whole).select(*told).collect()  # the column content isn't read; a row for each long file
    if not long:
        return short
    return short.unionByName(spark.createDataFrame([(*r, stream_digest(spark, r["path"])) for r in long], short.schema))


def environment(spark: SparkSession, packages: Sequence[str] = ("pyspark", "pyarrow", "pandas", "numpy")) -> DataFrame:
    """(name, version) of Python and packages; null where one isn't installed."""

    def found(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    return spark.createDataFrame([("python", platform.python_version()), *((p, found(p)) for p in packages)], "name string, version string")


def preflight(spark: SparkSession, paths: Sequence[str], python: tuple[int, int] = (3, 11)) -> list[str]:
    """What is missing before a run; empty if nothing."""
    own = tuple(int(x) for x in platform.python_version_tuple()[:2])
    return ([f"Python {own[0]}.{own[1]} is below {python[0]}.{python[1]}"] if own < python else []) + [f"missing: {p}" for p in paths if not exists(spark, p)]
