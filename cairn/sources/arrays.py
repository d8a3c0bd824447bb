"""Array files (.npy, .npz) as a Spark data source: read by ranges of rows, written as one file for each task.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("arrays").option("arrays", "X,y").load(path)      # row, X array<double>, y double
    df.write.format("arrays").mode("overwrite").save(folder)            # part-*.npz with an array for each column

A path is a file or a folder of files; rows of several files follow each other by name. The arrays of one
file must have as many rows as each other; one that is asked for and missing is an error that names it.
A task maps an .npy file, or streams an .npz member to its first row, so it holds a batch of rows only.
Files must be where every executor can open them: a shared folder, or the driver's in local mode.
"""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, LongType, StringType, StructField, StructType

ROWS, BATCH = 100_000, 4096


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") or "/"


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".npy", ".npz")) and not f.startswith((".", "_")))
    return [path]


def _header(data) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(data)
    return np.lib.format.read_array_header_1_0(data) if version == (1, 0) else np.lib.format.read_array_header_2_0(data)


def describe(file: str) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    """Shape and kind of each array of a file, from its headers only."""
    if file.endswith(".npy"):
        with open(file, "rb") as data:
            shape, _, kind = _header(data)
        return {"value": (shape, kind)}
    out = {}
    with zipfile.ZipFile(file) as box:
        for name in box.namelist():
            with box.open(name) as data:
                shape, _, kind = _header(data)
            out[name.removesuffix(".npy")] = (shape, kind)
    return out


def _spark_type(shape: tuple[int, ...], kind: np.dtype) -> DataType:
    one = StringType() if kind.kind in "US" else BooleanType() if kind.kind == "b" else LongType() if kind.kind in "iu" else DoubleType()
    if kind.kind not in "USbiuf" or len(shape) > 2:
        raise ValueError(f"arrays of {kind} with {len(shape)} axes can't be columns")
    return ArrayType(one) if len(shape) == 2 else one


def _blocks(file: str, name: str, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows start to stop of one array, some at a time."""
    if file.endswith(".npy"):
        own = np.load(file, mmap_mode="r", allow_pickle=False)
        for at in range(start, stop, BATCH):
            yield np.asarray(own[at : min(at + BATCH, stop)])
        return
    with zipfile.ZipFile(file) as box, box.open(f"{name}.npy") as data:
        shape, by_column, kind = _header(data)
        if by_column and len(shape) > 1:  # columns one after another: rows can't be streamed
            whole = np.frombuffer(data.read(), kind).reshape(shape, order="F")
            for at in range(start, stop, BATCH):
                yield whole[at : min(at + BATCH, stop)]
            return
        width = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        data.seek(data.tell() + start * width)
        for at in range(start, stop, BATCH):
            n = min(at + BATCH, stop) - at
            yield np.frombuffer(data.read(n * width), kind).reshape(n, *shape[1:])


@dataclass
class Rows(InputPartition):
    file: str
    start: int
    stop: int
    first: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, [f.name for f in schema.fields if f.name != "row"]

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        step = int(self.options.get("rows", ROWS))
        for file in _files(self.options["path"]):
            told = describe(file)
            lengths = {told[n][0][0] if told[n][0] else 1 for n in self.names}
            if len(lengths) > 1:
                raise ValueError(f"{file}: arrays of {sorted(lengths)} rows don't stand side by side")
            n = lengths.pop() if lengths else 0
            out += [Rows(file, at, min(at + step, n), first + at) for at in range(0, n, step)]
            first += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        row = partition.first
        for parts in zip(*(_blocks(partition.file, n, partition.start, partition.stop) for n in self.names)):
            n = len(parts[0])
            columns = [pa.array(np.arange(row, row + n))]
            for own in parts:
                own = own.astype(np.int64) if own.dtype.kind in "iu" else own.astype(np.float64) if own.dtype.kind == "f" else own
                flat = pa.array(own.ravel().tolist() if own.dtype.kind in "USb" else own.ravel())
                columns.append(flat if own.ndim == 1 else pa.FixedSizeListArray.from_arrays(flat, own.shape[1]).cast(pa.list_(flat.type)))
            yield pa.RecordBatch.from_arrays(columns, ["row", *self.names])
            row += n


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class ArrayWriter(DataSourceWriter):
    """A task writes its rows beside their place; the files get their names when all tasks are done."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = _local(options["path"]), schema, overwrite

    def write(self, rows: Iterator) -> Written:
        import uuid

        columns: dict[str, list] = {f.name: [] for f in self.schema.fields}
        n = 0
        for r in rows:
            for f in self.schema.fields:
                columns[f.name].append(r[f.name])
            n += 1
        if not n:
            return Written("", 0)
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f"_{uuid.uuid4().hex}.npz")
        np.savez(file, **{f.name: np.array(columns[f.name], self._kind(f)) for f in self.schema.fields})
        return Written(file, n)

    def _kind(self, field: StructField):
        one = field.dataType.elementType if isinstance(field.dataType, ArrayType) else field.dataType
        return np.int64 if isinstance(one, IntegralType) else np.float32 if isinstance(one, FloatType) else np.float64 if not isinstance(one, (StringType, BooleanType)) else None

    def commit(self, messages: list[Written | None]) -> None:
        kept = [m.file for m in messages if m and m.rows]
        os.makedirs(self.path, exist_ok=True)
        old = [f for f in _files(self.path)]
        if self.overwrite:
            for file in old:
                os.remove(file)
            old = []
        for k, file in enumerate(kept, len(old)):
            os.replace(file, os.path.join(self.path, f"part-{k:05d}.npz"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.file and os.path.exists(m.file):
                os.remove(m.file)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _wanted(self) -> list[str]:
        return [n.strip() for n in self.options.get("arrays", "").split(",") if n.strip()]

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files or not os.path.exists(files[0]):
            raise FileNotFoundError(self.options["path"])
        told = describe(files[0])
        names = self._wanted() or list(told)
        if missing := [n for n in names if n not in told]:
            raise KeyError(f"{files[0]} lacks {', '.join(missing)}")
        return StructType([StructField("row", LongType()), *(StructField(n, _spark_type(*told[n])) for n in names)])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    from cairn.runtime import ship

    ship(spark)
    spark.dataSource.register(ArrayFiles)


def read_arrays(spark: SparkSession, path: str, required: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Array files as (row, arrays...); an array that is required and missing is a KeyError in the message."""
    register(spark)
    return spark.read.format("arrays").option("arrays", ",".join(required)).option("rows", rows).load(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """A folder of .npz files, one for each partition that has rows."""
    register(df.sparkSession)
    df.write.format("arrays").mode("overwrite").save(path)


def square(pairs: DataFrame, ids: DataFrame, value: str, diagonal: float = 1.0) -> DataFrame:
    """(i, values) for half a symmetric table (i, j, value): a row for each id, with values in the order of ids, zero where absent.

    A row of the square is one value, so ``ids`` is a sample that a row can hold.
    """
    n = ids.count()
    at = ids.select("id").distinct()
    both = pairs.select("i", "j", F.col(value).cast("double").alias("x")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).cast("double").alias("x")))
    both = both.unionByName(at.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(diagonal)).alias("x")))
    order = ids.sparkSession.createDataFrame([(r["id"], k) for k, r in enumerate(at.orderBy("id").collect())], "j long, at int")  # the sample's ids
    cells = F.map_from_entries(F.collect_list(F.struct("at", "x")))
    made = both.join(F.broadcast(order), "j").groupBy("i").agg(cells.alias("m"))
    return made.select("i", F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("values"))
