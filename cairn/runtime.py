"""Session defaults and the shared scratch folder that long plans are cut with.

A plan that is used twice, or that grows in a loop, is written as Parquet below the folder
named by ``spark.checkpoint.dir`` and read again. That folder is shared by the driver and
all executors, so the table survives the loss of any of them. Nothing here writes to a
machine-local folder unless the session names none (tests on ``local[n]``).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows that Spark sends to a Python worker at once, where the session leaves Spark's default: texts are long.
BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
#: The same for the bytes of a batch.
BYTES_CONF, BYTES_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16000000b"
#: The same for the rows that a scan decodes at once: a column of 4,096 texts is an array of tens of MB, doubled as it grows.
READ_CONF, READ_DEFAULT, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "4096", "512"
_owned: list[tuple[SparkSession, str]] = []


def build_session(app: str = "cairn", master: str | None = None, shuffle: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults this library is written for; a cluster passes its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once for each Spark application.

    Where the session has Spark's default number of rows in an Arrow batch, it gets ``BATCH_ROWS``; ``BATCH_BYTES`` and ``READ_ROWS`` likewise.
    """
    context = spark.sparkContext
    for conf, default, own in ((BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS), (BYTES_CONF, BYTES_DEFAULT, BATCH_BYTES), (READ_CONF, READ_DEFAULT, READ_ROWS)):
        if spark.conf.get(conf, default) == default:
            spark.conf.set(conf, own)
    if getattr(context, "_cairn_shipped", False):
        return
    package = Path(__file__).resolve().parent
    handle, target = tempfile.mkstemp(prefix="cairn-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    context._cairn_shipped = True


def give_back() -> None:
    """Return the memory that this process has freed to the system; the C library keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, in workers that later tasks use again: what a task has freed goes back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: the session's setting, or in local mode one of our own where it is unset."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors of {master} share")
        root = tempfile.mkdtemp(prefix="cairn-scratch-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_owned() -> None:
    for spark, path in _owned:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone at exit; the folder is then the cluster's to sweep
            pass


atexit.register(_delete_owned)


def materialize(df: DataFrame, label: str = "table", schema_from: DataFrame | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it (lineage is cut).

    Where rows are large, ``row_group`` is the number of them that are written, and later read, together.
    The folder is removed when the process ends, or earlier with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cairn-{label}-{uuid.uuid4().hex}"
    _owned.append((spark, path))
    writer = df.write
    if row_group:
        writer = writer.option("parquet.block.row.count.limit", row_group)
    writer.parquet(path)
    out = spark.read.schema((schema_from or df).schema).parquet(path)
    out._cairn_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame returned by :func:`materialize`; no plan may read it any more."""
    path = getattr(df, "_cairn_path", None)
    if path:
        _delete(df.sparkSession, path)
        _owned[:] = [x for x in _owned if x[1] != path]


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; by itself it waits until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
