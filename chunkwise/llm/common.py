"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow chunks, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python hold at most this many rows, so very long texts stay affordable.
ARROW_ROWS = 256
#: Python gathers batches until it has about this many bytes of text, then works on them at once.
CHUNK_BYTES = 1 << 19
#: Shuffles by a fixed number of partitions give each about this much, as far as the plan's size is known.
PARTITION_BYTES = 128 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where the session has none, one of its own on a local master, else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="chunkwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: its shared folder is no longer ours to clean
        return


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``_`` stands for ``.``) that hold inside only."""
    named = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Survives lost executors, as the committed files belong to no executor;
    the shuffles that made it go once it is committed.  ``drop`` removes the
    folder, at the latest the end of the driver's Python does.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/chunkwise/{label}-{uuid.uuid4().hex[:12]}"
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.options(**options).parquet(path)
    # executors keep broadcast tables until the driver's JVM has collected the plans that sent them
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = (path, atexit.register(lambda: _remove(spark, path)))
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for table in tables:
        path, remove = table.scratch
        atexit.unregister(remove)
        _remove(table.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch for the session's Python stages; smaller bounds of the session stay.

    Results are lazy, so the bounds must outlast this call.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", 8 * CHUNK_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def plan_bytes(rows: DataFrame) -> int:
    """Bytes of the files and tables that ``rows`` are read from; what joins make of them is not foreseen."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def partitions(rows: DataFrame) -> int:
    """Partitions for a shuffle of ``rows`` by a fixed number: the session's, or more where the size of their sources asks for it."""
    size, asked = plan_bytes(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # relations of unknown size count as endless
    return max(asked, -(-size // PARTITION_BYTES)) if size < 1 << 60 else asked


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for later tasks, beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Arrow batches joined until ``column`` holds ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
        held = []
    give_back()


def raw(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and the rows' offsets; null counts as empty."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    size = int(offsets[-1])
    data = np.frombuffer(array.buffers()[2], np.uint8, size) if size else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]
