"""Helpers shared by the operators: column selection, Arrow batches, tables that cut lineage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python. Long texts make rows large, so it is small.
BATCH_ROWS = 1000
#: Bytes after which a Python operator hands an output batch back.
OUT_BYTES = 4 << 20


def narrow(spark: SparkSession) -> None:
    """Keep Arrow batches small; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What this worker process keeps from task to task, of one operator (its module's name) at a time.
KEPT: dict = {}


def kept(owner: str, key, make: Callable):
    """A cache that outlives its task. A task of another operator in the same process drops it."""
    if (owner, key) not in KEPT:
        KEPT[owner, key] = make()
    return KEPT[owner, key]


def trimmed() -> None:
    """Hand freed memory back to the system, for the next operator's workers and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def begun(owner: str) -> bool:
    """Drop what other operators left in this process, and stop cyclic collection; whether it was on."""
    for key in [k for k in KEPT if k[0] != owner]:
        del KEPT[key]
    was = gc.isenabled()
    gc.disable()
    return was


def ended(was: bool) -> None:
    if was:
        gc.enable()
    trimmed()


def quiet(run: Callable) -> Callable:
    """For the function of a Python operator: no cyclic garbage collection while it runs (tables hold
    millions of objects without cycles, which each collection would visit), no cache of another
    operator beside it, and what it freed is given back at its end."""
    owner = run.__module__

    @functools.wraps(run)
    def calm(batches):
        was = begun(owner)
        try:
            yield from run(batches)
        finally:
            ended(was)

    return calm


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary
    one in local mode (driver and executors are one process there); a cluster must name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_dir()


@functools.cache
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost
    executor costs no recomputation. Returns the table and its path (for ``dropped``)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by ``written`` that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more: it does so when the
    driver's JVM collects garbage, which a driver with much memory does late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sized(rows: Iterable[tuple[tuple, int]], schema: pa.Schema, most: int = OUT_BYTES, most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows; each row comes with a rough size in bytes."""
    held: list[tuple] = []
    total = 0
    for row, size in rows:
        held.append(row)
        total += size + 64
        if total >= most or len(held) >= most_rows:
            yield packed(held, schema)
            held, total = [], 0
    if held:
        yield packed(held, schema)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
