"""What several operators share: shared-storage tables, folds, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts larger than this are refused; operators then take a join.
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    Where neither is set a folder of this machine serves a local master; any other is refused,
    as each executor would write to a disk of its own.
    """
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if path is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return path or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Tables written and not deleted yet, by application.
_written: dict[str, set[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def leftovers(spark: SparkSession) -> list[str]:
    """Tables that returned DataFrames still read, as they stand in the shared folder."""
    return sorted(_written.get(spark.sparkContext.applicationId, ()))


def clean(spark: SparkSession) -> None:
    """Delete those tables: call it once the results have been written or are not needed any more."""
    for path in leftovers(spark):
        drop_table(spark, path)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores put before them until none is taken; case does not tell columns apart."""
    lower = {c.lower() for c in taken}
    mark = ""
    while any(f"{mark}{w}".lower() in lower for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def sample_labelled(df: DataFrame, bound: int, key: Column) -> DataFrame:
    """At most `bound` rows, those with the smallest hash of key: a fixed sample however the rows are dealt."""
    return df.orderBy(F.xxhash64(key), key).limit(bound)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over whole batches; fn gets one batch and returns one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)



def release(spark: SparkSession) -> None:
    """Let the JVM drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at a task's end freed memory back to the system: Python workers are kept for the next stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return tidied
