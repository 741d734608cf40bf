"""Helpers shared by the training-data operators: table access, durable intermediate tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's own setting: shuffle files are deleted when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; unset, a folder of our own on one machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage durably: a lost executor re-reads files, it never recomputes what led to them.
    ``Dataset.checkpoint`` would run the plan twice. The plan's shuffle files go as soon as it is written, and with a
    collection the driver's heap shrinks again: left alone it fills up with what finished plans have broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path  # type: ignore[attr-defined]
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_tributary_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast, whatever size Spark takes it for.

    Spark's sizes leave out how many rows an explode or a mapping makes of one, and what compression saves in a file.
    """
    return df.hint("merge")


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]], rows: int = 2000) -> DataFrame:
    """Map ``df`` in Arrow batches of at most ``rows`` rows.

    ``make`` runs once in each task and returns the function that turns lists of the input columns
    into a dict of output columns; what it builds (models, caches) lives as long as the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        fn, arrow = make(), to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cols = [c.to_pylist() for c in batch.slice(at, rows).columns]
                out = fn(*cols)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def map_values(kind: str, make: Callable[[], Callable[[list], list]], rows: int = 2000):
    """An Arrow UDF of one column; ``make`` as in ``map_columns``, its function takes at most ``rows`` values at once."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trim()
        fn = make()
        for batch in batches:
            yield pa.concat_arrays([pa.array(fn(batch.slice(at, rows).to_pylist()), arrow) for at in range(0, len(batch) or 1, rows)])

    return run


def trim() -> None:
    """Give free memory back to the system; a Python worker would keep the most that any task of any stage took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


_only: dict = {}


def only(key, make: Callable[[], object]):
    """What ``make`` builds for ``key``, kept for the next task of this Python worker; whatever was kept before goes.

    Caches of different operators thus never stand in one worker's memory together.
    """
    if _only.get("key") != key:
        forget()
        _only["value"] = make()
        _only["key"] = key
    return _only["value"]


def forget() -> None:
    """Drop what ``only`` keeps, and its memory; for operators that keep nothing and run in workers others have used."""
    if _only:
        _only.clear()
        gc.collect()
    trim()


def crc_fold(key) -> F.Column:
    """crc32 of a key's text, modulo 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4
