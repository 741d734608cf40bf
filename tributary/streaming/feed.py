"""A feed of changed modules: each micro-batch analyses what is new and appends its rows.

A definition that has been analysed with the same hash is left out; files a batch writes carry its id, so a batch
that is run again after a failure replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.tables import definition_hash
from tributary.plans.session import Config, LineageSession
from tributary.schemas import DDL
from tributary.sources import files


def read_feed(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files with rows ``(file, batch, text)``."""
    return spark.readStream.schema("file string, batch int, text string").option("maxFilesPerTrigger", per_trigger).parquet(path)


def start(feed: DataFrame, out: str, checkpoint: str, config: Config | None = None, context: list | None = None) -> StreamingQuery:
    """Analyse the feed into tables below ``out``; ``context`` holds catalog entries that are known beforehand."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("hash", definition_hash(F.col("text"))).dropDuplicates(["file", "batch", "hash"])
        try:
            done = spark.read.parquet(f"{out}/_seen").where(F.col("batch_id") != batch_id)
            fresh = fresh.join(done.select("file", "batch", "hash").distinct(), ["file", "batch", "hash"], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh = fresh.select("file", "batch", "text", "hash")
        if not fresh.isEmpty():
            session = LineageSession.from_scripts(spark, fresh.select("file", "batch", "text"), config, extra=context or [])
            for name, df in session.run_all().items():
                if name in DDL:
                    df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        fresh.select("file", "batch", "hash").write.mode("overwrite").parquet(f"{out}/_seen/batch_id={batch_id}")

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries_context(spark: SparkSession, rows: DataFrame) -> list:
    return [files.unpack(r) for r in rows.collect()]
