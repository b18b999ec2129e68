"""New per-sample loci files appended to a cohort as they arrive.

A file source picks up new Parquet files; every micro-batch is written under its
own number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def watch(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)


def ingest(stream: DataFrame, cohort: str, checkpoint: str) -> StreamingQuery:
    """Append what ``stream`` brings to the table ``cohort/alt_bases`` until all that is there is taken."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ingest_batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(f"{cohort}/alt_bases")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sample_counts(stream: DataFrame, cohort_view: str) -> StreamingQuery:
    """Running counts of loci by sample, as an in-memory view."""
    return stream.groupBy("sample_id").agg(F.count("*").alias("n_alt_loci")).writeStream.outputMode("complete").format("memory").queryName(cohort_view).start()
