"""What the operators share: the shared folder, written tables, column checks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; any
    other master must name one, since executors cannot see the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="cohortspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, what: str, partition_by: str | None = None, keep: bool = False, compression: str = "snappy", count: bool = False, digest: Column | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, is computed once, and outlives lost executors.
    :func:`release` deletes it unless ``keep``. With ``count`` the rows are counted as
    they are written, so that :func:`n_rows`, :func:`small` and :func:`compact` run no
    job of their own; an aggregate given as ``digest`` is then the result's ``digest``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(seen, F.count("*").alias("rows"), *([] if digest is None else [digest.alias("digest")])) if count else df
    writer = watched.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    if not keep:
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    if count:
        out.__dict__.update(_ROWS=seen.get["rows"], digest=seen.get.get("digest"))
    return out


def n_rows(df: DataFrame) -> int:
    """Rows of a table: as counted when it was written, else by a job."""
    found = df.__dict__.get("_ROWS")
    return df.count() if found is None else found


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`materialise` wrote in this application.

    Only for callers whose own results are already stored elsewhere.
    """
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Have the driver collect its garbage.

    Only then does Spark drop the shuffle files and broadcasts that nobody refers to any more,
    and the JVM give back heap that it has grown by. Costs a third of a second.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows of one or two long columns that may be broadcast; larger sets are shuffled.
BROADCAST_ROWS = 300_000
ARROW_ROWS = 512


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows.

    ``df`` should be a written table, whose count costs next to nothing.
    """
    return F.broadcast(df) if n_rows(df) <= rows else df


#: Rows of a few numbers that one task handles without a shuffle.
COMPACT_ROWS = 200_000


def compact(df: DataFrame, rows: int = COMPACT_ROWS) -> DataFrame:
    """A written table of at most ``rows`` rows as one partition, which joins and aggregates need not shuffle."""
    if (n := n_rows(df)) > rows:
        return df
    out = df.coalesce(1)
    out.__dict__["_ROWS"] = n
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows. Spark itself bounds the bytes of those it sends
    (``spark.sql.execution.arrow.maxBytesPerBatch``); the session's settings stay as they are."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text, a null text being empty."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, remainder: int, key: str = "doc_id"):
    """Whether crc32 of the key as text leaves ``remainder``; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == remainder, F.lit(False))
