"""Merging per-sample tables into a cohort: a folder with one Parquet table for each name.

Loci, reads and coverage are laid out by chromosome and sorted by sample and
place within files, so that region and sample filters skip row groups.
"""

from __future__ import annotations

import platform
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .cohort import samples

#: Which table a file belongs to, by its name; the first suffix that fits.
ROUTES = ((".coverage.intervals.parquet", "coverage_intervals"), (".normal_evidence.parquet", "normal_evidence"), (".pon_evidence.parquet", "pon_evidence"), (".coverage.parquet", "coverage"), (".reads.parquet", "alt_reads"), ("", "alt_bases"))


def route(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    if name.endswith(".duckdb"):
        raise ValueError("a cohort is a folder of tables here; export the database's tables first")
    return next(table for suffix, table in ROUTES if name.endswith(suffix))


def union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files' rows; the first file's columns are the table's, and others may not have more."""
    first = spark.read.parquet(paths[0])
    out = first
    for path in paths[1:]:
        one = spark.read.parquet(path)
        more = sorted(set(one.columns) - set(first.columns))
        if more:
            raise ValueError(f"{path} has columns that the first file lacks: {', '.join(more)}")
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def _provenance(df: DataFrame, kind: str) -> DataFrame:
    who = F.col("sample_id") if "sample_id" in df.columns else F.col("tumor_sample_id")
    meta = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified_at"), who.alias("who"))
    out = meta.groupBy("path").agg(F.first("size").alias("size_bytes"), F.first("modified_at").alias("modified_at"), F.count_distinct("who").alias("n_samples"), F.count("*").alias("n_rows"))
    return out.select(F.col("path").alias("input_path"), F.lit(kind).alias("kind"), "size_bytes", "modified_at", "n_samples", "n_rows", F.lit(None).cast("string").alias("checksum_sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def merge(spark: SparkSession, inputs: list[str], output: str, command: str = "merge") -> dict[str, str]:
    """Write the cohort of ``inputs``; the paths of its tables by name. The output may not exist."""
    if not inputs:
        raise ValueError("nothing to merge")
    if exists(spark, output):
        raise ValueError(f"{output} exists")
    lost = [p for p in inputs if not exists(spark, p)]
    if lost:
        raise ValueError(f"no such input: {', '.join(lost)}")
    by: dict[str, list[str]] = {}
    for path in inputs:
        by.setdefault(route(path), []).append(path)
    written, seen = {}, None
    for table, paths in by.items():
        rows = schemas.check(union(spark, paths), table)
        out = f"{output}/{table}"
        if "chrom" in rows.columns and table in ("alt_bases", "alt_reads", "coverage"):
            rows.sortWithinPartitions("chrom", "sample_id", "pos").write.partitionBy("chrom").parquet(out)
        else:
            rows.write.parquet(out)
        written[table] = out
        one = None
        for path in paths:
            part = _provenance(spark.read.parquet(path), table)
            one = part if one is None else one.unionByName(part)
        seen = one if seen is None else seen.unionByName(one)
    seen.write.parquet(f"{output}/inputs")
    written["inputs"] = f"{output}/inputs"
    if "alt_bases" in written:
        loci = spark.read.parquet(written["alt_bases"])
        have = [c for c in ("batch", "read_type", "pipeline") if c not in loci.columns]
        for c in have:
            loci = loci.withColumn(c, F.lit(None).cast("string"))
        samples(loci).write.parquet(f"{output}/samples")
        written["samples"] = f"{output}/samples"
    counts = {t: spark.read.parquet(p).count() for t, p in written.items() if t in schemas.TABLES and t != "coverage_intervals"}
    row = [(datetime.now(UTC), command, spark.version, platform.platform(), len(inputs), sample_count(spark, written), *[counts.get(t, 0) for t in ("alt_bases", "alt_reads", "normal_evidence", "pon_evidence", "coverage")])]
    kinds = "created_at timestamp, command string, spark_version string, platform string, n_inputs int, n_samples long, n_alt_bases long, n_alt_reads long, n_normal_evidence long, n_pon_evidence long, n_coverage long"
    spark.createDataFrame(row, kinds).coalesce(1).write.parquet(f"{output}/metadata")
    return written | {"metadata": f"{output}/metadata"}


def sample_count(spark: SparkSession, tables: dict[str, str]) -> int:
    """Samples of the first of samples, loci and coverage that is there."""
    for name in ("samples", "alt_bases", "coverage"):
        if name in tables:
            return spark.read.parquet(tables[name]).select(F.count_distinct("sample_id")).first()[0]
    return 0


def open_cohort(spark: SparkSession, path: str, required: str = "alt_bases") -> dict[str, DataFrame]:
    """The cohort's tables by name; an error if the required one is missing."""
    found = {t: spark.read.parquet(f"{path}/{t}") for t in [*schemas.TABLES, "samples", "inputs", "metadata"] if exists(spark, f"{path}/{t}")}
    if required not in found:
        raise ValueError(f"{path} has no table {required}")
    return found


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, or by extension tab- or comma-separated text with a header."""
    if path.endswith((".tsv", ".csv")):
        df.write.mode(mode).csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", nullValue="NA")
    else:
        df.write.mode(mode).parquet(path)


def split_paths(path: str) -> tuple[str, str]:
    """Where loci and reads go when both are written."""
    stem = path.removesuffix(".parquet")
    return f"{stem}.locus.parquet", f"{stem}.reads.parquet"
