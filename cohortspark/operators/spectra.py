"""Mutation spectra over 96 contexts, whole and stratified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alleles import contexts, sbs96
from ..functions.numeric import ratio, vaf
from .filters import KEY


def labelled(alt_bases: DataFrame) -> DataFrame:
    """SNVs with their context; others are dropped."""
    return alt_bases.where(F.col("variant_type") == "SNV").withColumn("context", sbs96()).where("context is not null")


def spectrum(rows: DataFrame, *by: Column | str) -> DataFrame:
    """``*by, context, n, fraction`` on the full grid of 96 contexts for each group that occurs."""
    names = [b if isinstance(b, str) else f"_{i}" for i, b in enumerate(by)]
    keyed = rows.select("context", *[b if isinstance(b, str) else b.alias(n) for b, n in zip(by, names, strict=True)])
    counts = keyed.groupBy(*names, "context").agg(F.count("*").alias("n"))
    grid = F.broadcast(contexts(rows.sparkSession).select("context"))
    if names:
        grid = keyed.select(*names).distinct().crossJoin(grid)
    same = [grid[c].eqNullSafe(counts[c]) for c in [*names, "context"]]
    full = grid.join(counts, same, "left").select(*[grid[c] for c in [*names, "context"]], F.coalesce(counts["n"], F.lit(0)).cast("long").alias("n"))
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*names)))
    return full.withColumn("fraction", F.coalesce(share, F.lit(0.0)))


def sample_label() -> Column:
    return F.when(F.col("batch").isNull(), F.col("sample_id")).otherwise(F.concat_ws(" / ", "sample_id", "batch"))


def sample_matrix(alt_bases: DataFrame) -> DataFrame:
    """``sample, context, n, fraction``."""
    return spectrum(labelled(alt_bases).withColumn("sample", sample_label()), "sample")


def by_called(alt_bases: DataFrame) -> DataFrame:
    return spectrum(labelled(alt_bases).where("variant_called is not null"), "variant_called")


def by_vaf_class(alt_bases: DataFrame, cut: float = 0.3) -> DataFrame:
    return spectrum(labelled(alt_bases).withColumn("vaf_class", F.when(vaf() > cut, "germline").otherwise("somatic")), "vaf_class")


def by_read(alt_bases: DataFrame, reads: DataFrame) -> DataFrame:
    """Weighted by reads, for first and second reads of pairs."""
    rows = reads.join(labelled(alt_bases).select(*KEY, "context"), KEY).withColumn("read", F.when(F.col("is_read1"), "R1").otherwise("R2"))
    return spectrum(rows, "read")


def by_family_size(alt_bases: DataFrame, reads: DataFrame) -> DataFrame:
    """Loci by the median family size of their reads: singletons (1 or unknown) and multi."""
    size = reads.groupBy(*KEY).agg(F.median("family_size").alias("_size"))
    rows = labelled(alt_bases).join(size, KEY, "left")
    return spectrum(rows.withColumn("family", F.when(F.coalesce("_size", F.lit(1.0)) <= 1, "singleton").otherwise("multi")), "family")


def simple(alt_bases: DataFrame) -> DataFrame:
    """Counts of ``ref>alt`` where there is no context."""
    snv = alt_bases.where(F.col("variant_type") == "SNV")
    return snv.groupBy(F.concat("ref_allele", F.lit(">"), "alt_allele").alias("change")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "change")


def heatmap(alt_bases: DataFrame) -> DataFrame:
    """Fractions by sample over all contexts."""
    return spectrum(labelled(alt_bases), "sample_id")


def per_sample_sbs6(alt_bases: DataFrame) -> DataFrame:
    """Six substitutions by sample: count and share."""
    from .cohort import substitution_qc

    counts = substitution_qc(alt_bases).select("sample_id", "substitution", "n")
    return counts.withColumn("fraction", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("sample_id"))))
