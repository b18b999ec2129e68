"""Analyses of alternate-supporting reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percentile, ratio, rounded, vaf
from .filters import KEY, LOCUS


def of_loci(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """Reads of the given loci; a locus in several rows does not multiply them."""
    return reads.join(loci.select(*KEY), KEY, "left_semi")


def grouped(reads: DataFrame, loci: DataFrame, by: str | None = None, read_split: bool = False) -> DataFrame:
    """``reads`` with ``label``: nothing, a column of the loci (sample, batch, label1-3), each by R1/R2 if wanted."""
    rows, label = reads, F.lit("all")
    if by == "sample_id":
        label = F.col("sample_id")
    elif by:
        rows = reads.join(loci.select("sample_id", by).distinct(), "sample_id")
        label = F.col(by)
    if read_split:
        label = F.concat(label, F.when(F.col("is_read1"), " R1").otherwise(" R2"))
    return rows.withColumn("label", label)


def share(rows: DataFrame, n: str = "n_reads") -> DataFrame:
    return rows.withColumn("fraction", ratio(F.col(n), F.sum(n).over(Window.partitionBy("label"))))


def by_cycle(reads: DataFrame) -> DataFrame:
    return share(reads.groupBy("label", "cycle").agg(F.count("*").alias("n_reads")))


def quality_by_cycle(reads: DataFrame) -> DataFrame:
    return reads.groupBy("label", "cycle").agg(rounded(F.avg("base_qual"), 2).alias("mean_base_qual"), F.count("*").alias("n_reads"))


def n_content(reads: DataFrame) -> DataFrame:
    """Shares of N before and after the allele, null without bases there, and their difference."""
    out = reads.withColumns({"frac_n_before": ratio("n_n_before_alt", "n_before_alt"), "frac_n_after": ratio("n_n_after_alt", "n_after_alt")})
    return out.withColumn("delta", F.col("frac_n_after") - F.col("frac_n_before"))


def n_content_by_read(reads: DataFrame) -> DataFrame:
    return n_content(reads).groupBy("is_read1").agg(F.count("*").alias("n_reads"), rounded(F.avg("frac_n_before"), 6).alias("mean_before"), rounded(F.avg("frac_n_after"), 6).alias("mean_after"), rounded(F.median("delta"), 6).alias("median_delta"))


def n_summary(reads: DataFrame) -> DataFrame:
    trailing = F.avg((F.col("trailing_n_run_len") > 0).cast("double"))
    return n_content(reads).agg(rounded(trailing, 6).alias("frac_trailing_n"), rounded(F.median("delta"), 6).alias("median_delta"))


def read_length(reads: DataFrame) -> DataFrame:
    """The median read length and twice it, from which pairs leave a gap."""
    return reads.agg(F.median("read_length").alias("median_length"), (F.median("read_length") * 2).alias("gap_threshold"))


def insert_sizes(reads: DataFrame, everything: DataFrame, low: int = 20, high: int = 500) -> DataFrame:
    """Insert sizes by label, corrected for places that pairs leave unread: n / min(1, 2R / L)."""
    gap = F.broadcast(read_length(everything).select("gap_threshold"))
    counts = reads.where(F.col("insert_size").between(low, high)).groupBy("label", "insert_size").agg(F.count("*").alias("n_reads"))
    out = counts.crossJoin(gap)
    out = out.withColumn("n_eff", F.col("n_reads") / F.least(F.lit(1.0), ratio("gap_threshold", "insert_size"))).drop("gap_threshold")
    return out.withColumn("fraction", ratio(F.col("n_eff"), F.sum("n_eff").over(Window.partitionBy("label"))))


def _with_loci(reads: DataFrame, loci: DataFrame, **columns: Column) -> DataFrame:
    return reads.join(loci.select(*KEY, *[c.alias(n) for n, c in columns.items()]).distinct(), KEY)


def insert_by_vaf(reads: DataFrame, loci: DataFrame, cut: float = 0.3) -> DataFrame:
    rows = _with_loci(reads, loci, af_class=F.when(vaf() > cut, "germline").otherwise("somatic"))
    return rows.where("insert_size is not null").groupBy("label", "af_class", "insert_size").agg(F.count("*").alias("n_reads"))


def mapq_by_repeat(reads: DataFrame, loci: DataFrame) -> DataFrame:
    kind = F.when((F.col("homopolymer_len") >= 5) | (F.col("str_len") >= 6), "repetitive").otherwise("unique")
    return _with_loci(reads, loci, locus_type=kind).groupBy("map_qual", "locus_type").agg(F.count("*").alias("n_reads"))


def family_sizes(reads: DataFrame) -> DataFrame:
    return reads.where("family_size is not null").groupBy("label", "family_size").agg(F.count("*").alias("n_reads"))


def family_vs_vaf(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """By locus: VAF, mean family size, reads."""
    rows = loci.select(*KEY, "ref_allele", rounded(vaf(), 4).alias("vaf")).join(reads.select(*KEY, "family_size"), KEY)
    return rows.where("family_size is not null").groupBy(*KEY, "ref_allele", "vaf").agg(rounded(F.avg("family_size"), 4).alias("mean_family_size"), F.count("*").alias("n_reads"))


def quality_vs_loci(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """By sample: distinct loci and mean base quality of their reads."""
    rows = loci.select(*KEY).join(reads.select(*KEY, "base_qual"), KEY)
    return rows.groupBy("sample_id").agg(F.count_distinct("chrom", "pos", "alt_allele").alias("n_loci"), rounded(F.avg("base_qual"), 2).alias("mean_base_qual"), F.count("*").alias("n_reads"))


def family_by_frequency(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """Five-number summaries of family size by how many samples share the locus: 1, 2-3, 4 or more."""
    spread = loci.groupBy(*LOCUS).agg(F.count_distinct("sample_id").alias("n"))
    rows = loci.select(*KEY, "ref_allele").join(spread, LOCUS).join(reads.select(*KEY, "family_size"), KEY).where("family_size is not null")
    kind = F.when(F.col("n") == 1, "1 sample").when(F.col("n") <= 3, "2-3 samples").otherwise("4+ samples")
    five = [percentile("family_size", q).alias(name) for q, name in ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))]
    return rows.groupBy(kind.alias("frequency")).agg(*five, F.count("*").alias("n_reads"))


def strand_families(reads: DataFrame) -> DataFrame:
    """Reads by the sizes of their two strands' families."""
    return reads.where("ab_count is not null and ba_count is not null").groupBy("ab_count", "ba_count").agg(F.count("*").alias("n_reads"))


def strand_family_loci(loci: DataFrame, reads: DataFrame, ab: int, ba: int) -> DataFrame:
    """Loci that have a read of the given strand family sizes."""
    return loci.join(reads.where((F.col("ab_count") == ab) & (F.col("ba_count") == ba)).select(*KEY), KEY, "left_semi")
