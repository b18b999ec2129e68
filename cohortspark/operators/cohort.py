"""Cohort batch queries: recurrence, quality summaries, panel of normals, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import SBS6, sbs6
from ..functions.numeric import ratio, rounded, strand_balance, vaf

CHANGE = ["chrom", "pos", "ref_allele", "alt_allele", "variant_type"]


def on_target(rows: DataFrame) -> DataFrame:
    """Rows known to be on target."""
    return rows.where(F.col("on_target") == F.lit(True))


def recurrence(alt_bases: DataFrame, min_samples: int = 2, min_fraction: float = 0.0, annotations: tuple[str, ...] = ()) -> DataFrame:
    """Loci by how many samples share them. The number of all samples is one row, joined by broadcast."""
    one = F.broadcast(alt_bases.agg(F.count_distinct("sample_id").alias("total")))
    loci = alt_bases.groupBy(*CHANGE).agg(
        F.count_distinct("sample_id").alias("n_samples"), rounded(F.avg(vaf()), 6).alias("mean_vaf"), rounded(F.max(vaf()), 6).alias("max_vaf"),
        rounded(F.avg("total_depth"), 1).alias("mean_depth"), rounded(F.avg("alt_count"), 2).alias("mean_alt_count"),
        rounded(F.avg(strand_balance()), 4).alias("mean_strand_balance"), rounded(F.max(strand_balance()), 4).alias("max_strand_balance"),
        *[F.min(a).alias(a) for a in annotations if a in alt_bases.columns],
    )
    share = ratio("n_samples", "total")
    return loci.crossJoin(one).where((F.col("n_samples") >= min_samples) & (share >= min_fraction)).withColumn("sample_fraction", rounded(share, 4)).drop("total")


def ranked(loci: DataFrame) -> DataFrame:
    return loci.orderBy(F.desc("sample_fraction"), "chrom", "pos", "ref_allele", "alt_allele", "variant_type")


def top(loci: DataFrame, n: int = 20) -> DataFrame:
    return ranked(loci).limit(n)


def _concordance():
    agree, all_ = F.sum("overlap_alt_agree"), F.sum(F.col("overlap_alt_agree") + F.col("overlap_alt_disagree"))
    return rounded(ratio(agree, all_), 4)


def _types() -> list:
    return [F.count_if(F.col("variant_type") == t).alias(f"n_{t.lower()}") for t in ("SNV", "insertion", "deletion")]


def sample_qc(alt_bases: DataFrame) -> DataFrame:
    """A row for each sample: counts by type, mean depth and VAF, strand balance, overlap concordance."""
    return alt_bases.groupBy("sample_id").agg(
        *_types(), rounded(F.avg("total_depth"), 1).alias("mean_depth"), rounded(F.avg(vaf()), 6).alias("mean_vaf"),
        rounded(F.avg(strand_balance()), 4).alias("strand_balance"), _concordance().alias("overlap_concordance"),
    )


def substitution_qc(alt_bases: DataFrame) -> DataFrame:
    """By sample and one of six substitutions."""
    snv = alt_bases.where(F.col("variant_type") == "SNV").withColumn("substitution", sbs6()).where("substitution is not null")
    return snv.groupBy("sample_id", "substitution").agg(F.count("*").alias("n"), rounded(F.avg(vaf()), 6).alias("mean_vaf"), rounded(F.avg(strand_balance()), 4).alias("strand_balance"))


def wide_qc(alt_bases: DataFrame) -> DataFrame:
    """:func:`sample_qc` with three columns for each substitution; a substitution that is not seen has n 0."""
    wide = substitution_qc(alt_bases).groupBy("sample_id").pivot("substitution", list(SBS6))
    wide = wide.agg(F.first("n").alias("n"), F.first("mean_vaf").alias("mean_vaf"), F.first("strand_balance").alias("strand_balance"))
    names = {f"{s}_{m}": f"{s.replace('>', '_')}_{m}" for s in SBS6 for m in ("n", "mean_vaf", "strand_balance")}
    wide = wide.select("sample_id", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])
    out = sample_qc(alt_bases).join(wide, "sample_id", "left")
    return out.na.fill(0, [b for b in names.values() if b.endswith("_n")])


def cohort_table(alt_bases: DataFrame) -> DataFrame:
    """:func:`sample_qc` and the number of all loci."""
    return sample_qc(alt_bases).join(alt_bases.groupBy("sample_id").agg(F.count("*").alias("n_total")), "sample_id")


def panel_evidence(tumor: DataFrame, panel: DataFrame) -> DataFrame:
    """For each distinct tumor locus, in how many panel samples the allele is seen, and how strongly."""
    loci = tumor.select(F.col("sample_id").alias("tumor_sample_id"), "chrom", "pos", F.col("alt_allele").alias("tumor_alt_allele")).distinct()
    seen = panel.groupBy("chrom", "pos", F.col("alt_allele").alias("tumor_alt_allele"))
    seen = seen.agg(F.count_distinct("sample_id").alias("n_pon_samples"), F.max(vaf()).alias("max_pon_vaf"), F.avg(vaf()).alias("mean_pon_vaf"))
    total = F.broadcast(panel.agg(F.count_distinct("sample_id").alias("pon_total_samples")))
    out = loci.join(seen, ["chrom", "pos", "tumor_alt_allele"], "left").crossJoin(total)
    return out.select("tumor_sample_id", "chrom", "pos", "tumor_alt_allele", F.coalesce("n_pon_samples", F.lit(0)).cast("long").alias("n_pon_samples"), "pon_total_samples", "max_pon_vaf", "mean_pon_vaf")


def samples(alt_bases: DataFrame) -> DataFrame:
    """The summary that a merge rebuilds: by sample and batch."""
    return alt_bases.groupBy("sample_id", "batch").agg(
        F.count("*").alias("n_alt_loci"), F.sum(F.col("alt_count").cast("long")).alias("total_alt_reads"), F.count_distinct("chrom", "pos").alias("n_positions"),
        F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), F.min("read_type").alias("read_type"), F.min("pipeline").alias("pipeline"),
    )


def summary(alt_bases: DataFrame) -> DataFrame:
    """One row of totals; zeros where there are no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return alt_bases.agg(
        F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"), zero(F.sum(F.col("alt_count").cast("long"))).alias("total_alt_reads"),
        zero(rounded(F.avg(vaf()), 4)).alias("mean_vaf"), zero(rounded(F.avg("total_depth"), 1)).alias("mean_depth"),
        F.count("variant_called").alias("n_annotated"), F.count_if(F.col("variant_called")).alias("n_called"),
    )


def strand_by_sample(alt_bases: DataFrame) -> DataFrame:
    """SNVs by sample and batch: mean VAF, mean strand balance, loci."""
    snv = alt_bases.where(F.col("variant_type") == "SNV")
    return snv.groupBy("sample_id", "batch").agg(rounded(F.avg(vaf()), 6).alias("mean_vaf"), rounded(F.avg(strand_balance()), 4).alias("mean_strand_balance"), F.count("*").alias("n_loci"))


def vaf_histogram(alt_bases: DataFrame, bins: int = 50) -> DataFrame:
    """Counts by variant type and VAF bin."""
    fine = alt_bases.where((F.col("total_depth") > 0) & (F.col("alt_count") <= F.col("total_depth")))
    at = F.floor(rounded(vaf(), 4) * bins).cast("double") / bins
    out = fine.groupBy("variant_type", at.alias("vaf_bin")).agg(F.count("*").alias("n")).where("vaf_bin >= 0")
    return out.withColumn("bin_end", F.col("vaf_bin") + 1.0 / bins)


def overlap_agreement(alt_bases: DataFrame) -> DataFrame:
    """Loci by the agreement of overlapping pairs, to three digits; null where no pair shows the allele."""
    rows = alt_bases.where(F.col("overlap_depth") > 0)
    share = rounded(ratio(F.col("overlap_alt_agree"), F.col("overlap_alt_agree") + F.col("overlap_alt_disagree")), 3)
    return rows.groupBy(share.alias("agreement")).agg(F.count("*").alias("n"))


def bed(rows: DataFrame) -> DataFrame:
    """``chrom, start, end`` of the rows' places; a deletion covers the bases it removes."""
    end = F.when(F.col("variant_type") == "deletion", F.col("pos") + F.length("alt_allele")).otherwise(F.col("pos") + 1)
    return rows.groupBy("chrom", F.col("pos").alias("start")).agg(F.max(end).alias("end")).orderBy("chrom", "start")


def selected_samples(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id").distinct().orderBy("sample_id")


def strand_scatter(rows: DataFrame, most: int = 5000) -> DataFrame:
    """Strand counts of a reproducible sample: the ``most`` rows that come first by a hash of their key."""
    snv = rows.select("sample_id", "chrom", "pos", "ref_allele", "alt_allele", "fwd_alt_count", "rev_alt_count")
    return snv.orderBy(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in snv.columns])), *snv.columns).limit(most)


def strand_band(x: int, z: float = 1.96) -> tuple[float, float]:
    """Reverse counts at the ends of the 95% band for ``x`` forward reads under even strands."""
    root = (z * z + 8 * x) ** 0.5
    low, high = ((sign * z + root) / 2 for sign in (-1, 1))
    return max(0.0, low * low - x), high * high - x


def at_locus(alt_bases: DataFrame, chrom: str, pos: int, alt: str | None = None) -> DataFrame:
    """All samples at a place."""
    rows = alt_bases.where((F.col("chrom") == chrom) & (F.col("pos") == pos))
    rows = rows.where(F.col("alt_allele") == alt) if alt else rows
    return rows.withColumn("vaf", rounded(vaf(), 4)).orderBy("sample_id", "alt_allele")


def reads_at_locus(reads: DataFrame, chrom: str, pos: int) -> DataFrame:
    rows = reads.where((F.col("chrom") == chrom) & (F.col("pos") == pos))
    return rows.orderBy(F.col("family_size").desc_nulls_last(), "sample_id", "alt_allele", "cycle")


def read_stats_at_locus(reads: DataFrame, chrom: str, pos: int) -> DataFrame:
    rows = reads.where((F.col("chrom") == chrom) & (F.col("pos") == pos))
    return rows.groupBy("sample_id", "alt_allele").agg(
        F.count("*").alias("n_reads"), rounded(F.median("cycle"), 1).alias("median_cycle"), rounded(F.median("family_size"), 1).alias("median_family_size"),
        F.min("family_size").alias("min_family_size"), F.max("family_size").alias("max_family_size"), rounded(F.avg("base_qual"), 1).alias("mean_base_qual"), F.count_if(F.col("is_read1")).alias("n_read1"),
    )
