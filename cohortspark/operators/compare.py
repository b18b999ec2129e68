"""Tumor/normal and panel classification, concordance of pipelines and read types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio, rounded, vaf
from .filters import KEY

TUMOR = ["tumor_sample_id", "chrom", "pos", "tumor_alt_allele"]


def _tumor(loci: DataFrame) -> DataFrame:
    return loci.select(F.col("sample_id").alias("tumor_sample_id"), "chrom", "pos", F.col("alt_allele").alias("tumor_alt_allele"), rounded(vaf(), 4).alias("tumor_vaf"))


def with_normal(loci: DataFrame, normal: DataFrame, germline: float = 0.2) -> DataFrame:
    """Tumor loci with the normal's depth and VAF, and what that makes of them."""
    anchor = normal.where("normal_alt_allele is null").select(*TUMOR, "normal_depth")
    match = normal.where("normal_alt_allele = tumor_alt_allele").select(*TUMOR, F.col("normal_alt_count").alias("normal_alt"))
    rows = _tumor(loci).join(anchor, TUMOR, "left").join(match, TUMOR, "left")
    share = ratio(F.coalesce("normal_alt", F.lit(0)), F.col("normal_depth"))
    kind = (
        F.when(F.col("normal_depth").isNull(), "No normal data").when(F.col("normal_depth") == 0, "No normal coverage")
        .when(F.coalesce("normal_alt", F.lit(0)) == 0, "Somatic candidate").when(share >= germline, "Germline-like").otherwise("Artifact-like")
    )
    return rows.select("*", rounded(share, 4).alias("normal_vaf"), kind.alias("classification"))


def with_panel(loci: DataFrame, panel: DataFrame, common: float = 0.1) -> DataFrame:
    """Tumor loci with the panel's evidence, and what that makes of them."""
    rows = _tumor(loci).join(panel.select(*TUMOR, "n_pon_samples", "pon_total_samples", "max_pon_vaf"), TUMOR, "left")
    share = ratio("n_pon_samples", "pon_total_samples")
    kind = F.when(F.col("n_pon_samples").isNull(), "No PoN data").when(F.col("n_pon_samples") == 0, "PoN clean").when(share >= common, "Common in PoN").otherwise("Rare in PoN")
    return rows.select("*", rounded(share, 4).alias("pon_fraction"), kind.alias("classification"))


def tally(rows: DataFrame) -> DataFrame:
    """Loci by classification, with percent."""
    counts = rows.groupBy("classification").agg(F.count("*").alias("n_loci"))
    return counts.withColumn("pct", rounded(ratio(F.col("n_loci") * 100, F.sum("n_loci").over(Window.partitionBy())), 1))


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two sides on sample, place and allele; ``side`` is shared, only_a or only_b."""
    keep = ["variant_type", "total_depth", "alt_count", "fwd_alt_count", "rev_alt_count"]
    x = a.select(*KEY, *[F.col(c).alias(f"{c}_a") for c in keep], vaf().alias("vaf_a"), *[F.col(c) for c in ("ref_allele", "trinuc_context")], F.lit(True).alias("in_a"))
    y = b.select(*KEY, *[F.col(c).alias(f"{c}_b") for c in keep], vaf().alias("vaf_b"), F.lit(True).alias("in_b"))
    side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("shared")
    both = x.join(y, KEY, "full_outer").withColumns({"side": side, "variant_type": F.coalesce("variant_type_a", "variant_type_b")})
    return both.drop("in_a", "in_b", "variant_type_a", "variant_type_b")


def by_side(both: DataFrame) -> DataFrame:
    return both.groupBy("side", "variant_type").agg(F.count("*").alias("n_loci"))


def correlation(both: DataFrame) -> DataFrame:
    """Pearson's r of the shared loci's VAFs; null for fewer than two."""
    shared = both.where("side = 'shared'")
    return shared.agg(F.count("*").alias("n_shared"), F.when(F.count("*") >= 2, F.corr("vaf_a", "vaf_b")).alias("pearson_r"))


def unique_loci(both: DataFrame, name_a: str = "A", name_b: str = "B") -> DataFrame:
    """Loci of one side only, with that side's figures."""
    a = F.col("side") == "only_a"
    pick = lambda c: F.when(a, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    rows = both.where("side != 'shared'")
    return rows.select(F.when(a, name_a).otherwise(name_b).alias("side_name"), *KEY, pick("vaf").alias("vaf"), pick("total_depth").alias("total_depth"), pick("alt_count").alias("alt_count"))


def unique_medians(unique: DataFrame) -> DataFrame:
    return unique.groupBy("side_name").agg(F.count("*").alias("n_loci"), *[F.median(c).alias(f"median_{c}") for c in ("vaf", "total_depth", "alt_count")])


def describe_unique(medians: list[dict]) -> str:
    """A sentence on how the two sides' own calls differ, from the rows of :func:`unique_medians`."""
    if len(medians) < 2:
        return "Only one side has calls of its own." if medians else "Neither side has calls of its own."
    a, b = sorted(medians, key=lambda r: r["side_name"])
    word = lambda c: "lower" if a[c] < b[c] else "higher" if a[c] > b[c] else "equal"
    return f"{a['side_name']} unique calls have {word('median_vaf')} median VAF and {word('median_total_depth')} median depth than {b['side_name']}'s."


def strand_fractions(sides: dict[str, DataFrame]) -> DataFrame:
    """``read_type, sample_id, chrom, pos, alt_allele, strand_fraction`` of loci with stranded reads, sides stacked."""
    out = None
    for name, rows in sides.items():
        total = F.col("fwd_alt_count") + F.col("rev_alt_count")
        one = rows.where(total > 0).select(F.lit(name).alias("read_type"), *KEY, ratio(F.col("fwd_alt_count"), total).alias("strand_fraction"))
        out = one if out is None else out.unionByName(one)
    return out
