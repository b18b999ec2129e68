"""Schemas of the cohort tables and the contract that readers check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

_KINDS: dict[str, DataType] = {
    "string": StringType(), "bigint": LongType(), "int": IntegerType(), "float": FloatType(), "double": DoubleType(), "boolean": BooleanType(),
    "array<int>": ArrayType(IntegerType()), "map<string:int>": MapType(StringType(), IntegerType()),
}


def _ddl(text: str) -> StructType:
    """A schema without a session, which parsing by Spark would need."""
    return StructType([StructField(*(f(x) for f, x in zip((str, _KINDS.__getitem__), field.split(), strict=True))) for field in text.split(",")])


ALT_BASES = _ddl("""sample_id string, chrom string, pos bigint, ref_allele string, alt_allele string, variant_type string, total_depth int, alt_count int,
    ref_count int, fwd_depth int, rev_depth int, fwd_alt_count int, rev_alt_count int, fwd_ref_count int, rev_ref_count int, overlap_depth int,
    overlap_alt_agree int, overlap_alt_disagree int, overlap_ref_agree int, read_type string, pipeline string, batch string, label1 string, label2 string,
    label3 string, input_checksum_sha256 string, variant_called boolean, variant_filter string, on_target boolean, gene string, homopolymer_len int,
    str_period int, str_len int, trinuc_context string, gnomad_af float""")
ALT_READS = _ddl("""sample_id string, chrom string, pos bigint, alt_allele string, cycle int, read_length int, is_read1 boolean, ab_count int, ba_count int,
    family_size int, base_qual int, map_qual int, insert_size int, n_before_alt int, n_after_alt int, n_n_before_alt int, n_n_after_alt int,
    leading_n_run_len int, trailing_n_run_len int, input_checksum_sha256 string""")
NORMAL_EVIDENCE = _ddl("""tumor_sample_id string, chrom string, pos bigint, tumor_alt_allele string, normal_sample_id string, normal_alt_allele string,
    normal_depth int, normal_alt_count int""")
PON_EVIDENCE = _ddl("""tumor_sample_id string, chrom string, pos bigint, tumor_alt_allele string, n_pon_samples bigint, pon_total_samples bigint,
    max_pon_vaf double, mean_pon_vaf double""")
COVERAGE = _ddl("""sample_id string, chrom string, pos bigint, end bigint, bin_n int, total_depth int, min_depth int, max_depth int, fwd_depth int,
    rev_depth int, raw_read_depth int, frac_dup float, overlap_depth int, frac_overlap float, mean_mapq float, frac_mapq0 float, frac_low_mapq float,
    mean_base_qual float, min_base_qual_obs int, max_base_qual_obs int, frac_low_bq float, mean_insert_size float, min_insert_size int,
    max_insert_size int, n_insert_size_obs int, gc_content float, on_target boolean, gene string, feature_type string, exon_number int,
    read_type string, pipeline string, batch string, label1 string, label2 string, label3 string""")
COVERAGE_INTERVALS = _ddl("""sample_id string, chrom string, start bigint, end bigint, interval_name string, gene string, feature_type string,
    exon_number int, n_bases int, mean_depth float, median_depth float, min_depth int, max_depth int, frac_at_1x float, frac_at_10x float,
    frac_at_20x float, frac_at_30x float, frac_at_50x float, frac_at_100x float, mean_gc_content float, mean_mapq float, mean_frac_mapq0 float,
    mean_frac_dup float, mean_frac_overlap float, mean_base_qual float, mean_insert_size float, read_type string, pipeline string, batch string,
    label1 string, label2 string, label3 string""")
#: Aligned reads, as a relation.
READS = _ddl("""sample_id string, read_ordinal bigint, qname string, flag int, chrom string, pos bigint, mapq int, cigar string, seq string,
    quals array<int>, tlen int, tags map<string:int>""")
#: A reference genome in chunks; chunk_start is 0-based.
REFERENCE = _ddl("chrom string, chunk_start bigint, seq string")

TABLES = {"alt_bases": ALT_BASES, "alt_reads": ALT_READS, "normal_evidence": NORMAL_EVIDENCE, "pon_evidence": PON_EVIDENCE, "coverage": COVERAGE, "coverage_intervals": COVERAGE_INTERVALS}
REQUIRED = {
    "alt_bases": ("sample_id", "chrom", "pos", "ref_allele", "alt_allele", "variant_type", "total_depth", "alt_count"),
    "alt_reads": ("sample_id", "chrom", "pos", "alt_allele", "cycle", "base_qual", "map_qual"),
    "normal_evidence": ("tumor_sample_id", "chrom", "pos", "tumor_alt_allele", "normal_depth", "normal_alt_count"),
    "pon_evidence": ("tumor_sample_id", "chrom", "pos", "tumor_alt_allele", "n_pon_samples", "pon_total_samples"),
    "coverage": ("sample_id", "chrom", "pos", "total_depth"),
    "coverage_intervals": ("sample_id", "chrom", "start", "end", "mean_depth"),
}
READ_TYPES, PIPELINES, VARIANT_TYPES = ("raw", "simplex", "duplex"), ("fgbio", "dragen", "raw"), ("SNV", "insertion", "deletion")


def check(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, or an error that names the required columns it lacks."""
    lacking = [c for c in REQUIRED[table] if c not in df.columns]
    if lacking:
        raise ValueError(f"{table} lacks the columns {', '.join(lacking)}")
    return df


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column, whether it exists and has a value in any row (a single pass)."""
    return df.agg(*[(F.count_if(F.col(c).isNotNull()) > 0 if c in df.columns else F.lit(False)).alias(c) for c in columns])
