"""Queries over the derived cohort tables, each with the SQL that DuckDB runs.

The SQL is written from the definition of each operator, not from the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, compare, filters, profile, reads, spectra
from ..operators.filters import Filters, ReadFilters
from .derived import spark_table, with_tables

Build = Callable[..., DataFrame]
_FOUND: dict[str, tuple[Build, tuple[str, ...], str | None]] = {}


def query(name: str, tables: str, sql: str | None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        _FOUND[name] = (build, tuple(tables.split()), sql)
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Build, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(*[spark_table(spark, sf_dir, t) for t in tables])

    return {name: bind(build, tables) for name, (build, tables, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql) for name, (_, _, sql) in _FOUND.items() if sql}


VAF = "(CAST(alt_count AS DOUBLE) / nullif(total_depth, 0))"
BALANCE = "(CAST(fwd_alt_count AS DOUBLE) / nullif(fwd_alt_count + rev_alt_count, 0))"
KEYS = "sample_id, chrom, pos, alt_allele"


def r(x: str, n: int) -> str:
    return f"(round(({x}) * 1e{n}) / 1e{n})"


# Batch queries ------------------------------------------------------------------------------------------------------

_RECURRENCE = f"""SELECT chrom, pos, ref_allele, alt_allele, variant_type, count(DISTINCT sample_id) AS n_samples, {r(f'avg({VAF})', 6)} AS mean_vaf,
    {r(f'max({VAF})', 6)} AS max_vaf, {r('avg(total_depth)', 1)} AS mean_depth, {r('avg(alt_count)', 2)} AS mean_alt_count,
    {r(f'avg({BALANCE})', 4)} AS mean_strand_balance, {r(f'max({BALANCE})', 4)} AS max_strand_balance, min(gene) AS gene,
    {r('count(DISTINCT sample_id) * 1.0::DOUBLE / (SELECT count(DISTINCT sample_id) FROM alt_bases)', 4)} AS sample_fraction
    FROM alt_bases GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT sample_id) >= 2"""


@query("q1_cohort_recurrence", "alt_bases", _RECURRENCE)
def _(a):
    return cohort.recurrence(a, 2, annotations=("gene",))


@query("q2_top_loci", "alt_bases", f"SELECT * FROM ({_RECURRENCE}) ORDER BY sample_fraction DESC, chrom, pos, ref_allele, alt_allele, variant_type LIMIT 20")
def _(a):
    return cohort.top(cohort.recurrence(a, 2, annotations=("gene",)), 20)


_QC = f"""SELECT sample_id, count(*) FILTER (variant_type = 'SNV') AS n_snv, count(*) FILTER (variant_type = 'insertion') AS n_insertion,
    count(*) FILTER (variant_type = 'deletion') AS n_deletion, {r('avg(total_depth)', 1)} AS mean_depth, {r(f'avg({VAF})', 6)} AS mean_vaf,
    {r(f'avg({BALANCE})', 4)} AS strand_balance,
    {r('sum(overlap_alt_agree) * 1.0::DOUBLE / nullif(sum(overlap_alt_agree + overlap_alt_disagree), 0)', 4)} AS overlap_concordance FROM {{}} GROUP BY sample_id"""


@query("q3_q4_sample_qc_on_target", "alt_bases", _QC.format("alt_bases WHERE on_target"))
def _(a):
    return cohort.sample_qc(cohort.on_target(a))


_SUBST = "CASE WHEN ref_allele IN ('C', 'T') THEN ref_allele || '>' || alt_allele ELSE translate(ref_allele, 'ACGT', 'TGCA') || '>' || translate(alt_allele, 'ACGT', 'TGCA') END"
_SUB_QC = f"""SELECT sample_id, {_SUBST} AS substitution, count(*) AS n, {r(f'avg({VAF})', 6)} AS mean_vaf, {r(f'avg({BALANCE})', 4)} AS strand_balance
    FROM alt_bases WHERE variant_type = 'SNV' GROUP BY 1, 2"""


@query("q5_substitution_qc", "alt_bases", _SUB_QC)
def _(a):
    return cohort.substitution_qc(a)


_WIDE = ", ".join(
    f"coalesce(max(n) FILTER (substitution = '{s}'), 0) AS {s.replace('>', '_')}_n, max(mean_vaf) FILTER (substitution = '{s}') AS {s.replace('>', '_')}_mean_vaf, max(strand_balance) FILTER (substitution = '{s}') AS {s.replace('>', '_')}_strand_balance"
    for s in ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
)


@query("q6_wide_qc", "alt_bases", f"WITH qc AS ({_QC.format('alt_bases')}), sub AS ({_SUB_QC}), wide AS (SELECT sample_id, {_WIDE} FROM sub GROUP BY sample_id) SELECT * FROM qc LEFT JOIN wide USING (sample_id)")
def _(a):
    return cohort.wide_qc(a)


_PANEL = f"""WITH panel AS (SELECT * FROM alt_bases WHERE sample_id >= 'S06'),
    seen AS (SELECT chrom, pos, alt_allele, count(DISTINCT sample_id) AS n, max({VAF}) AS hi, avg({VAF}) AS mid FROM panel GROUP BY 1, 2, 3),
    pon AS (SELECT t.sample_id AS tumor_sample_id, t.chrom, t.pos, t.alt_allele AS tumor_alt_allele, coalesce(n, 0) AS n_pon_samples,
        (SELECT count(DISTINCT sample_id) FROM panel) AS pon_total_samples, hi AS max_pon_vaf, mid AS mean_pon_vaf
        FROM (SELECT DISTINCT {KEYS} FROM alt_bases WHERE sample_id < 'S06') t LEFT JOIN seen USING (chrom, pos, alt_allele))"""


def _panel(a):
    return cohort.panel_evidence(a.where("sample_id < 'S06'"), a.where("sample_id >= 'S06'"))


@query("q7_panel_evidence", "alt_bases", f"{_PANEL} SELECT * REPLACE ({r('max_pon_vaf', 6)} AS max_pon_vaf, {r('mean_pon_vaf', 6)} AS mean_pon_vaf) FROM pon")
def _(a):
    out = _panel(a)
    return out.withColumns({c: cohort.rounded(F.col(c), 6) for c in ("max_pon_vaf", "mean_pon_vaf")})


@query(
    "q9_samples", "alt_bases",
    """SELECT sample_id, batch, count(*) AS n_alt_loci, CAST(sum(alt_count) AS BIGINT) AS total_alt_reads, count(DISTINCT (chrom, pos)) AS n_positions,
    min(pos) AS min_pos, max(pos) AS max_pos, min(read_type) AS read_type, min(pipeline) AS pipeline FROM alt_bases GROUP BY 1, 2""",
)
def _(a):
    return cohort.samples(a)


# Filters ------------------------------------------------------------------------------------------------------------

_SHOWN = "sample_id, chrom, pos, ref_allele, alt_allele, alt_count, total_depth, pipeline"
_SHOWN_COLS = _SHOWN.split(", ")


def _filter_query(name: str, f: Filters, where: str) -> None:
    @query(name, "alt_bases", f"SELECT {_SHOWN} FROM alt_bases WHERE {where}")
    def _(a):
        return f.apply(a).select(*_SHOWN_COLS)


_filter_query("f1_alt_count", Filters(alt_min=10, alt_max=40), "alt_count >= 10 AND alt_count <= 40")
_filter_query("f2_vaf_range", Filters(vaf_range=(0.05, 0.2)), f"{VAF} BETWEEN 0.05 AND 0.2")
_filter_query("f3_membership", Filters(chrom="chr2", samples=("S01", "S02", "S03"), batches=("B1", "B2"), pipelines=("fgbio",), label1=("L0", "L1"), variant_types=("SNV", "deletion")), "chrom = 'chr2' AND sample_id IN ('S01', 'S02', 'S03') AND batch IN ('B1', 'B2') AND pipeline = 'fgbio' AND label1 IN ('L0', 'L1') AND variant_type IN ('SNV', 'deletion')")
_filter_query("f4_recurrence_scope", Filters(recurrence=(2, 3), pipelines=("dragen",), alt_min=5), """pipeline = 'dragen' AND alt_count >= 5 AND (chrom, pos, ref_allele, alt_allele) IN
    (SELECT (chrom, pos, ref_allele, alt_allele) FROM alt_bases WHERE pipeline = 'dragen' GROUP BY chrom, pos, ref_allele, alt_allele HAVING count(DISTINCT sample_id) BETWEEN 2 AND 3)""")
_filter_query("f5_strand_overlap_depth", Filters(fwd_alt_min=2, rev_alt_min=1, overlap_agree_min=1, overlap_disagree_min=1, depth_min=50, depth_max=300), "fwd_alt_count >= 2 AND rev_alt_count >= 1 AND overlap_alt_agree >= 1 AND overlap_alt_disagree >= 1 AND total_depth BETWEEN 50 AND 300")
_filter_query("f6_called", Filters(called="yes", variant_filters=("PASS",)), "variant_called IS TRUE AND variant_filter = 'PASS'")
_filter_query("f6_call_unknown", Filters(called="unknown"), "variant_called IS NULL")
_filter_query("f7_off_target", Filters(on_target=False), "on_target IS FALSE")
_filter_query("f8_gnomad_with_null", Filters(gnomad_range=(0.01, 0.05)), "gnomad_af BETWEEN 0.01 AND 0.05 OR gnomad_af IS NULL")
_filter_query("f8_gnomad_without_null", Filters(gnomad_range=(0.01, 0.05), gnomad_null=False), "gnomad_af BETWEEN 0.01 AND 0.05")
_filter_query("f9_gene", Filters(gene="G5"), "gene = 'G5'")
_filter_query("f10_repeats", Filters(homopolymer=(0, 4), str_len=(2, 8)), "(homopolymer_len IS NULL OR homopolymer_len BETWEEN 0 AND 4) AND (str_len IS NULL OR str_len BETWEEN 2 AND 8)")

_READ = ReadFilters(family_size=(2, 5), cycle=(10, 140), map_qual=(20, 60), insert_size=(20, 500), read="R1")
_PASS = "coalesce(family_size BETWEEN 2 AND 5 AND cycle BETWEEN 10 AND 140 AND map_qual BETWEEN 20 AND 60 AND insert_size BETWEEN 20 AND 500 AND is_read1, false)"


@query("f11_read_filter", "alt_reads", f"SELECT {KEYS}, cycle, family_size, map_qual, insert_size FROM alt_reads WHERE {_PASS}")
def _(x):
    return _READ.apply(x).select(*filters.KEY, "cycle", "family_size", "map_qual", "insert_size")


@query("f12_locus_inclusion", "alt_bases alt_reads", f"""WITH per AS (SELECT {KEYS}, bool_or({_PASS}) AS ok FROM alt_reads GROUP BY {KEYS})
    SELECT {_SHOWN} FROM alt_bases LEFT JOIN per USING ({KEYS}) WHERE ok IS NULL OR ok""")
def _(a, x):
    return filters.with_passing_reads(a, x, _READ).select(*_SHOWN_COLS)


@query("f13_recount", "alt_bases alt_reads", f"""WITH per AS (SELECT {KEYS}, count(*) FILTER ({_PASS}) AS n FROM alt_reads GROUP BY {KEYS})
    SELECT sample_id, chrom, pos, ref_allele, alt_allele, CAST(coalesce(n, alt_count) AS INT) AS alt_count, total_depth, pipeline, {r(VAF, 4)} AS original_vaf FROM alt_bases LEFT JOIN per USING ({KEYS})""")
def _(a, x):
    return filters.recount(a, x, _READ).select(*_SHOWN_COLS, "original_vaf")


@query("f15_coverage_filter", "coverage", "SELECT sample_id, chrom, pos, total_depth FROM coverage WHERE sample_id IN ('S01', 'S02') AND lower(gene) LIKE '%g1%' AND on_target AND batch IN ('B1', 'B2')")
def _(c):
    rows = filters.coverage_filter(c, samples=("S01", "S02"), gene_like="g1", on_target=True, batches=("B1", "B2"))
    return rows.select("sample_id", "chrom", "pos", "total_depth")


@query("f16_region", "coverage", 'SELECT sample_id, chrom, pos, "end", total_depth FROM coverage WHERE chrom = \'chr1\' AND "end" > 300 AND pos < 900')
def _(c):
    return c.where(filters.overlaps(*filters.parse_region("chr1:300-900"))).select("sample_id", "chrom", "pos", "end", "total_depth")


@query("f17_listing", "alt_bases", f"""SELECT DISTINCT sample_id, chrom, pos, alt_allele, {r(VAF, 4)} AS vaf FROM alt_bases WHERE chrom = 'chr3' AND pos < 200""")
def _(a):
    rows = a.where((F.col("chrom") == "chr3") & (F.col("pos") < 200))
    return filters.listing(rows, 1_000_000).select("sample_id", "chrom", "pos", "alt_allele", "vaf").distinct()


@query("f18_read_bounds", "alt_reads", "SELECT max(family_size) AS max_family_size, coalesce(max(cycle), 300) AS max_cycle, coalesce(max(map_qual), 60) AS max_map_qual, count(insert_size) > 0 AS has_insert_size FROM alt_reads")
def _(x):
    return filters.read_bounds(x)


@query("f19_distinct_genes", "alt_bases", "SELECT DISTINCT gene AS value FROM alt_bases WHERE gene IS NOT NULL")
def _(a):
    return filters.distinct_values(a, "gene")


@query("f20_gene_list", "coverage", "SELECT gene, count(*) AS n FROM coverage WHERE gene IN ('G1', 'G5', 'G9') GROUP BY gene")
def _(c):
    return filters.coverage_filter(c, genes=("G1", "G5", "G9")).groupBy("gene").agg(F.count("*").alias("n"))


# Summaries of loci --------------------------------------------------------------------------------------------------


@query(
    "a1_summary", "alt_bases",
    f"""SELECT count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples, CAST(coalesce(sum(alt_count), 0) AS BIGINT) AS total_alt_reads, coalesce({r(f'avg({VAF})', 4)}, 0) AS mean_vaf,
    coalesce({r('avg(total_depth)', 1)}, 0) AS mean_depth, count(variant_called) AS n_annotated, count(*) FILTER (variant_called) AS n_called FROM alt_bases WHERE alt_count >= 5""",
)
def _(a):
    return cohort.summary(Filters(alt_min=5).apply(a))


@query("a2_vaf_histogram", "alt_bases", f"""SELECT variant_type, floor({r(VAF, 4)} * 50) / 50 AS vaf_bin, count(*) AS n, floor({r(VAF, 4)} * 50) / 50 + 0.02::DOUBLE AS bin_end
    FROM alt_bases WHERE total_depth > 0 AND alt_count <= total_depth GROUP BY ALL""")
def _(a):
    return cohort.vaf_histogram(a)


_FLIP = "ref_allele IN ('A', 'G')"
_COMP = "translate({}, 'ACGT', 'TGCA')"
_CONTEXT = f"""(SELECT *, substr(c, 1, 1) || '[' || rr || '>' || aa || ']' || substr(c, 3, 1) AS context FROM (SELECT *,
    CASE WHEN {_FLIP} THEN reverse({_COMP.format('trinuc_context')}) ELSE trinuc_context END AS c, CASE WHEN {_FLIP} THEN {_COMP.format('ref_allele')} ELSE ref_allele END AS rr,
    CASE WHEN {_FLIP} THEN {_COMP.format('alt_allele')} ELSE alt_allele END AS aa FROM alt_bases
    WHERE variant_type = 'SNV' AND regexp_full_match(trinuc_context, '[ACGT][ACGT][ACGT]')) x)"""
_GRID = """(SELECT b1 || '[' || s || ']' || b2 AS context FROM (VALUES ('C>A'), ('C>G'), ('C>T'), ('T>A'), ('T>C'), ('T>G')) t(s),
    (VALUES ('A'), ('C'), ('G'), ('T')) u(b1), (VALUES ('A'), ('C'), ('G'), ('T')) v(b2))"""


def spectrum_sql(rows: str, by: str | None = None) -> str:
    """Counts and fractions on the full grid of contexts, for each value of ``by`` that occurs."""
    if not by:
        return f"WITH x AS ({rows}) SELECT context, count(x.context) AS n, coalesce(count(x.context) / nullif((SELECT count(*) FROM x), 0)::DOUBLE, 0) AS fraction FROM {_GRID} g LEFT JOIN x USING (context) GROUP BY context"
    return f"""WITH x AS ({rows}), k AS (SELECT {by}, count(*) AS total FROM x GROUP BY {by}), c AS (SELECT {by}, context, count(*) AS n FROM x GROUP BY ALL)
        SELECT k.{by}, g.context, coalesce(n, 0) AS n, coalesce(n, 0) / total::DOUBLE AS fraction FROM k CROSS JOIN {_GRID} g LEFT JOIN c ON c.{by} IS NOT DISTINCT FROM k.{by} AND c.context = g.context"""


@query("a3_sbs96", "alt_bases", spectrum_sql(f"SELECT context FROM {_CONTEXT} y"))
def _(a):
    return spectra.spectrum(spectra.labelled(a))


@query("a4_sbs96_by_sample", "alt_bases", spectrum_sql(f"SELECT context, CASE WHEN batch IS NULL THEN sample_id ELSE sample_id || ' / ' || batch END AS sample FROM {_CONTEXT} y", "sample"))
def _(a):
    return spectra.sample_matrix(a)


@query("a5_sbs96_called", "alt_bases", spectrum_sql(f"SELECT context, variant_called FROM {_CONTEXT} y WHERE variant_called IS NOT NULL", "variant_called"))
def _(a):
    return spectra.by_called(a)


@query("a6_sbs96_vaf_class", "alt_bases", spectrum_sql(f"SELECT context, CASE WHEN {VAF} > 0.3 THEN 'germline' ELSE 'somatic' END AS vaf_class FROM {_CONTEXT} y", "vaf_class"))
def _(a):
    return spectra.by_vaf_class(a)


@query("a7_sbs96_by_read", "alt_bases alt_reads", spectrum_sql(f"SELECT context, CASE WHEN is_read1 THEN 'R1' ELSE 'R2' END AS read FROM {_CONTEXT} y JOIN alt_reads USING ({KEYS})", "read"))
def _(a, x):
    return spectra.by_read(a, x)


@query("a8_sbs96_family_size", "alt_bases alt_reads", spectrum_sql(f"""SELECT context, CASE WHEN coalesce(m, 1) <= 1 THEN 'singleton' ELSE 'multi' END AS family FROM {_CONTEXT} y
    LEFT JOIN (SELECT {KEYS}, median(family_size) AS m FROM alt_reads WHERE map_qual BETWEEN 10 AND 60 GROUP BY {KEYS}) z USING ({KEYS})""", "family"))
def _(a, x):
    return spectra.by_family_size(a, ReadFilters(map_qual=(10, 60)).apply(x))


@query("a9_simple_spectrum", "alt_bases", "SELECT ref_allele || '>' || alt_allele AS change, count(*) AS n FROM alt_bases WHERE variant_type = 'SNV' GROUP BY 1")
def _(a):
    return spectra.simple(a)


@query("a10_heatmap", "alt_bases", spectrum_sql(f"SELECT context, sample_id FROM {_CONTEXT} y", "sample_id"))
def _(a):
    return spectra.heatmap(a)


@query("a11_overlap_agreement", "alt_bases", f"SELECT {r('CAST(overlap_alt_agree AS DOUBLE) / nullif(overlap_alt_agree + overlap_alt_disagree, 0)', 3)} AS agreement, count(*) AS n FROM alt_bases WHERE overlap_depth > 0 GROUP BY 1")
def _(a):
    return cohort.overlap_agreement(a)


@query("a12_cohort_table", "alt_bases", f"WITH qc AS ({_QC.format('alt_bases')}) SELECT * FROM qc JOIN (SELECT sample_id, count(*) AS n_total FROM alt_bases GROUP BY 1) USING (sample_id)")
def _(a):
    return cohort.cohort_table(a)


@query("a13_strand_by_sample", "alt_bases", f"SELECT sample_id, batch, {r(f'avg({VAF})', 6)} AS mean_vaf, {r(f'avg({BALANCE})', 4)} AS mean_strand_balance, count(*) AS n_loci FROM alt_bases WHERE variant_type = 'SNV' GROUP BY 1, 2")
def _(a):
    return cohort.strand_by_sample(a)


@query("a14_quality_vs_loci", "alt_bases alt_reads", f"SELECT sample_id, count(DISTINCT (chrom, pos, alt_allele)) AS n_loci, {r('avg(base_qual)', 2)} AS mean_base_qual, count(*) AS n_reads FROM alt_bases JOIN alt_reads USING ({KEYS}) GROUP BY 1")
def _(a, x):
    return reads.quality_vs_loci(a, x)


@query("a15_sbs6_by_sample", "alt_bases", f"SELECT sample_id, {_SUBST} AS substitution, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY sample_id)::DOUBLE AS fraction FROM alt_bases WHERE variant_type = 'SNV' GROUP BY 1, 2")
def _(a):
    return spectra.per_sample_sbs6(a)


# Reads --------------------------------------------------------------------------------------------------------------

_J2 = f"(SELECT x.* FROM alt_reads x SEMI JOIN (SELECT DISTINCT {KEYS} FROM alt_bases WHERE alt_count >= 5) l USING ({KEYS}))"


def _loci(a):
    return Filters(alt_min=5).apply(a)


def _labelled_sql(by: str) -> str:
    return f"(SELECT r.*, l.{by} || CASE WHEN is_read1 THEN ' R1' ELSE ' R2' END AS label FROM {_J2} r JOIN (SELECT DISTINCT sample_id, {by} FROM alt_bases WHERE alt_count >= 5) l USING (sample_id))"


@query("a16_reads_by_cycle", "alt_bases alt_reads", f"SELECT label, cycle, count(*) AS n_reads, count(*) / sum(count(*)) OVER (PARTITION BY label)::DOUBLE AS fraction FROM {_labelled_sql('label1')} GROUP BY 1, 2")
def _(a, x):
    return reads.by_cycle(reads.grouped(reads.of_loci(x, _loci(a)), _loci(a), "label1", read_split=True))


@query("a17_quality_by_cycle", "alt_bases alt_reads", f"SELECT sample_id AS label, cycle, {r('avg(base_qual)', 2)} AS mean_base_qual, count(*) AS n_reads FROM {_J2} GROUP BY 1, 2")
def _(a, x):
    return reads.quality_by_cycle(reads.grouped(reads.of_loci(x, _loci(a)), _loci(a), "sample_id"))


_NB, _NA = "CAST(n_n_before_alt AS DOUBLE) / nullif(n_before_alt, 0)", "CAST(n_n_after_alt AS DOUBLE) / nullif(n_after_alt, 0)"


@query("a18_n_content", "alt_bases alt_reads", f"SELECT is_read1, count(*) AS n_reads, {r(f'avg({_NB})', 6)} AS mean_before, {r(f'avg({_NA})', 6)} AS mean_after, {r(f'median({_NA} - {_NB})', 6)} AS median_delta FROM {_J2} GROUP BY 1")
def _(a, x):
    return reads.n_content_by_read(reads.of_loci(x, _loci(a)))


@query("a19_trailing_n", "alt_bases alt_reads", f"SELECT {r('avg(CAST(trailing_n_run_len > 0 AS DOUBLE))', 6)} AS frac_trailing_n, {r(f'median({_NA} - {_NB})', 6)} AS median_delta FROM {_J2}")
def _(a, x):
    return reads.n_summary(reads.of_loci(x, _loci(a)))


@query("a20_read_length", "alt_reads", "SELECT median(read_length)::DOUBLE AS median_length, median(read_length)::DOUBLE * 2 AS gap_threshold FROM alt_reads")
def _(x):
    return reads.read_length(x)


@query("a21_insert_sizes", "alt_bases alt_reads", f"""WITH g AS (SELECT median(read_length) * 2 AS r2 FROM alt_reads), c AS (SELECT 'all' AS label, insert_size, count(*) AS n_reads FROM {_J2} WHERE insert_size BETWEEN 20 AND 500 GROUP BY 1, 2),
    e AS (SELECT label, insert_size, n_reads, n_reads / least(1.0::DOUBLE, r2 / insert_size::DOUBLE) AS n_eff FROM c, g) SELECT label, insert_size, n_reads, n_eff, {r('n_eff / sum(n_eff) OVER (PARTITION BY label)', 9)} AS fraction FROM e""")
def _(a, x):
    out = reads.insert_sizes(reads.grouped(reads.of_loci(x, _loci(a)), _loci(a)), x)
    return out.withColumn("fraction", cohort.rounded(F.col("fraction"), 9))


@query("a22_insert_by_vaf", "alt_bases alt_reads", f"""SELECT 'all' AS label, af_class, insert_size, count(*) AS n_reads FROM {_J2} r JOIN (SELECT DISTINCT {KEYS}, CASE WHEN {VAF} > 0.3 THEN 'germline' ELSE 'somatic' END AS af_class FROM alt_bases WHERE alt_count >= 5) c USING ({KEYS})
    WHERE insert_size IS NOT NULL GROUP BY ALL""")
def _(a, x):
    return reads.insert_by_vaf(reads.grouped(reads.of_loci(x, _loci(a)), _loci(a)), _loci(a))


@query("a23_mapq_by_repeat", "alt_bases alt_reads", f"""SELECT map_qual, locus_type, count(*) AS n_reads FROM {_J2} r JOIN (SELECT DISTINCT {KEYS}, CASE WHEN homopolymer_len >= 5 OR str_len >= 6 THEN 'repetitive' ELSE 'unique' END AS locus_type FROM alt_bases WHERE alt_count >= 5) c USING ({KEYS}) GROUP BY ALL""")
def _(a, x):
    return reads.mapq_by_repeat(reads.of_loci(x, _loci(a)), _loci(a))


@query("a24_family_sizes", "alt_bases alt_reads", f"SELECT sample_id AS label, family_size, count(*) AS n_reads FROM {_J2} WHERE family_size IS NOT NULL GROUP BY ALL")
def _(a, x):
    return reads.family_sizes(reads.grouped(reads.of_loci(x, _loci(a)), _loci(a), "sample_id"))


@query("a25_family_vs_vaf", "alt_bases alt_reads", f"SELECT {KEYS}, ref_allele, {r(VAF, 4)} AS vaf, {r('avg(family_size)', 4)} AS mean_family_size, count(*) AS n_reads FROM alt_bases JOIN alt_reads USING ({KEYS}) WHERE family_size IS NOT NULL AND alt_count >= 5 GROUP BY ALL")
def _(a, x):
    return reads.family_vs_vaf(_loci(a), x)


@query("a26_family_by_frequency", "alt_bases alt_reads", f"""WITH n AS (SELECT chrom, pos, ref_allele, alt_allele, count(DISTINCT sample_id) AS k FROM alt_bases GROUP BY ALL)
    SELECT CASE WHEN k = 1 THEN '1 sample' WHEN k <= 3 THEN '2-3 samples' ELSE '4+ samples' END AS frequency, min(family_size)::DOUBLE AS min, quantile_cont(family_size, 0.25)::DOUBLE AS q1, median(family_size)::DOUBLE AS median,
    quantile_cont(family_size, 0.75)::DOUBLE AS q3, max(family_size)::DOUBLE AS max, count(*) AS n_reads FROM alt_bases JOIN n USING (chrom, pos, ref_allele, alt_allele) JOIN alt_reads USING ({KEYS}) WHERE family_size IS NOT NULL GROUP BY 1""")
def _(a, x):
    return reads.family_by_frequency(a, x)


@query("a27_strand_families", "alt_bases alt_reads", f"SELECT ab_count, ba_count, count(*) AS n_reads FROM {_J2} WHERE ab_count IS NOT NULL AND ba_count IS NOT NULL GROUP BY ALL")
def _(a, x):
    return reads.strand_families(reads.of_loci(x, _loci(a)))


@query("j15_strand_family_loci", "alt_bases alt_reads", f"SELECT {_SHOWN} FROM alt_bases WHERE ({KEYS}) IN (SELECT ({KEYS}) FROM alt_reads WHERE ab_count = 2 AND ba_count = 1)")
def _(a, x):
    return reads.strand_family_loci(a, x, 2, 1).select(*_SHOWN_COLS)


# Evidence and comparison --------------------------------------------------------------------------------------------

_TUMOR = f"SELECT sample_id AS tumor_sample_id, chrom, pos, alt_allele AS tumor_alt_allele, {r(VAF, 4)} AS tumor_vaf FROM alt_bases"
_TKEYS = "tumor_sample_id, chrom, pos, tumor_alt_allele"
_NORMAL = f"""WITH t AS ({_TUMOR}), an AS (SELECT {_TKEYS}, normal_depth FROM normal_evidence WHERE normal_alt_allele IS NULL), ma AS (SELECT {_TKEYS}, normal_alt_count AS normal_alt FROM normal_evidence WHERE normal_alt_allele = tumor_alt_allele),
    j AS (SELECT *, CAST(coalesce(normal_alt, 0) AS DOUBLE) / nullif(normal_depth, 0) AS share FROM t LEFT JOIN an USING ({_TKEYS}) LEFT JOIN ma USING ({_TKEYS})),
    k AS (SELECT * EXCLUDE share, {r('share', 4)} AS normal_vaf, CASE WHEN normal_depth IS NULL THEN 'No normal data' WHEN normal_depth = 0 THEN 'No normal coverage' WHEN coalesce(normal_alt, 0) = 0 THEN 'Somatic candidate' WHEN share >= 0.2 THEN 'Germline-like' ELSE 'Artifact-like' END AS classification FROM j)"""


@query("j10_tumor_normal", "alt_bases normal_evidence", f"{_NORMAL} SELECT * FROM k")
def _(a, n):
    return compare.with_normal(a, n)


_TALLY = f"SELECT classification, count(*) AS n_loci, {r('count(*) * 100 / sum(count(*)) OVER ()::DOUBLE', 1)} AS pct FROM k GROUP BY 1"


@query("a28_tumor_normal_classes", "alt_bases normal_evidence", f"{_NORMAL} {_TALLY}")
def _(a, n):
    return compare.tally(compare.with_normal(a, n))


@query("a29_panel_classes", "alt_bases", f"""{_PANEL}, t AS ({_TUMOR}), k AS (SELECT CASE WHEN n_pon_samples IS NULL THEN 'No PoN data' WHEN n_pon_samples = 0 THEN 'PoN clean'
    WHEN CAST(n_pon_samples AS DOUBLE) / pon_total_samples >= 0.1 THEN 'Common in PoN' ELSE 'Rare in PoN' END AS classification FROM t LEFT JOIN pon USING ({_TKEYS})) {_TALLY}""")
def _(a):
    return compare.tally(compare.with_panel(a, _panel(a)))


def _side(where: str, s: str) -> str:
    own = ", ref_allele, trinuc_context" if s == "a" else ""
    return f"SELECT {KEYS}, variant_type AS type_{s}, total_depth AS total_depth_{s}, alt_count AS alt_count_{s}, fwd_alt_count AS fwd_alt_count_{s}, rev_alt_count AS rev_alt_count_{s}, {VAF} AS vaf_{s}{own}, true AS in_{s} FROM alt_bases WHERE {where}"


def _both(a: str, b: str) -> str:
    return f"""WITH sa AS ({_side(a, 'a')}), sb AS ({_side(b, 'b')}), fo AS (SELECT * EXCLUDE (in_a, in_b, type_a, type_b), CASE WHEN in_b IS NULL THEN 'only_a' WHEN in_a IS NULL THEN 'only_b' ELSE 'shared' END AS side,
    coalesce(type_a, type_b) AS variant_type FROM sa FULL JOIN sb USING ({KEYS}))"""


_PIPES, _TYPES = _both("pipeline = 'fgbio'", "pipeline = 'dragen'"), _both("read_type = 'simplex'", "read_type = 'duplex'")


def _pipes(a):
    return compare.concordance(a.where("pipeline = 'fgbio'"), a.where("pipeline = 'dragen'"))


def _types(a):
    return compare.concordance(a.where("read_type = 'simplex'"), a.where("read_type = 'duplex'"))


@query("j12_pipeline_concordance", "alt_bases", f"{_PIPES} SELECT * FROM fo")
def _(a):
    return _pipes(a)


@query("j13_read_type_concordance", "alt_bases", f"{_TYPES} SELECT * FROM fo")
def _(a):
    return _types(a)


@query("a30_concordance_counts", "alt_bases", f"{_PIPES} SELECT side, variant_type, count(*) AS n_loci FROM fo GROUP BY 1, 2")
def _(a):
    return compare.by_side(_pipes(a))


@query("a31_vaf_correlation", "alt_bases", f"{_PIPES} SELECT count(*) AS n_shared, {r('corr(vaf_a, vaf_b)', 6)} AS pearson_r FROM fo WHERE side = 'shared'")
def _(a):
    return compare.correlation(_pipes(a)).withColumn("pearson_r", cohort.rounded(F.col("pearson_r"), 6))


@query("a32_unique_medians", "alt_bases", f"""{_PIPES}, u AS (SELECT CASE WHEN side = 'only_a' THEN 'fgbio' ELSE 'dragen' END AS side_name, coalesce(vaf_a, vaf_b) AS vaf, coalesce(total_depth_a, total_depth_b) AS td, coalesce(alt_count_a, alt_count_b) AS ac FROM fo WHERE side <> 'shared')
    SELECT side_name, count(*) AS n_loci, median(vaf) AS median_vaf, median(td)::DOUBLE AS median_total_depth, median(ac)::DOUBLE AS median_alt_count FROM u GROUP BY 1""")
def _(a):
    return compare.unique_medians(compare.unique_loci(_pipes(a), "fgbio", "dragen"))


@query("a33_strand_fractions", "alt_bases", f"SELECT read_type, {KEYS}, {BALANCE} AS strand_fraction FROM alt_bases WHERE read_type IN ('simplex', 'duplex') AND fwd_alt_count + rev_alt_count > 0")
def _(a):
    return compare.strand_fractions({t: a.where(F.col("read_type") == t) for t in ("simplex", "duplex")})


@query("a34_locus_samples", "alt_bases", f"SELECT sample_id, alt_allele, alt_count, total_depth, {r(VAF, 4)} AS vaf FROM alt_bases WHERE chrom = 'chr1' AND pos = 17")
def _(a):
    return cohort.at_locus(a, "chr1", 17).select("sample_id", "alt_allele", "alt_count", "total_depth", "vaf")


@query("a34_locus_reads", "alt_reads", f"""SELECT sample_id, alt_allele, count(*) AS n_reads, {r('median(cycle)', 1)} AS median_cycle, {r('median(family_size)', 1)} AS median_family_size, min(family_size) AS min_family_size,
    max(family_size) AS max_family_size, {r('avg(base_qual)', 1)} AS mean_base_qual, count(*) FILTER (is_read1) AS n_read1 FROM alt_reads WHERE chrom = 'chr1' AND pos = 17 GROUP BY 1, 2""")
def _(x):
    return cohort.read_stats_at_locus(x, "chr1", 17)


_SCATTER = ["sample_id", "chrom", "pos", "ref_allele", "alt_allele", "fwd_alt_count", "rev_alt_count"]


@query("a35_strand_scatter", "alt_bases", f"SELECT {', '.join(_SCATTER)} FROM alt_bases WHERE variant_type = 'SNV' ORDER BY md5(concat_ws('|', {', '.join(_SCATTER)})), {', '.join(_SCATTER)} LIMIT 5000")
def _(a):
    return cohort.strand_scatter(a.where("variant_type = 'SNV'"))


# Coverage -----------------------------------------------------------------------------------------------------------


@query("a36_coverage_by_sample", "coverage", f"""SELECT sample_id, count(*) AS n_rows, {r('avg(total_depth)', 1)} AS mean_depth, {r('median(total_depth)', 1)} AS median_depth, min(total_depth) AS min_depth, max(total_depth) AS max_depth,
    {', '.join(f"{r(f'avg({c})', 3)} AS {c}" for c in ('frac_dup', 'frac_overlap', 'frac_mapq0', 'frac_low_mapq'))}, {r('avg(mean_insert_size) FILTER (n_insert_size_obs > 0)', 1)} AS mean_insert_size FROM coverage GROUP BY 1""")
def _(c):
    return profile.per_sample(c)


@query("a37_depth_histogram", "coverage", "SELECT sample_id, least(total_depth, 100) AS depth, CAST(sum(bin_n) AS BIGINT) AS n FROM coverage GROUP BY 1, 2")
def _(c):
    return profile.depth_histogram(c, 100)


_BREADTH = ", ".join(f"{r(f'sum(CASE WHEN total_depth >= {t} THEN bin_n ELSE 0 END) / sum(bin_n)::DOUBLE', 3)} AS frac_{t}x" for t in profile.THRESHOLDS)


@query("a38_breadth", "coverage", f"SELECT sample_id, {_BREADTH} FROM coverage GROUP BY 1")
def _(c):
    return profile.breadth(c)


_GC = f"SELECT sample_id, round(gc_content * 20) / 20 AS gc_bin, {r('avg(total_depth)', 2)} AS mean_depth, count(*) AS n FROM coverage GROUP BY 1, 2 HAVING count(*) >= 5"


@query("a39_gc_bias", "coverage", f"SELECT *, {r('mean_depth / sum(mean_depth) OVER (PARTITION BY sample_id)', 6)} AS normalised FROM ({_GC})")
def _(c):
    return profile.gc_bias(c)


@query("a39_gc_abundance", "coverage", f"SELECT gc_bin, {r('avg(n)', 4)} AS mean_n, {r('avg(n) / sum(avg(n)) OVER ()', 6)} AS abundance FROM ({_GC}) GROUP BY 1")
def _(c):
    return profile.gc_abundance(c)


@query("a40_mapq0_by_gc", "coverage", f"SELECT sample_id, round(gc_content * 20) / 20 AS gc_bin, {r('avg(frac_mapq0)', 4)} AS mean_mapq0, count(*) AS n FROM coverage GROUP BY 1, 2 HAVING count(*) >= 5")
def _(c):
    return profile.mapq0_by_gc(c)


@query("a41_undercovered", "coverage", f"""SELECT chrom, pos, gene, count(DISTINCT sample_id) AS n_samples_below, {r('avg(total_depth)', 1)} AS mean_depth, min(total_depth) AS min_depth, {r('avg(frac_mapq0)', 3)} AS mean_mapq0, {r('avg(gc_content)', 3)} AS mean_gc,
    max(bin_n) AS bin_n FROM coverage WHERE total_depth < 60 GROUP BY 1, 2, 3 HAVING count(DISTINCT sample_id) >= 2 ORDER BY n_samples_below DESC, mean_depth, chrom, pos, gene NULLS LAST LIMIT 1000""")
def _(c):
    return profile.undercovered(c, 60, 0.2, 12)


@query("a42_gene_coverage", "coverage", f"""SELECT gene, count(DISTINCT (chrom, pos)) AS n_positions, {r('avg(total_depth)', 1)} AS mean_depth, min(total_depth) AS min_depth, {r('avg(mean_mapq)', 1)} AS mean_mapq, {r('avg(gc_content)', 3)} AS mean_gc,
    count(*) FILTER (total_depth < 30) AS n_below, {r('count(*) FILTER (total_depth < 30) * 100 / count(*)::DOUBLE', 1)} AS pct_below FROM coverage WHERE gene IS NOT NULL AND gene <> '' GROUP BY 1""")
def _(c):
    return profile.by_gene(c, 30)


_EXPANDED = """(SELECT *, unnest(range(pos, "end")) AS p FROM coverage WHERE pos < "end" AND chrom = 'chr1')"""
_OWN = f"SELECT CAST(floor(p / 10.0::DOUBLE) * 10 AS BIGINT) AS pos_bin, sample_id, avg(total_depth) AS total_depth, avg(mean_mapq) AS mean_mapq, avg(frac_mapq0) AS frac_mapq0, avg(frac_low_mapq) AS frac_low_mapq, avg(gc_content) AS gc_content FROM {_EXPANDED} GROUP BY 1, 2"


@query("a43_depth_profile", "coverage", f"""WITH o AS ({_OWN}) SELECT pos_bin, {r('avg(total_depth)', 4)} AS mean_depth, {r('min(total_depth)', 4)} AS min_depth, {r('max(total_depth)', 4)} AS max_depth, {r('quantile_cont(total_depth, 0.25)', 4)} AS p25_depth,
    {r('median(total_depth)', 4)} AS p50_depth, {r('quantile_cont(total_depth, 0.75)', 4)} AS p75_depth, {', '.join(f"{r(f'avg({c})', 4)} AS {c}" for c in ('mean_mapq', 'frac_mapq0', 'frac_low_mapq', 'gc_content'))}, count(*) AS n_samples FROM o GROUP BY 1""")
def _(c):
    return profile.profile(c.where("chrom = 'chr1'"), 10)


@query("a44_sample_profile", "coverage", f"SELECT pos_bin, sample_id, {r('total_depth', 4)} AS total_depth FROM ({_OWN})")
def _(c):
    out = profile.sample_profile(c.where("chrom = 'chr1'"), 10)
    return out.select("pos_bin", "sample_id", cohort.rounded(F.col("total_depth"), 4).alias("total_depth"))


@query("a44_display_step", "coverage", """SELECT coalesce(max("end" - pos), 1) AS max_bin_width FROM coverage""")
def _(c):
    return profile.display_step(c)


@query("a44_expanded_positions", "coverage", f"SELECT count(DISTINCT (chrom, p)) AS n_positions FROM {_EXPANDED}")
def _(c):
    return profile.expanded_positions(c.where("chrom = 'chr1'"))


@query("a45_weighted_depth", "coverage", f"""SELECT sample_id, {r('sum(total_depth * ("end" - pos)) / sum("end" - pos)::DOUBLE', 2)} AS weighted_depth, {r('avg(total_depth)', 2)} AS plain_depth FROM coverage GROUP BY 1""")
def _(c):
    return profile.weighted_depth(c)


@query("a45_bin_widths", "coverage", """SELECT "end" - pos AS width, count(*) AS n FROM coverage GROUP BY 1""")
def _(c):
    return profile.bin_widths(c)


@query("j16_a46_interval_depths", "coverage coverage_intervals", f"""SELECT i.interval_name, i."start", i."end", count(*) AS n, {r('avg(total_depth)', 2)} AS mean_depth, min(total_depth) AS min_depth, max(total_depth) AS max_depth
    FROM (SELECT DISTINCT interval_name, "start", "end" FROM coverage_intervals WHERE gene = 'G5') i JOIN coverage c ON c.gene = 'G5' AND c.pos >= i."start" AND c.pos < i."end" GROUP BY 1, 2, 3""")
def _(c, i):
    return profile.interval_depths(i, c, "G5")


@query("a47_region_stats", "coverage", f"""SELECT sample_id, count(DISTINCT (chrom, pos)) AS n_positions, {r('avg(total_depth)', 1)} AS mean_depth, min(total_depth) AS min_depth, max(total_depth) AS max_depth, {r('quantile_cont(total_depth, 0.25)', 2)} AS p25,
    {r('quantile_cont(total_depth, 0.75)', 2)} AS p75 FROM coverage WHERE chrom = 'chr2' AND "end" > 100 AND pos < 3000 GROUP BY 1""")
def _(c):
    return profile.region_stats(c.where(filters.overlaps("chr2", 100, 3000)))


@query("a48_undercovered_intervals", "coverage_intervals", f"""SELECT chrom, "start", "end", interval_name, gene, count(DISTINCT sample_id) AS n_samples, {r('avg(mean_depth)', 2)} AS mean_depth, {r('avg(mean_mapq)', 2)} AS mean_mapq FROM coverage_intervals
    WHERE mean_depth < 40 GROUP BY ALL HAVING count(DISTINCT sample_id) >= 2 ORDER BY n_samples DESC, mean_depth, chrom, "start", "end", interval_name, gene NULLS LAST LIMIT 500""")
def _(i):
    return profile.undercovered_intervals(i, 40.0, 2)


@query("a49_interval_gc", "coverage_intervals", f"SELECT interval_name, gene, {r('avg(mean_gc_content)', 3)} AS gc, {r('avg(mean_depth)', 2)} AS mean_depth, {r('avg(mean_frac_mapq0)', 4)} AS mapq0, count(DISTINCT sample_id) AS n_samples FROM coverage_intervals GROUP BY 1, 2")
def _(i):
    return profile.interval_gc(i)


@query("a50_exon_heatmap", "coverage_intervals", f"""WITH c AS (SELECT gene, interval_name, {r('avg(frac_at_30x)', 3)} AS frac_at_30x FROM coverage_intervals WHERE gene IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT gene FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY min(frac_at_30x), gene LIMIT 8) SELECT c.* FROM c SEMI JOIN g USING (gene)""")
def _(i):
    return profile.exon_heatmap(i, 8)


@query("a51_bed", "alt_bases", """SELECT chrom, pos AS "start", max(CASE WHEN variant_type = 'deletion' THEN pos + length(alt_allele) ELSE pos + 1 END) AS "end" FROM alt_bases WHERE alt_count >= 20 GROUP BY 1, 2""")
def _(a):
    return cohort.bed(Filters(alt_min=20).apply(a))


@query("a52_selected_samples", "alt_bases", "SELECT DISTINCT sample_id FROM alt_bases WHERE gene = 'G7' AND alt_count >= 48")
def _(a):
    return cohort.selected_samples(Filters(gene="G7", alt_min=48).apply(a))
