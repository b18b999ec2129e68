"""Queries over derived reads, intervals and annotations: joins by range, pileup, coverage, bins, evidence."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import contexts96
from ..operators import annotate, coverage, intervals, pileup, signatures, spectra
from .derived import TABLES, spark_table

GENOME = "ACGGTCATTN" * 50
_REF = "substr('{0}', CAST({1} AS INT) + 1, 1)".format(GENOME, "({})")
_POS = "(l_orderkey * 7 % 400 + l_linenumber)"
_BASE = f"CASE WHEN (l_partkey * 3 + {{j}}) % 5 = 0 THEN substr('ACGTN', CAST((l_partkey + {{j}}) % 5 AS INT) + 1, 1) ELSE {_REF.format(_POS + ' + {j}')} END"
_FLAG = "CASE l_linenumber WHEN 1 THEN 99 WHEN 2 THEN 147 ELSE 16 END + CASE WHEN l_partkey % 9 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 31 = 0 THEN 256 ELSE 0 END"
_READ = f"""concat('S', CAST(l_orderkey % 3 AS STRING)) AS sample_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS read_ordinal, concat('q', CAST(l_orderkey AS STRING)) AS qname, CAST({_FLAG} AS INT) AS flag,
    concat('chr', CAST(l_orderkey % 2 + 1 AS STRING)) AS chrom, CAST(l_partkey % 61 AS INT) AS mapq, CAST(l_orderkey % 300 - 100 AS INT) AS tlen"""


def _reads(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """``placed`` adds ``file_row``: ordinals repeat where part keys are 100,000 apart, and SQL then takes the file's first read."""
    seq = ", ".join(_BASE.format(j=j) for j in range(6))
    quals = ", ".join(f"CAST(10 + (l_partkey + {j}) % 30 AS INT)" for j in range(6))
    text = f"SELECT {_READ}, {_POS} AS pos, '6M' AS cigar, concat({seq}) AS seq, array({quals}) AS quals, map('cD', CAST(l_partkey % 7 AS INT)) AS tags{', file_row' if placed else ''} FROM {{lineitem}}"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if placed:
        names = sorted(x.rsplit("/", 1)[-1] for x in lines.inputFiles())
        nth = F.array_position(F.array(*map(F.lit, names)), F.col("_metadata.file_name")) if len(names) > 1 else F.lit(0)
        lines = lines.select("l_orderkey", "l_partkey", "l_linenumber", (F.shiftleft(nth.cast("long"), 40) + F.col("_metadata.row_index")).alias("file_row"))
    return spark.sql(text, lineitem=lines)


def _reference(spark: SparkSession) -> DataFrame:
    rows = [(c, a, GENOME[a : a + 64]) for c in ("chr1", "chr2") for a in range(0, len(GENOME), 64)]
    return spark.createDataFrame(rows, "chrom string, chunk_start long, seq string")


#: A row for each base of each derived read, for DuckDB.
_BASES = f"""bases AS (SELECT {_READ}, {_POS} + j AS pos, {_BASE.format(j='j')} AS base, 10 + (l_partkey + j) % 30 AS qual FROM lineitem, (VALUES (0), (1), (2), (3), (4), (5)) v(j))"""
_USED = "SELECT * FROM bases WHERE (flag & 3328) = 0 AND mapq >= 10 AND qual >= 15"

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def add(build):
        _FOUND[name] = (build, sql)
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# Pileup -------------------------------------------------------------------------------------------------------------

_PILEUP = f"""WITH {_BASES}, f AS (SELECT sample_id, chrom, pos, qname, count(*) AS n, list({{'o': read_ordinal, 'a': base, 's': (flag & 16) = 0, 'e': (flag & 64) <> 0}} ORDER BY read_ordinal) AS r FROM ({_USED}) GROUP BY ALL),
    d AS (SELECT sample_id, chrom, pos, CAST(sum(CASE WHEN n = 2 THEN 1 ELSE len(list_filter(r, lambda x: x.a <> 'N')) END) AS INT) AS total_depth,
        CAST(sum(CASE WHEN n = 2 THEN CAST(CASE WHEN r[1].e THEN r[1].s ELSE r[2].s END AS INT) ELSE len(list_filter(r, lambda x: x.a <> 'N' AND x.s)) END) AS INT) AS fwd_depth,
        CAST(count(*) FILTER (n = 2) AS INT) AS overlap_depth FROM f GROUP BY ALL),
    l AS (SELECT *, {_REF.format('pos')} AS ref FROM d WHERE total_depth > 0 AND {_REF.format('pos')} <> 'N'),
    k AS (SELECT f.*, ref, r[1].a AS x, r[2].a AS y, r[1].s AS xs, r[2].s AS ys FROM f JOIN l USING (sample_id, chrom, pos)),
    single AS (SELECT sample_id, chrom, pos, ref, u.a AS allele, u.s AS fwd, NOT u.s AS rev, 0 AS agree, 0 AS disagree FROM (SELECT *, unnest(r) AS u FROM k WHERE n <> 2) WHERE u.a <> 'N'),
    pair AS (SELECT * FROM k WHERE n = 2),
    t AS (SELECT * FROM single
        UNION ALL SELECT sample_id, chrom, pos, ref, x, true, true, 1, 0 FROM pair WHERE x = y AND x <> 'N'
        UNION ALL SELECT sample_id, chrom, pos, ref, x, xs, NOT xs, 0, 0 FROM pair WHERE x <> 'N' AND y = 'N'
        UNION ALL SELECT sample_id, chrom, pos, ref, y, ys, NOT ys, 0, 0 FROM pair WHERE y <> 'N' AND x = 'N'
        UNION ALL SELECT sample_id, chrom, pos, ref, x, xs, NOT xs, 0, 1 FROM pair WHERE x <> y AND x <> 'N' AND y <> 'N' AND x <> ref
        UNION ALL SELECT sample_id, chrom, pos, ref, y, ys, NOT ys, 0, 1 FROM pair WHERE x <> y AND x <> 'N' AND y <> 'N' AND y <> ref),
    c AS (SELECT sample_id, chrom, pos, ref, allele, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (fwd) AS INT) AS fwd, CAST(count(*) FILTER (rev) AS INT) AS rev, CAST(sum(agree) AS INT) AS agree, CAST(sum(disagree) AS INT) AS disagree FROM t GROUP BY ALL),
    out AS (SELECT l.sample_id, l.chrom, l.pos, l.ref AS ref_allele, c.allele AS alt_allele, 'SNV' AS variant_type, total_depth, c.n AS alt_count, coalesce(o.n, 0) AS ref_count, fwd_depth, total_depth - fwd_depth AS rev_depth, c.fwd AS fwd_alt_count, c.rev AS rev_alt_count,
        coalesce(o.fwd, 0) AS fwd_ref_count, coalesce(o.rev, 0) AS rev_ref_count, overlap_depth, c.agree AS overlap_alt_agree, c.disagree AS overlap_alt_disagree, coalesce(o.agree, 0) AS overlap_ref_agree
        FROM l JOIN c USING (sample_id, chrom, pos) LEFT JOIN c o ON o.sample_id = l.sample_id AND o.chrom = l.chrom AND o.pos = l.pos AND o.allele = l.ref WHERE c.allele <> l.ref)"""


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.alt_bases(_reads(spark, sf_dir), _reference(spark), 10, 15, chunk=64)


@query("p1_p8_pileup", f"{_PILEUP} SELECT * FROM out")
def _(spark, sf_dir):
    return _loci(spark, sf_dir)


@query(
    "p12_p14_alt_reads",
    f"""{_PILEUP}, s AS (SELECT u.sample_id, u.chrom, u.pos, u.qname, u.base, u.read_ordinal, u.flag, u.qual, u.mapq, u.tlen, f.n, count(*) OVER (PARTITION BY u.sample_id, u.chrom, u.pos, u.qname, u.base) AS m,
        row_number() OVER (PARTITION BY u.sample_id, u.chrom, u.pos, u.qname, u.base ORDER BY u.read_ordinal) AS k, first_value((u.flag & 64) <> 0) OVER (PARTITION BY u.sample_id, u.chrom, u.pos, u.qname, u.base ORDER BY u.read_ordinal) AS lead1
        FROM ({_USED}) u JOIN f USING (sample_id, chrom, pos, qname) SEMI JOIN out ON out.sample_id = u.sample_id AND out.chrom = u.chrom AND out.pos = u.pos AND out.alt_allele = u.base)
    SELECT sample_id, chrom, pos, base AS alt_allele, (flag & 64) <> 0 AS is_read1, CAST(qual AS INT) AS base_qual, mapq AS map_qual, CASE WHEN tlen <> 0 THEN abs(tlen) END AS insert_size FROM s WHERE NOT (n = 2 AND m = 2) OR (CASE WHEN lead1 THEN k = 1 ELSE k = 2 END)""",
)
def _(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    out = pileup.alt_reads(reads, _loci(spark, sf_dir), 10, 15)
    return out.select("sample_id", "chrom", "pos", "alt_allele", "is_read1", "base_qual", "map_qual", "insert_size")


@query(
    "q8_j21_normal_evidence",
    f"""{_PILEUP}, tu AS (SELECT DISTINCT sample_id AS tumor_sample_id, chrom, pos, ref_allele, alt_allele AS tumor_alt_allele FROM out WHERE sample_id = 'S1'),
    fr AS (SELECT chrom, pos, qname, arg_min(base, read_ordinal) AS base FROM ({_USED}) WHERE sample_id = 'S2' GROUP BY ALL),
    cc AS (SELECT chrom, pos, base, CAST(count(*) AS INT) AS n FROM fr WHERE base <> 'N' GROUP BY ALL), dd AS (SELECT chrom, pos, CAST(sum(n) AS INT) AS normal_depth FROM cc GROUP BY ALL),
    b AS (SELECT tu.*, coalesce(normal_depth, 0) AS normal_depth FROM tu LEFT JOIN dd USING (chrom, pos))
    SELECT tumor_sample_id, chrom, pos, tumor_alt_allele, 'S2' AS normal_sample_id, NULL AS normal_alt_allele, normal_depth, 0 AS normal_alt_count FROM b
    UNION ALL SELECT tumor_sample_id, chrom, pos, tumor_alt_allele, 'S2', base, normal_depth, n FROM b JOIN cc USING (chrom, pos) WHERE base <> ref_allele""",
)
def _(spark, sf_dir):
    reads = _reads(spark, sf_dir, placed=True)
    return pileup.normal_evidence(_loci(spark, sf_dir).where("sample_id = 'S1'"), reads.where("sample_id = 'S2'"), "S2", 10, 15)


@query(
    "p16_context",
    f"{_PILEUP} SELECT DISTINCT chrom, pos, alt_allele, CASE WHEN pos >= 1 AND pos + 1 < {len(GENOME)} THEN substr('{GENOME}', CAST(pos AS INT), 3) END AS trinuc_context FROM out",
)
def _(spark, sf_dir):
    loci = _loci(spark, sf_dir).select("chrom", "pos", "alt_allele", "variant_type").distinct()
    loci = annotate.windows(loci, _reference(spark), 10, 64)
    return annotate.context(loci).select("chrom", "pos", "alt_allele", "trinuc_context").distinct()


@query("p17_p18_repeats", None)
def _(spark, sf_dir):
    loci = annotate.windows(_loci(spark, sf_dir).select("chrom", "pos").distinct(), _reference(spark), 10, 64)
    return annotate.with_repeats(loci).select("chrom", "pos", "homopolymer_len", "str_period", "str_len").distinct()


# Coverage -----------------------------------------------------------------------------------------------------------

_COVER = f"""{_BASES}, live AS (SELECT *, (flag & 1024) <> 0 AS dup FROM bases WHERE (flag & 2304) = 0), own AS (SELECT *, NOT dup AND mapq >= 10 AS fine FROM live),
    fr AS (SELECT sample_id, chrom, pos, qname, count(*) AS raw, count(*) FILTER (dup) AS dups, count(*) FILTER (NOT dup) AS alive, sum(mapq) FILTER (NOT dup) AS mq, count(*) FILTER (NOT dup AND mapq = 0) AS mq0, count(*) FILTER (fine) AS n, sum(qual) FILTER (fine) AS bq,
        arg_min((flag & 16) = 0, CASE WHEN fine THEN (CASE WHEN (flag & 64) <> 0 THEN 0 ELSE 1 END) * 1000000000000000 + read_ordinal END) AS lead, arg_min((flag & 16) = 0, CASE WHEN fine THEN read_ordinal END) AS early FROM own GROUP BY ALL),
    cov AS (SELECT sample_id, chrom, pos, CAST(count(*) FILTER (n > 0) AS INT) AS total_depth, CAST(count(*) FILTER (n > 0 AND CASE WHEN n = 2 THEN lead ELSE early END) AS INT) AS fwd_depth, CAST(sum(raw) AS INT) AS raw_read_depth, CAST(sum(dups) / sum(raw)::DOUBLE AS FLOAT) AS frac_dup,
        CAST(count(*) FILTER (n = 2) AS INT) AS overlap_depth, CAST(coalesce(sum(mq) / nullif(sum(alive), 0)::DOUBLE, 0) AS FLOAT) AS mean_mapq, CAST(coalesce(sum(mq0) / nullif(sum(alive), 0)::DOUBLE, 0) AS FLOAT) AS frac_mapq0,
        CAST(coalesce(sum(bq) / nullif(sum(n), 0)::DOUBLE, 0) AS FLOAT) AS mean_base_qual FROM fr GROUP BY ALL)"""
_COVER_COLS = ["sample_id", "chrom", "pos", "total_depth", "fwd_depth", "raw_read_depth", "frac_dup", "overlap_depth", "mean_mapq", "frac_mapq0", "mean_base_qual"]


def _tally(spark, sf_dir):
    return coverage.tally(_reads(spark, sf_dir), 10)


@query("c1_c3_coverage", f"WITH {_COVER} SELECT * FROM cov")
def _(spark, sf_dir):
    return _tally(spark, sf_dir).select(*_COVER_COLS)


@query("c5_depth_floor", f"WITH {_COVER} SELECT sample_id, chrom, pos, total_depth FROM cov WHERE total_depth >= 20")
def _(spark, sf_dir):
    return coverage.floor(_tally(spark, sf_dir), 20).select("sample_id", "chrom", "pos", "total_depth")


_TARGETS = [("chr1", 20, 60, "t1"), ("chr1", 50, 90, "t2"), ("chr2", 395, 420, "t3")]
_TARGET_SQL = f"targets AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _TARGETS)}) v(chrom, a, b, name))"


def _targets(spark):
    return spark.createDataFrame(_TARGETS, "chrom string, start long, end long, interval_name string")


@query(
    "c8_zero_fill",
    f"""WITH {_COVER}, {_TARGET_SQL}, places AS (SELECT DISTINCT chrom, unnest(range(a, b)) AS pos FROM targets), want AS (SELECT s.sample_id, p.* FROM places p, (SELECT DISTINCT sample_id FROM bases) s)
    SELECT w.sample_id, w.chrom, w.pos, 0 AS total_depth FROM want w ANTI JOIN cov USING (sample_id, chrom, pos)""",
)
def _(spark, sf_dir):
    rows = _tally(spark, sf_dir)
    return coverage.zero_filled(rows, coverage.target_places(_reads(spark, sf_dir), _targets(spark))).select("sample_id", "chrom", "pos", "total_depth")


@query("c9_reference_fill", f"WITH {_COVER}, want AS (SELECT s.sample_id, c.chrom, unnest(range(0, {len(GENOME)})) AS pos FROM (VALUES ('chr1'), ('chr2')) c(chrom), (SELECT DISTINCT sample_id FROM bases) s) SELECT w.* FROM want w ANTI JOIN cov USING (sample_id, chrom, pos)")
def _(spark, sf_dir):
    places = coverage.contig_places(_reads(spark, sf_dir), coverage.contigs_of(_reference(spark)))
    return coverage.zero_filled(_tally(spark, sf_dir), places).select("sample_id", "chrom", "pos")


@query("c13_on_target_only", f"WITH {_COVER}, {_TARGET_SQL} SELECT sample_id, chrom, pos, total_depth, raw_read_depth FROM cov SEMI JOIN targets t ON t.chrom = cov.chrom AND cov.pos >= t.a AND cov.pos < t.b")
def _(spark, sf_dir):
    return coverage.tally(_reads(spark, sf_dir), 10, targets=_targets(spark)).select("sample_id", "chrom", "pos", "total_depth", "raw_read_depth")


_BIN = """SELECT sample_id, chrom, {pos} AS pos, {pos} + count(*) AS "end", CAST(count(*) AS INT) AS bin_n, CAST(round(avg(total_depth)) AS INT) AS total_depth, min(total_depth) AS min_depth, max(total_depth) AS max_depth FROM {source} GROUP BY {by}"""
_BIN_COLS = ["sample_id", "chrom", "pos", "end", "bin_n", "total_depth", "min_depth", "max_depth"]


@query("c6_fixed_bins", f"WITH {_COVER}, z AS (SELECT *, pos // 25 * 25 AS bin FROM cov) {_BIN.format(pos='bin', source='z', by='sample_id, chrom, bin')}")
def _(spark, sf_dir):
    return coverage.binned(_tally(spark, sf_dir), 25).select(*_BIN_COLS)


@query(
    "c7_adaptive_bins",
    f"""WITH {_COVER}, m AS (SELECT sample_id, CAST(avg(total_depth) AS INT) AS t FROM cov GROUP BY 1), z0 AS (SELECT *, pos // 25 * 25 AS bin, total_depth < 24 AS low FROM cov), z AS (SELECT *, sum(CAST(low AS INT)) OVER (PARTITION BY sample_id, chrom, bin ORDER BY pos) AS seg FROM z0)
    {_BIN.format(pos='CASE WHEN low THEN min(pos) ELSE bin END', source='z', by='sample_id, chrom, bin, seg, low')}""",
)
def _(spark, sf_dir):
    return coverage.binned(_tally(spark, sf_dir), 25, adaptive=24).select(*_BIN_COLS)


@query(
    "c11_interval_summary",
    f"""WITH {_COVER}, {_TARGET_SQL}, o AS (SELECT cov.*, t.*, row_number() OVER (PARTITION BY sample_id, cov.chrom, pos ORDER BY a DESC) AS k FROM cov JOIN targets t ON t.chrom = cov.chrom AND pos >= a AND pos < b),
    p AS (SELECT sample_id, chrom, a, b, name, unnest(range(a, b)) AS pos FROM targets, (SELECT DISTINCT sample_id FROM bases)), e AS (SELECT sample_id, a, b, name, total_depth FROM o WHERE k = 1 UNION ALL SELECT p.sample_id, a, b, name, 0 FROM p ANTI JOIN cov USING (sample_id, chrom, pos))
    SELECT sample_id, name AS interval_name, a AS "start", b AS "end", CAST(count(*) AS INT) AS n_bases, CAST(avg(total_depth) AS FLOAT) AS mean_depth, CAST(median(total_depth) AS FLOAT) AS median_depth, min(total_depth) AS min_depth, max(total_depth) AS max_depth,
    CAST(avg(CASE WHEN total_depth >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS FLOAT) AS frac_at_1x, CAST(avg(CASE WHEN total_depth >= 10 THEN 1.0::DOUBLE ELSE 0 END) AS FLOAT) AS frac_at_10x FROM e GROUP BY ALL""",
)
def _(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    out = coverage.interval_summary(_tally(spark, sf_dir), reads, _targets(spark))
    return out.select("sample_id", "interval_name", "start", "end", "n_bases", "mean_depth", "median_depth", "min_depth", "max_depth", "frac_at_1x", "frac_at_10x")


# Intervals and annotations ------------------------------------------------------------------------------------------

_POINTS = "SELECT DISTINCT concat('chr', CAST(l_linenumber AS STRING)) AS chrom, l_partkey * 9 % 60000 AS pos FROM {lineitem}"
_FEATURES = """SELECT concat('chr', CAST(p_partkey % 7 + 1 AS STRING)) AS chrom, p_partkey * 10 % 60000 AS "start", p_partkey * 10 % 60000 + p_size * (1 + p_partkey % 4 * 4) AS "end",
    CASE p_partkey % 4 WHEN 0 THEN 'CDS' WHEN 1 THEN 'exon' WHEN 2 THEN '5UTR' ELSE 'gene' END AS feature, concat('G', CAST(p_partkey AS STRING)) AS gene, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_partkey % 20 AS INT) END AS exon_number FROM {part}"""
_IV = f"points AS ({_POINTS.format(lineitem='lineitem')}), feats AS ({_FEATURES.format(part='part')})"


def _points(spark, sf_dir):
    return spark.sql(_POINTS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _features(spark, sf_dir):
    return spark.sql(_FEATURES.replace('"', "`"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


@query("j6_on_target", f"""WITH {_IV} SELECT p.chrom, p.pos, EXISTS (SELECT 1 FROM feats f WHERE f.chrom = p.chrom AND p.pos >= f."start" AND p.pos < f."end") AS on_target FROM points p""")
def _(spark, sf_dir):
    return intervals.on_target(_points(spark, sf_dir), _features(spark, sf_dir), 512)


@query(
    "j7_best_feature",
    f"""WITH {_IV}, j AS (SELECT p.*, f.gene, f.feature, f.exon_number, row_number() OVER (PARTITION BY p.chrom, p.pos ORDER BY CASE feature WHEN 'CDS' THEN 4 WHEN 'exon' THEN 3 WHEN '5UTR' THEN 2 ELSE 0 END DESC, f."start" DESC, f."end" DESC, f.gene DESC) AS k
    FROM points p JOIN feats f ON f.chrom = p.chrom AND p.pos >= f."start" AND p.pos < f."end")
    SELECT p.*, gene, CASE WHEN feature <> 'gene' THEN feature END AS feature_type, CASE WHEN feature = 'exon' THEN exon_number END AS exon_number FROM points p LEFT JOIN (SELECT * FROM j WHERE k = 1) USING (chrom, pos)""",
)
def _(spark, sf_dir):
    return intervals.best_feature(_points(spark, sf_dir), _features(spark, sf_dir), 512)


@query(
    "j8_last_interval",
    f"""WITH {_IV}, j AS (SELECT p.*, f."start" AS s, f."end" AS e, row_number() OVER (PARTITION BY p.chrom, p.pos ORDER BY f."start" DESC, f."end" DESC) AS k FROM points p JOIN feats f ON f.chrom = p.chrom AND p.pos >= f."start" AND p.pos < f."end")
    SELECT chrom, pos, s AS "start", e AS "end" FROM j WHERE k = 1""",
)
def _(spark, sf_dir):
    return intervals.last_interval(_points(spark, sf_dir), _features(spark, sf_dir).select("chrom", "start", "end"), 512)


@query("s10_merged_intervals", f"""WITH {_IV}, o AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM feats),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT chrom, min("start") AS "start", max("end") AS "end" FROM g GROUP BY chrom, island""")
def _(spark, sf_dir):
    return intervals.merged(_features(spark, sf_dir))


@query("c12_track", f"""WITH {_IV}, j AS (SELECT p.chrom, p.pos, arg_max(CAST(f."end" - f."start" AS DOUBLE), f."start" * 1000000 + f."end") AS score FROM points p JOIN feats f ON f.chrom = p.chrom AND p.pos >= f."start" AND p.pos < f."end" WHERE f.feature = 'CDS' GROUP BY ALL)
    SELECT p.*, CAST(score AS FLOAT) AS gem FROM points p LEFT JOIN j USING (chrom, pos)""")
def _(spark, sf_dir):
    scores = _features(spark, sf_dir).where("feature = 'CDS'").select("chrom", "start", "end", (F.col("end") - F.col("start")).cast("double").alias("score"))
    return intervals.track(_points(spark, sf_dir), scores, "gem", 512)


_ALT_TABLE = f"alt_bases AS ({TABLES['alt_bases'].format(lineitem='lineitem')})"
_CALLED = "SELECT concat('chr', CAST(l_linenumber AS STRING)) AS chrom, l_partkey AS pos, substr('ACGT', CAST(l_orderkey % 4 AS INT) + 1, 1) AS alt_allele, CASE WHEN l_suppkey % 3 = 0 THEN 'PASS' ELSE 'weak' END AS filter, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS ord FROM {lineitem} WHERE l_orderkey % 11 = 0"


@query(
    "p19_calls",
    f"""WITH {_ALT_TABLE}, c AS ({_CALLED.format(lineitem='lineitem')}), x AS (SELECT chrom, pos, alt_allele, arg_min(filter, ord) AS fx FROM c GROUP BY ALL), y AS (SELECT chrom, pos, arg_min(filter, ord) AS fy FROM c GROUP BY ALL),
    z AS (SELECT a.*, CASE WHEN variant_type = 'SNV' THEN coalesce(fx, fy) ELSE fy END AS found FROM alt_bases a LEFT JOIN x USING (chrom, pos, alt_allele) LEFT JOIN y USING (chrom, pos))
    SELECT sample_id, chrom, pos, alt_allele, found IS NOT NULL AS variant_called, found AS variant_filter FROM z""",
)
def _(spark, sf_dir):
    called = spark.sql(_CALLED, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    loci = spark_table(spark, sf_dir, "alt_bases").drop("variant_called", "variant_filter")
    return annotate.calls(loci, called).select("sample_id", "chrom", "pos", "alt_allele", "variant_called", "variant_filter")


_KNOWN = "SELECT DISTINCT CAST(l_linenumber AS STRING) AS chrom, l_partkey AS pos, substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref, substr('ACGT', CAST((l_partkey + 1) % 4 AS INT) + 1, 1) AS alt, 0 AS alt_index, CAST(l_partkey % 64 AS DOUBLE) / 128 AS af FROM {lineitem} WHERE l_partkey % 3 = 0"


@query(
    "p20_population_frequency",
    f"""WITH {_ALT_TABLE}, g AS ({_KNOWN.format(lineitem='lineitem')}) SELECT sample_id, a.chrom, a.pos, alt_allele, variant_type, CAST(CASE WHEN variant_type = 'SNV' THEN s.af WHEN variant_type = 'insertion' THEN o.af
    ELSE d.af END AS FLOAT) AS gnomad_af FROM alt_bases a LEFT JOIN g s ON 'chr' || s.chrom = a.chrom AND s.pos = a.pos AND s.ref = a.ref_allele AND s.alt = a.alt_allele
    LEFT JOIN g o ON 'chr' || o.chrom = a.chrom AND o.pos = a.pos AND o.ref = a.ref_allele LEFT JOIN g d ON 'chr' || d.chrom = a.chrom AND d.pos = a.pos AND d.ref = substr(a.alt_allele, 2)""",
)
def _(spark, sf_dir):
    known = spark.sql(_KNOWN, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    loci = spark_table(spark, sf_dir, "alt_bases").drop("gnomad_af")
    return annotate.population_frequency(loci, known).select("sample_id", "chrom", "pos", "alt_allele", "variant_type", "gnomad_af")


@query("q11_union_by_name", f"WITH {_ALT_TABLE} SELECT sample_id, chrom, pos, alt_allele, batch FROM alt_bases WHERE pipeline = 'fgbio' UNION ALL SELECT sample_id, chrom, pos, alt_allele, NULL FROM alt_bases WHERE pipeline = 'dragen'")
def _(spark, sf_dir):
    a = spark_table(spark, sf_dir, "alt_bases").select("sample_id", "chrom", "pos", "alt_allele", "batch", "pipeline")
    whole, less = a.where("pipeline = 'fgbio'").drop("pipeline"), a.where("pipeline = 'dragen'").drop("pipeline", "batch")
    return whole.unionByName(less, allowMissingColumns=True)


@query("x5_sample_exposures", None)
def _(spark, sf_dir):
    rng = np.random.default_rng(5)
    known = pd.DataFrame(rng.dirichlet(np.ones(96), 4).T, index=contexts96(), columns=["A", "B", "C", "D"])
    matrix = spectra.sample_matrix(spark_table(spark, sf_dir, "alt_bases"))
    return signatures.fit_samples(matrix, known)
