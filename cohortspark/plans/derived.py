"""Cohort tables derived from ``lineitem`` and ``part`` by integer arithmetic.

The test tables hold no sequencing data. These SELECTs make tables of the
cohort's schemas from them; Spark and DuckDB evaluate the same text, in which
``{lineitem}`` and ``{part}`` stand for the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "substr('ACGT', CAST(({}) % 4 AS INT) + 1, 1)"
_SAMPLE = "concat('S', lpad(CAST(l_suppkey % 12 AS STRING), 2, '0'))"
_ALT = f"""CASE WHEN l_orderkey % 10 = 0 THEN concat('+', {BASE.format('l_partkey')}, {BASE.format('l_orderkey')})
    WHEN l_orderkey % 10 = 1 THEN concat('-', {BASE.format('l_partkey + 2')}) ELSE {BASE.format('l_partkey + 1 + l_orderkey % 3')} END"""

TABLES = {
    "alt_bases": f"""SELECT {_SAMPLE} AS sample_id, concat('chr', l_linenumber) AS chrom, l_partkey AS pos, {BASE.format('l_partkey')} AS ref_allele, {_ALT} AS alt_allele,
        CASE WHEN l_orderkey % 10 = 0 THEN 'insertion' WHEN l_orderkey % 10 = 1 THEN 'deletion' ELSE 'SNV' END AS variant_type,
        CAST(l_quantity + l_orderkey % 400 + 1 AS INT) AS total_depth, CAST(l_quantity AS INT) AS alt_count, CAST(l_orderkey % 400 + 1 AS INT) AS ref_count,
        CAST(l_orderkey % 7 AS INT) AS fwd_alt_count, CAST(l_partkey % 5 AS INT) AS rev_alt_count, CAST(l_orderkey % 4 AS INT) AS overlap_depth,
        CAST(l_orderkey % 3 AS INT) AS overlap_alt_agree, CAST(l_partkey % 2 AS INT) AS overlap_alt_disagree,
        CASE l_returnflag WHEN 'A' THEN 'raw' WHEN 'N' THEN 'simplex' ELSE 'duplex' END AS read_type,
        CASE l_linestatus WHEN 'F' THEN 'fgbio' ELSE 'dragen' END AS pipeline,
        CASE WHEN l_suppkey % 12 = 11 THEN NULL ELSE concat('B', CAST(l_suppkey % 12 % 3 AS STRING)) END AS batch,
        concat('L', CAST(l_suppkey % 2 AS STRING)) AS label1, concat('M', CAST(l_suppkey % 4 AS STRING)) AS label2, CAST(NULL AS STRING) AS label3,
        CASE l_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS variant_called,
        CASE l_orderkey % 6 WHEN 1 THEN 'PASS' WHEN 2 THEN 'weak' ELSE NULL END AS variant_filter,
        CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS on_target,
        CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('G', CAST(l_partkey % 23 AS STRING)) END AS gene,
        CAST(l_partkey % 9 AS INT) AS homopolymer_len, CAST(l_partkey % 4 AS INT) AS str_period, CAST((l_partkey % 4) * (l_partkey % 5) AS INT) AS str_len,
        CASE WHEN l_orderkey % 10 < 2 THEN NULL WHEN l_partkey % 11 = 0 THEN concat('N', {BASE.format('l_partkey')}, 'A')
             ELSE concat({BASE.format('l_partkey * 3 + l_linenumber')}, {BASE.format('l_partkey')}, {BASE.format('l_partkey * 7 + l_orderkey')}) END AS trinuc_context,
        CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey % 100 AS DOUBLE) / 1000 END AS gnomad_af
        FROM {{lineitem}}""",
    "alt_reads": f"""SELECT {_SAMPLE} AS sample_id, concat('chr', l_linenumber) AS chrom, l_partkey AS pos, {_ALT} AS alt_allele,
        CAST((l_orderkey * k + l_partkey) % 150 + 1 AS INT) AS cycle, CAST(100 + l_partkey % 3 * 25 AS INT) AS read_length, (l_orderkey + k) % 2 = 0 AS is_read1,
        CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE CAST((l_orderkey + k) % 6 + 1 AS INT) END AS family_size,
        CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE CAST((l_orderkey + k) % 4 AS INT) END AS ab_count,
        CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST((l_partkey + k) % 3 AS INT) END AS ba_count,
        CAST(20 + (l_partkey + k) % 20 AS INT) AS base_qual, CAST((l_orderkey * 7 + k) % 61 AS INT) AS map_qual,
        CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(10 + (l_orderkey * 13 + k * 7) % 500 AS INT) END AS insert_size,
        CAST(l_partkey % 6 AS INT) AS n_before_alt, CAST(l_orderkey % 5 AS INT) AS n_after_alt, CAST(l_partkey % 6 % 3 AS INT) AS n_n_before_alt,
        CAST(l_orderkey % 5 % 2 AS INT) AS n_n_after_alt, CAST(l_partkey % 2 AS INT) AS leading_n_run_len, CAST(l_orderkey % 3 % 2 AS INT) AS trailing_n_run_len
        FROM {{lineitem}} JOIN (VALUES (1), (2), (3)) AS copies(k) ON k <= l_orderkey % 4""",
    "normal_evidence": f"""SELECT t AS tumor_sample_id, chrom, pos, alt AS tumor_alt_allele, 'N1' AS normal_sample_id,
        CASE WHEN k = 1 THEN NULL ELSE alt END AS normal_alt_allele, depth AS normal_depth, CASE WHEN k = 1 THEN 0 ELSE seen END AS normal_alt_count
        FROM (SELECT {_SAMPLE} AS t, concat('chr', l_linenumber) AS chrom, l_partkey AS pos, {_ALT} AS alt,
              CAST(max(l_orderkey % 50) AS INT) AS depth, CAST(max(l_orderkey % 20) AS INT) AS seen, max(l_orderkey % 5) AS kind
              FROM {{lineitem}} WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2, 3, 4) AS one
        JOIN (VALUES (1), (2)) AS rows(k) ON k = 1 OR kind = 0""",
    "coverage": f"""SELECT {_SAMPLE} AS sample_id, concat('chr', l_linenumber) AS chrom, l_partkey * 3 AS pos, l_partkey * 3 + l_orderkey % 4 AS "end",
        CAST(l_orderkey % 3 + 1 AS INT) AS bin_n, CAST(l_quantity * 3 + l_orderkey % 5 * 10 AS INT) AS total_depth,
        CAST(l_orderkey % 10 AS DOUBLE) / 64 AS frac_dup, CAST(l_partkey % 10 AS DOUBLE) / 64 AS frac_overlap, CAST(l_orderkey % 61 AS DOUBLE) AS mean_mapq,
        CAST(l_orderkey % 8 AS DOUBLE) / 128 AS frac_mapq0, CAST(l_partkey % 9 AS DOUBLE) / 128 AS frac_low_mapq, CAST(100 + l_orderkey % 300 AS DOUBLE) AS mean_insert_size,
        CAST(l_orderkey % 4 AS INT) AS n_insert_size_obs, CAST(20 + l_partkey % 61 AS DOUBLE) / 128 AS gc_content,
        CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS on_target,
        CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('G', CAST(l_partkey % 23 AS STRING)) END AS gene,
        CASE WHEN l_suppkey % 12 = 11 THEN NULL ELSE concat('B', CAST(l_suppkey % 12 % 3 AS STRING)) END AS batch
        FROM {{lineitem}}""",
    "coverage_intervals": """SELECT concat('S', lpad(CAST(k AS STRING), 2, '0')) AS sample_id, concat('chr', CAST(p_partkey % 7 + 1 AS STRING)) AS chrom, p_partkey * 3 AS "start",
        p_partkey * 3 + p_size AS "end", concat('exon', CAST(p_partkey % 50 AS STRING)) AS interval_name,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('G', CAST(p_partkey % 23 AS STRING)) END AS gene,
        CAST((p_partkey * 7 + k * 13) % 200 AS DOUBLE) / 2 AS mean_depth, CAST((p_partkey + k) % 60 AS DOUBLE) AS mean_mapq, CAST(20 + p_partkey % 61 AS DOUBLE) / 128 AS mean_gc_content,
        CAST((p_partkey + k) % 8 AS DOUBLE) / 128 AS mean_frac_mapq0, CAST((p_partkey * 3 + k) % 100 AS DOUBLE) / 128 AS frac_at_30x
        FROM {part} JOIN (VALUES (0), (1), (2)) AS samples(k) ON true""",
}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = "part" if name == "coverage_intervals" else "lineitem"
    return spark.sql(TABLES[name].replace('"', "`"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def with_tables(body: str) -> str:
    """``body`` for DuckDB, with the derived tables that it names in front."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]
    ctes = ",\n".join(f"{t} AS ({TABLES[t].format(lineitem='lineitem', part='part')})" for t in used)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
