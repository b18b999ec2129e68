"""Parquet tables, references, call sets, intervals, annotations, tracks, manifests.

Everything is read by Spark's own readers, so inputs may be in any store that
Spark reads. Positions are 0-based and half-open once they are read.
"""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Many files by column name; columns that some lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord, value`` of a text file (gzip too); ``ord`` follows the file's order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """``chrom, chunk_start, seq`` of a reference, upper-cased, in chunks of ``chunk`` bases.

    Records are split at their ``>``, so contigs are read in parallel.
    """
    records = spark.read.option("lineSep", ">").text(path).where("value != ''")
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", ""))
    whole = records.select(head.alias("chrom"), body.alias("bases")).where("bases != ''")
    starts = F.sequence(F.lit(0).cast("long"), (F.floor((F.length("bases") - 1) / chunk) * chunk).cast("long"), F.lit(chunk).cast("long"))
    cut = whole.select("chrom", F.explode(starts).alias("chunk_start"), "bases")
    return cut.select("chrom", "chunk_start", F.substring(F.col("bases"), (F.col("chunk_start") + 1).cast("int"), F.lit(chunk)).alias("seq"))


def vcf(spark: SparkSession, path: str, field: str = "AF") -> DataFrame:
    """``chrom, pos, ref, alt, alt_allele, alt_index, filter, af, ord`` of a text call set, a row for each allele.

    ``af`` is the value of the INFO ``field``. ``alt_allele`` is spelled as in the cohort tables: a base, ``+SEQ`` or ``-SEQ``.
    """
    if path.endswith(".bcf"):
        raise ValueError("binary call sets cannot be read without a native library; convert them to text")
    part = F.split("value", "\t")
    rows = _lines(spark, path).where("value not like '#%' and value != ''").select("ord", part.alias("f")).where(F.size("f") >= 7)
    info = F.regexp_extract(F.concat(F.lit(";"), F.coalesce(F.get("f", F.lit(7)), F.lit(""))), rf";{re.escape(field)}=([^;]*)", 1)
    rows = rows.select("ord", F.col("f")[0].alias("chrom"), (F.col("f")[1].cast("long") - 1).alias("pos"), F.upper(F.col("f")[3]).alias("ref"), F.upper(F.col("f")[4]).alias("alts"), F.col("f")[6].alias("filter"), info.alias("afs"))
    rows = rows.select("*", F.posexplode(F.split("alts", ",")).alias("alt_index", "alt"))
    kind = F.when(F.length("alt") > F.length("ref"), F.concat(F.lit("+"), F.expr("substring(alt, length(ref) + 1)"))).when(F.length("alt") < F.length("ref"), F.concat(F.lit("-"), F.expr("substring(ref, length(alt) + 1)"))).otherwise(F.col("alt"))
    af = F.expr("try_cast(get(split(afs, ','), alt_index) AS double)")
    return rows.select("chrom", "pos", "ref", "alt", kind.alias("alt_allele"), "alt_index", "filter", af.alias("af"), "ord")


def variants_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos, alt_allele, filter, ord`` of a table chrom, pos_start, pos_end, ref, var[, post_filter_flag].

    A header is any line whose second column is no number; short lines are skipped.
    """
    rows = _lines(spark, path).select("ord", F.split("value", "\t").alias("f")).where(F.size("f") >= 5)
    flag = F.trim(F.coalesce(F.get("f", F.lit(5)), F.lit("")))
    fine = F.when(flag.isin("", "NoRules"), "PASS").otherwise(flag)
    out = rows.select(F.col("f")[0].alias("chrom"), F.expr("try_cast(f[1] AS bigint)").alias("pos"), F.col("f")[4].alias("alt_allele"), fine.alias("filter"), "ord")
    return out.where("pos is not null")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end, interval_name`` of BED lines or of an interval list (any line with ``@``)."""
    lines = _lines(spark, path)
    listed = not lines.where("value like '@%'").isEmpty()
    rows = lines.where(~F.col("value").rlike(r"^(@|#|browser|track|\s*$)")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    name = F.nullif(F.get("f", F.lit(4 if listed else 3)), F.lit(""))
    start = F.col("f")[1].cast("long") - (1 if listed else 0)
    return rows.select(F.col("f")[0].alias("chrom"), start.alias("start"), F.col("f")[2].cast("long").alias("end"), name.alias("interval_name"))


_KEPT = ("gene", "exon", "CDS", "five_prime_utr", "three_prime_utr", "five_prime_UTR", "three_prime_UTR", "5UTR", "3UTR", "UTR")


def genes(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end, feature, gene, exon_number`` by extension: genePred (.txt), GFF3 or GTF, gzip or not."""
    plain = path.removesuffix(".gz")
    if plain.endswith(".txt"):
        return _gene_pred(spark, path)
    gff = plain.endswith((".gff3", ".gff"))
    rows = _lines(spark, path).where("value not like '#%'").select(F.split("value", "\t").alias("f")).where(F.size("f") >= 9)
    rows = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("kind"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[8].alias("a")).where(F.col("kind").isin(*_KEPT))
    attr = lambda k: F.nullif(F.regexp_extract("a", (rf"(?:^|;)\s*{k}=([^;]*)" if gff else rf'(?:^|;)\s*{k} "?([^";]*)"?'), 1), F.lit(""))
    if gff:
        name = F.coalesce(F.when(~attr("Name").rlike("^(transcript|exon):"), attr("Name")), attr("gene_name"), attr("gene_id"))
    else:
        name = F.coalesce(attr("gene_name"), attr("gene_id"))
    kind = F.when(F.lower("kind").isin("five_prime_utr", "5utr"), "5UTR").when(F.lower("kind").isin("three_prime_utr", "3utr"), "3UTR").otherwise(F.col("kind"))
    number = F.when(F.col("kind") == "exon", F.expr("try_cast(nullif(n, '') AS int)"))
    rows = rows.withColumn("n", F.coalesce(attr("exon_number"), F.lit("")))
    return rows.select("chrom", "start", "end", kind.alias("feature"), name.alias("gene"), number.alias("exon_number"))


def _gene_pred(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts and their numbered exons of a genePred table with a bin column."""
    rows = _lines(spark, path).where("value not like '#%'").select(F.split("value", "\t").alias("f")).where(F.size("f") >= 13)
    numbers = lambda i: F.transform(F.filter(F.split(F.col("f")[i], ","), lambda x: x != ""), lambda x: x.cast("long"))
    rows = rows.select(F.col("f")[2].alias("chrom"), F.col("f")[3].alias("strand"), F.col("f")[4].cast("long").alias("a"), F.col("f")[5].cast("long").alias("b"), numbers(9).alias("starts"), numbers(10).alias("ends"), F.col("f")[12].alias("gene"))
    whole = rows.select("chrom", F.col("a").alias("start"), F.col("b").alias("end"), F.lit("gene").alias("feature"), "gene", F.lit(None).cast("int").alias("exon_number"))
    each = rows.select("chrom", "strand", "gene", F.size("starts").alias("n"), F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "e"))
    number = F.when(F.col("strand") == "-", F.col("n") - F.col("i")).otherwise(F.col("i") + 1)
    exons = each.select("chrom", F.col("e.starts").alias("start"), F.col("e.ends").alias("end"), F.lit("exon").alias("feature"), "gene", number.cast("int").alias("exon_number"))
    return whole.unionByName(exons)


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end, score``; an interval that does not begin before its end is an error."""
    if path.endswith(".gz"):
        raise ValueError("tracks are read uncompressed")
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|browser|track|\s*$)")).select(F.split("value", "\t").alias("f"))
    out = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.col("f")[3].cast("double").alias("score"))
    fine = F.when(F.col("start") < F.col("end"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("track interval ends before it begins: "), "chrom", F.lit(":"), F.col("start").cast("string"))).cast("long"))
    return out.withColumn("start", fine)


def track_specs(texts: list[str]) -> list[tuple[str, str]]:
    """``NAME:path`` in order; names may not be empty or repeat."""
    out = []
    for text in texts:
        name, sep, path = text.partition(":")
        if not sep or not name.strip() or not path or name in dict(out):
            raise ValueError(f"not NAME:path: {text!r}")
        out.append((name, path))
    return out


def signatures(spark: SparkSession, path: str):
    """Contexts x signatures as a pandas table; it has 96 rows whatever the cohort."""
    table = spark.read.csv(path, sep="\t", header=True).toPandas()
    return table.set_index(table.columns[0]).astype(float)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``sample, bam, bai, variants`` of a table with a header; the last two may be missing."""
    rows = spark.read.csv(path, sep="\t", header=True)
    names = {c.lower(): c for c in rows.columns}
    if not {"sample", "bam"} <= set(names):
        raise ValueError("a manifest needs the columns sample and bam")
    return rows.select(*[F.col(names[c]).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("sample", "bam", "bai", "variants")])


CONFIG_KEYS = ("data", "manifest", "reference", "targets", "genes", "tracks", "signatures", "gnomad")


def config(text: str, folder: str) -> dict[str, object]:
    """A project file's known keys; relative paths are taken from ``folder``, URIs stay as they are."""
    held = tomllib.loads(text)
    unknown = sorted(set(held) - set(CONFIG_KEYS))
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")

    def place(x):
        if isinstance(x, list):
            return [place(y) for y in x]
        return x if not isinstance(x, str) or x.startswith("/") or re.match(r"^[a-z][a-z0-9+.-]*://", x) else f"{folder.rstrip('/')}/{x}"

    return {k: place(v) for k, v in held.items()}
