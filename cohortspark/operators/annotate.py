"""Annotations of loci: call sets, population frequencies, reference context, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import repeats


def calls(loci: DataFrame, called: DataFrame | None) -> DataFrame:
    """``variant_called, variant_filter`` from ``called(chrom, pos, alt_allele, filter, ord)``.

    A SNV matches by allele, else by place; an indel by place alone. The first
    record in file order wins. Without a call set both columns are null.
    """
    if called is None:
        return loci.withColumns({"variant_called": F.lit(None).cast("boolean"), "variant_filter": F.lit(None).cast("string")})
    exact = called.groupBy("chrom", "pos", "alt_allele").agg(F.min_by("filter", "ord").alias("_exact"))
    place = called.groupBy("chrom", "pos").agg(F.min_by("filter", "ord").alias("_place"))
    out = loci.join(exact, ["chrom", "pos", "alt_allele"], "left").join(place, ["chrom", "pos"], "left")
    found = F.when(F.col("variant_type") == "SNV", F.coalesce("_exact", "_place")).otherwise(F.col("_place"))
    return out.withColumns({"variant_called": found.isNotNull(), "variant_filter": found}).drop("_exact", "_place")


def _toggled(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1000)).otherwise(F.concat(F.lit("chr"), chrom))


def population_frequency(loci: DataFrame, known: DataFrame) -> DataFrame:
    """``gnomad_af`` from ``known(chrom, pos, ref, alt, alt_index, af)``: by place and reference allele.

    A SNV takes its own allele's frequency; an indel the record's first. The
    reference looked up for a deletion is the deleted sequence. Chromosome names
    match as they are, else with ``chr`` added or removed. NaN is null.
    """
    look = F.when(F.col("variant_type") == "deletion", F.expr("substring(alt_allele, 2)")).otherwise(F.col("ref_allele"))
    fine = known.withColumn("af", F.when(~F.isnan("af"), F.col("af")))
    # of repeated records the first one, where their order is known
    one = F.min_by("af", "ord") if "ord" in known.columns else F.min("af")
    snv = fine.groupBy("chrom", "pos", "ref", F.col("alt").alias("_alt")).agg(one.alias("_snv"))
    other = fine.where("alt_index = 0").groupBy("chrom", "pos", "ref").agg(one.alias("_indel"))
    out = loci.withColumns({"_ref": look, "_toggled": _toggled(F.col("chrom"))})
    for i, name in enumerate(("chrom", "_toggled")):
        s = snv.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("ref").alias("_r"), F.col("_alt").alias("_a"), F.col("_snv").alias(f"_snv{i}"))
        o = other.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("ref").alias("_r"), F.col("_indel").alias(f"_indel{i}"))
        at = lambda: (F.col(name) == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.col("_ref") == F.col("_r"))  # noqa: B023, E731
        out = out.join(s, at() & (F.col("alt_allele") == F.col("_a")), "left").drop("_c", "_p", "_r", "_a")
        out = out.join(o, at(), "left").drop("_c", "_p", "_r")
    af = F.when(F.col("variant_type") == "SNV", F.coalesce("_snv0", "_snv1")).otherwise(F.coalesce("_indel0", "_indel1"))
    return out.withColumn("gnomad_af", af.cast("float")).drop("_ref", "_toggled", "_snv0", "_snv1", "_indel0", "_indel1")


def windows(loci: DataFrame, reference: DataFrame, flank: int = 10, chunk: int = 1 << 16) -> DataFrame:
    """``window`` (the reference around a place, clipped at the ends) and ``window_at``, the place in it.

    ``reference`` is (chrom, chunk_start, seq) with chunks of ``chunk`` bases. A
    place meets its own chunk and, near a border, the neighbour's edge, by
    equi-joins; loci of chromosomes that the reference lacks are dropped. ``loci``
    is used twice: distinct rows of what is needed are planned once, since their
    exchange is the same, while a wider plan is pruned differently at each use.
    """
    spots = loci.select("chrom", "pos").distinct()
    at = lambda p: F.floor(F.greatest(p, F.lit(0)) / chunk)
    near = F.transform(F.sequence(at(F.col("pos") - flank), at(F.col("pos") + flank)), lambda k: k * chunk)
    parts = spots.withColumn("chunk_start", F.explode(near)).join(reference, ["chrom", "chunk_start"])
    low = F.greatest(F.col("pos") - flank, F.col("chunk_start"))
    high = F.least(F.col("pos") + flank + 1, F.col("chunk_start") + F.length("seq"))
    parts = parts.withColumns({"low": low, "piece": F.substring("seq", (low - F.col("chunk_start") + 1).cast("int"), (high - low).cast("int"))}).where("piece != ''")
    whole = parts.groupBy("chrom", "pos").agg(F.min("low").alias("low"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda x: x["piece"]), "").alias("window"))
    whole = whole.select("chrom", "pos", F.upper("window").alias("window"), (F.col("pos") - F.col("low")).cast("int").alias("window_at"))
    return loci.join(whole.where("window_at < length(window)"), ["chrom", "pos"])


def context(rows: DataFrame) -> DataFrame:
    """``trinuc_context`` of SNVs from ``window, window_at``: null at the ends of a chromosome."""
    three = F.substring(F.col("window"), F.col("window_at"), F.lit(3))
    inside = (F.col("variant_type") == "SNV") & (F.col("window_at") >= 1) & (F.col("window_at") + 1 < F.length("window"))
    return rows.withColumn("trinuc_context", F.when(inside, three))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Homopolymer and tandem repeat metrics, computed once for each place."""
    spots = rows.select("chrom", "pos", "window", "window_at").distinct()
    found = spots.withColumn("_r", repeats("window", "window_at")).select("chrom", "pos", "_r.*")
    return rows.join(found, ["chrom", "pos"])


def gc_content(loci: DataFrame, reference: DataFrame, width: int = 100) -> DataFrame:
    """``gc_content``: the share of G and C within ``width / 2`` bases of each place, clipped at the ends."""
    spots = windows(loci.select("chrom", "pos").distinct(), reference, width // 2)
    gc = F.length(F.regexp_replace("window", "[^GC]", "")) / F.length("window")
    return loci.join(spots.select("chrom", "pos", gc.cast("float").alias("gc_content")), ["chrom", "pos"], "left")
