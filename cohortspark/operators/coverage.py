"""Coverage by position, bin and named interval from exploded bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio
from .filters import parse_region
from .intervals import join_points, last_interval
from .pileup import DUPLICATE, LOCUS, PAIRED, PROPER, READ1, REVERSE, SECONDARY, SUPPLEMENTARY, bases, by_fragment

INTEGER = ["total_depth", "fwd_depth", "rev_depth", "raw_read_depth", "overlap_depth"]
FRACTION = ["frac_dup", "frac_overlap", "mean_mapq", "frac_mapq0", "frac_low_mapq", "mean_base_qual", "frac_low_bq", "gc_content"]
THRESHOLDS = (1, 10, 20, 30, 50, 100)


def _part(a: Column, b: Column) -> Column:
    """a / b as a float, 0 where b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0)).cast("float")


def tally(reads: DataFrame, min_mapq: int = 0, min_base_qual: int = 20, low_mapq: int = 20, targets: DataFrame | None = None) -> DataFrame:
    """A row for each covered position.

    ``reads`` are taken whole; secondary and supplementary ones are dropped,
    duplicates and low mapping qualities are counted, then dropped. With
    ``targets`` other positions are dropped before anything is counted.
    """
    rows = bases(by_fragment(reads.where(F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0))).where(F.col("kind").isin("M", "D", "N"))
    if targets is not None:
        rows = join_points(rows, targets.select("chrom", "start", "end"), how="left_semi")
    dup = F.col("flag").bitwiseAND(DUPLICATE) != 0
    own = ~dup & (F.col("mapq") >= min_mapq) & (F.col("kind") == "M")
    proper = own & (F.col("flag").bitwiseAND(PAIRED | PROPER | READ1) == PAIRED | PROPER | READ1) & (F.col("tlen") != 0)
    size, low = F.abs("tlen"), F.col("qual") < min_base_qual
    forward, first = F.col("flag").bitwiseAND(REVERSE) == 0, F.col("flag").bitwiseAND(READ1) != 0
    when = lambda c, x: F.when(c, x)
    # numbers alone, which a hash aggregation can hold
    fragment = rows.groupBy(*LOCUS, "qname").agg(
        F.count("*").alias("raw"), F.count_if(dup).alias("dups"), F.count_if(~dup).alias("live"), F.sum(when(~dup, F.col("mapq"))).alias("mapq_sum"), F.count_if(~dup & (F.col("mapq") == 0)).alias("mapq0"),
        F.count_if(~dup & (F.col("mapq") < low_mapq)).alias("mapq_low"), F.count_if(own).alias("n"), F.sum(when(own, F.col("qual"))).alias("bq_sum"), F.count_if(own & low).alias("bq_low"), F.min(when(own, F.col("qual"))).alias("bq_min"),
        F.max(when(own, F.col("qual"))).alias("bq_max"), F.sum(when(proper, size)).alias("is_sum"), F.min(when(proper, size)).alias("is_min"), F.max(when(proper, size)).alias("is_max"), F.count_if(proper).alias("is_n"),
        F.min(when(own & forward, F.col("ordinal"))).alias("fwd"), F.min(when(own & ~forward, F.col("ordinal"))).alias("rev"), F.min(when(own & first & forward, F.col("ordinal"))).alias("fwd1"), F.min(when(own & first & ~forward, F.col("ordinal"))).alias("rev1"),
    )
    # the earliest read's strand, of two reads the first one's; of one ordinal the forward read counts as the earlier
    ahead = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) <= F.col(b)))
    fwd = F.when((F.col("n") == 2) & F.coalesce("fwd1", "rev1").isNotNull(), ahead("fwd1", "rev1")).otherwise(ahead("fwd", "rev"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    depth, over = F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 2)
    live, n = F.sum("live"), F.sum("n")
    return fragment.groupBy(*LOCUS).agg(
        depth.cast("int").alias("total_depth"), F.count_if((F.col("n") > 0) & fwd).cast("int").alias("fwd_depth"), F.count_if((F.col("n") > 0) & ~fwd).cast("int").alias("rev_depth"), F.sum("raw").cast("int").alias("raw_read_depth"),
        _part(F.sum("dups"), F.sum("raw")).alias("frac_dup"), over.cast("int").alias("overlap_depth"), _part(over, depth).alias("frac_overlap"), _part(zero("mapq_sum"), live).alias("mean_mapq"), _part(F.sum("mapq0"), live).alias("frac_mapq0"),
        _part(F.sum("mapq_low"), live).alias("frac_low_mapq"), _part(zero("bq_sum"), n).alias("mean_base_qual"), F.coalesce(F.min("bq_min"), F.lit(0)).cast("int").alias("min_base_qual_obs"), F.coalesce(F.max("bq_max"), F.lit(0)).cast("int").alias("max_base_qual_obs"),
        _part(F.sum("bq_low"), n).alias("frac_low_bq"), _part(zero("is_sum"), F.sum("is_n")).alias("mean_insert_size"), F.coalesce(F.min("is_min"), F.lit(0)).cast("int").alias("min_insert_size"),
        F.coalesce(F.max("is_max"), F.lit(0)).cast("int").alias("max_insert_size"), F.sum("is_n").cast("int").alias("n_insert_size_obs"),
    )


def zero_filled(covered: DataFrame, places: DataFrame) -> DataFrame:
    """Zero rows for the ``places(sample_id, chrom, pos)`` that are not covered."""
    missing = places.join(covered.select(*LOCUS), LOCUS, "left_anti")
    rest = [c for c in covered.schema if c.name not in LOCUS]
    return missing.select(*LOCUS, *[F.lit(0 if c.dataType.typeName() in ("integer", "long", "float", "double") else None).cast(c.dataType).alias(c.name) for c in rest])


def target_places(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Every position of the targets, for every sample."""
    spots = targets.where("start < end").select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).distinct()
    return spots.crossJoin(F.broadcast(samples.select("sample_id").distinct())).select(*LOCUS)


def contig_places(samples: DataFrame, contigs: DataFrame, region: str | None = None) -> DataFrame:
    """Every position of ``contigs(chrom, length)``, or of the part a region names."""
    spans = contigs.select("chrom", F.lit(0).cast("long").alias("a"), F.col("length").cast("long").alias("b"))
    if region and ":" in region:
        chrom, start, end = parse_region(region, default_span=1 << 40)
        spans = spans.where(F.col("chrom") == chrom).select("chrom", F.greatest("a", F.lit(max(0, start - 1))).alias("a"), F.least("b", F.lit(end)).alias("b"))
    elif region:
        spans = spans.where(F.col("chrom") == region)
    step = 1 << 20  # pieces of a contig, so that no row explodes into all of it
    pieces = spans.where("a < b").select("chrom", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / step), F.floor((F.col("b") - 1) / step))).alias("k"))
    low, high = F.greatest("a", F.col("k") * step), F.least("b", (F.col("k") + 1) * step)
    return pieces.select("chrom", F.explode(F.sequence(low, high - 1)).alias("pos")).crossJoin(F.broadcast(samples.select("sample_id").distinct())).select(*LOCUS)


def floor(rows: DataFrame, min_depth: int) -> DataFrame:
    return rows.where(F.col("total_depth") >= min_depth)


def binned(rows: DataFrame, size: int, adaptive: int | None = None, tracks: tuple[str, ...] = (), strict_spans: bool = False) -> DataFrame:
    """Bins of ``size`` bases; with ``adaptive``, positions of lower depth stand alone and break their bin.

    ``end`` is the bin's left edge plus the positions it holds, also for a bin
    resumed after a break (``strict_spans`` gives first and last position
    instead). Segments never cross a fixed bin, so windows are by bin, not by
    chromosome.
    """
    keyed = rows.withColumn("_bin", (F.floor(F.col("pos") / size) * size).cast("long"))
    low = F.col("total_depth") < adaptive if adaptive is not None else F.lit(False)
    keyed = keyed.withColumn("_low", low)
    place = Window.partitionBy("sample_id", "chrom", "_bin").orderBy("pos")
    keyed = keyed.withColumn("_seg", F.sum(F.col("_low").cast("int")).over(place) if adaptive is not None else F.lit(0))
    own = [c for c in rows.columns if c in INTEGER]
    means = [F.round(F.avg(c)).cast("int").alias(c) for c in own] + [F.avg(c).cast("float").alias(c) for c in rows.columns if c in FRACTION or c in tracks]
    extremes = [f(f"{c}").alias(c) for c, f in (("min_base_qual_obs", F.min), ("max_base_qual_obs", F.max), ("min_insert_size", F.min), ("max_insert_size", F.max)) if c in rows.columns]
    depth = [F.min("total_depth").alias("min_depth"), F.max("total_depth").alias("max_depth")]
    insert = []
    if "n_insert_size_obs" in rows.columns:
        insert = [F.coalesce(F.avg(F.when(F.col("n_insert_size_obs") > 0, F.col("mean_insert_size"))), F.lit(0.0)).cast("float").alias("mean_insert_size"), F.sum("n_insert_size_obs").cast("int").alias("n_insert_size_obs")]
    labels = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("gene", "feature_type", "exon_number") if c in rows.columns]
    target = [F.bool_or("on_target").alias("on_target")] if "on_target" in rows.columns else []
    out = keyed.groupBy("sample_id", "chrom", "_bin", "_seg", "_low").agg(F.count("*").cast("int").alias("bin_n"), F.min("pos").alias("_first"), F.max("pos").alias("_last"), *depth, *means, *extremes, *insert, *labels, *target)
    pos = F.when(F.col("_low"), F.col("_first")).otherwise(F.col("_first") if strict_spans else F.col("_bin"))
    out = out.withColumn("pos", pos)
    end = F.col("_last") + 1 if strict_spans else F.col("pos") + F.col("bin_n")
    return out.withColumn("end", end).drop("_bin", "_seg", "_low", "_first", "_last")


def interval_summary(rows: DataFrame, samples: DataFrame, intervals: DataFrame | None) -> DataFrame:
    """Depth statistics of named, unmerged intervals over all their positions, uncovered ones as zero.

    Without intervals there is nothing to summarise by, which is an error. A covered position counts for the last interval that starts at or before it.
    """
    if intervals is None:
        raise ValueError("a summary by interval needs target intervals")
    named = intervals.select("chrom", "start", "end", "interval_name")
    spots = rows.select("chrom", "pos").distinct()
    own = last_interval(spots, named.withColumnRenamed("interval_name", "name"))
    over = rows.join(own, ["chrom", "pos"]).withColumnRenamed("name", "interval_name")
    zero = zero_filled(rows, target_places(samples, named))
    spread = named.where("start < end").withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    empty = zero.join(spread, ["chrom", "pos"]).select(*over.columns)
    every = over.unionByName(empty)
    d = F.col("total_depth")
    at = [F.avg(F.when(d >= t, 1.0).otherwise(0.0)).cast("float").alias(f"frac_at_{t}x") for t in THRESHOLDS]
    mean = lambda c, name: F.avg(c).cast("float").alias(name)
    extra = [mean(c, n) for c, n in (("gc_content", "mean_gc_content"), ("mean_mapq", "mean_mapq"), ("frac_mapq0", "mean_frac_mapq0"), ("frac_dup", "mean_frac_dup"), ("frac_overlap", "mean_frac_overlap"), ("mean_base_qual", "mean_base_qual")) if c in rows.columns]
    insert = F.coalesce(F.avg(F.when(F.col("n_insert_size_obs") > 0, F.col("mean_insert_size"))), F.lit(0.0)).cast("float").alias("mean_insert_size")
    return every.groupBy("sample_id", "chrom", "start", "end", "interval_name").agg(
        F.count("*").cast("int").alias("n_bases"), mean("total_depth", "mean_depth"), F.median("total_depth").cast("float").alias("median_depth"), F.min("total_depth").alias("min_depth"), F.max("total_depth").alias("max_depth"), *at, *extra, insert,
    )


def contigs_of(reference: DataFrame) -> DataFrame:
    """``chrom, length`` of a chunked reference."""
    return reference.groupBy("chrom").agg(F.max(F.col("chunk_start") + F.length("seq")).alias("length"))


def cover(spark: SparkSession, reads: DataFrame, targets: DataFrame | None = None, min_depth: int = 0, fill_zeros: bool = False, contigs: DataFrame | None = None, region: str | None = None, bin_size: int | None = None, adaptive: int | None = None, **how) -> DataFrame:
    """Covered positions and the zero rows asked for, in bins if wanted; zero rows have bins of their own."""
    rows = tally(reads, targets=targets, **how)
    kept = floor(rows, min_depth)
    zero = None
    if min_depth == 0 and targets is not None:
        zero = zero_filled(rows, target_places(reads, targets))
    elif min_depth == 0 and fill_zeros and contigs is not None:
        zero = zero_filled(rows, contig_places(reads, contigs, region))
    if bin_size:
        kept = binned(kept, bin_size, adaptive)
        zero = binned(zero, bin_size, adaptive) if zero is not None else None
    return kept.unionByName(zero) if zero is not None else kept
