"""Coverage analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percentile, ratio, rounded

THRESHOLDS = (1, 10, 20, 30, 50, 100)


def _d(c: str):
    return F.col(c).cast("double")


def per_sample(coverage: DataFrame) -> DataFrame:
    inserts = F.avg(F.when(F.col("n_insert_size_obs") > 0, _d("mean_insert_size")))
    fractions = [rounded(F.avg(_d(c)), 3).alias(c) for c in ("frac_dup", "frac_overlap", "frac_mapq0", "frac_low_mapq")]
    return coverage.groupBy("sample_id").agg(
        F.count("*").alias("n_rows"), rounded(F.avg("total_depth"), 1).alias("mean_depth"), rounded(F.median("total_depth"), 1).alias("median_depth"),
        F.min("total_depth").alias("min_depth"), F.max("total_depth").alias("max_depth"), *fractions, rounded(inserts, 1).alias("mean_insert_size"),
    )


def depth_histogram(coverage: DataFrame, cap: int = 500) -> DataFrame:
    """Positions by sample and depth, depths above the cap together; a bin counts as many as it holds."""
    weight = F.sum("bin_n") if "bin_n" in coverage.columns else F.count("*")
    return coverage.groupBy("sample_id", F.least("total_depth", F.lit(cap)).alias("depth")).agg(weight.cast("long").alias("n"))


def breadth(coverage: DataFrame) -> DataFrame:
    """Share of positions at each threshold or above, from the uncapped depth."""
    n = F.col("bin_n") if "bin_n" in coverage.columns else F.lit(1)
    at = [rounded(ratio(F.sum(F.when(F.col("total_depth") >= t, n).otherwise(0)), F.sum(n)), 3).alias(f"frac_{t}x") for t in THRESHOLDS]
    return coverage.groupBy("sample_id").agg(*at)


def gc_bias(coverage: DataFrame) -> DataFrame:
    """Depth by GC in steps of 0.05, over the sample's sum of such depths."""
    at = F.round(_d("gc_content") * 20) / 20
    out = coverage.groupBy("sample_id", at.alias("gc_bin")).agg(rounded(F.avg("total_depth"), 2).alias("mean_depth"), F.count("*").alias("n")).where("n >= 5")
    return out.withColumn("normalised", rounded(ratio(F.col("mean_depth"), F.sum("mean_depth").over(Window.partitionBy("sample_id"))), 6))


def gc_abundance(coverage: DataFrame) -> DataFrame:
    """Mean positions by GC bin over samples, as shares."""
    out = gc_bias(coverage).groupBy("gc_bin").agg(F.avg("n").alias("mean_n"))
    return out.withColumn("abundance", rounded(ratio(F.col("mean_n"), F.sum("mean_n").over(Window.partitionBy())), 6)).withColumn("mean_n", rounded(F.col("mean_n"), 4))


def mapq0_by_gc(coverage: DataFrame) -> DataFrame:
    at = F.round(_d("gc_content") * 20) / 20
    return coverage.groupBy("sample_id", at.alias("gc_bin")).agg(rounded(F.avg(_d("frac_mapq0")), 4).alias("mean_mapq0"), F.count("*").alias("n")).where("n >= 5")


def undercovered(coverage: DataFrame, depth: int, fraction: float, n_selected: int, limit: int = 1000) -> DataFrame:
    """Positions below ``depth`` in many samples, the worst ``limit`` of them."""
    least = max(1, int(fraction * n_selected))
    out = coverage.where(F.col("total_depth") < depth).groupBy("chrom", "pos", "gene").agg(
        F.count_distinct("sample_id").alias("n_samples_below"), rounded(F.avg("total_depth"), 1).alias("mean_depth"), F.min("total_depth").alias("min_depth"),
        rounded(F.avg(_d("frac_mapq0")), 3).alias("mean_mapq0"), rounded(F.avg(_d("gc_content")), 3).alias("mean_gc"), F.max("bin_n").alias("bin_n"),
    )
    return out.where(F.col("n_samples_below") >= least).orderBy(F.desc("n_samples_below"), "mean_depth", "chrom", "pos", F.col("gene").asc_nulls_last()).limit(limit)


def by_gene(coverage: DataFrame, depth: int = 20) -> DataFrame:
    rows = coverage.where("gene is not null and gene != ''")
    below = F.count_if(F.col("total_depth") < depth)
    return rows.groupBy("gene").agg(
        F.count_distinct("chrom", "pos").alias("n_positions"), rounded(F.avg("total_depth"), 1).alias("mean_depth"), F.min("total_depth").alias("min_depth"),
        rounded(F.avg(_d("mean_mapq")), 1).alias("mean_mapq"), rounded(F.avg(_d("gc_content")), 3).alias("mean_gc"), below.alias("n_below"),
        rounded(ratio(below * 100, F.count("*")), 1).alias("pct_below"),
    ).orderBy("mean_depth", "gene")


def expanded(coverage: DataFrame, step: int = 1) -> DataFrame:
    """A row for each base of each bin; ``pos_bin`` groups them by ``step``."""
    rows = coverage.where(F.col("pos") < F.col("end")).withColumn("p", F.explode(F.sequence(F.col("pos"), F.col("end") - 1)))
    return rows.withColumn("pos_bin", (F.floor(F.col("p") / step) * step).cast("long") if step > 1 else F.col("p"))


def sample_profile(coverage: DataFrame, step: int = 1) -> DataFrame:
    means = [F.avg(_d(c)).alias(c) for c in ("total_depth", "mean_mapq", "frac_mapq0", "frac_low_mapq", "gc_content") if c in coverage.columns]
    return expanded(coverage, step).groupBy("pos_bin", "sample_id").agg(*means)


def profile(coverage: DataFrame, step: int = 1) -> DataFrame:
    """Depth along a region: mean, extremes and quartiles over samples."""
    own = sample_profile(coverage, step)
    rest = [rounded(F.avg(c), 4).alias(c) for c in ("mean_mapq", "frac_mapq0", "frac_low_mapq", "gc_content") if c in own.columns]
    return own.groupBy("pos_bin").agg(
        rounded(F.avg("total_depth"), 4).alias("mean_depth"), rounded(F.min("total_depth"), 4).alias("min_depth"), rounded(F.max("total_depth"), 4).alias("max_depth"),
        rounded(percentile("total_depth", 0.25), 4).alias("p25_depth"), rounded(percentile("total_depth", 0.5), 4).alias("p50_depth"), rounded(percentile("total_depth", 0.75), 4).alias("p75_depth"),
        *rest, F.count("*").alias("n_samples"),
    )


def display_step(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.coalesce(F.max(F.col("end") - F.col("pos")), F.lit(1)).alias("max_bin_width"))


def expanded_positions(coverage: DataFrame) -> DataFrame:
    """How many positions an expansion would show; a view stays below 50,000."""
    return expanded(coverage).agg(F.count_distinct("chrom", "p").alias("n_positions"))


def weighted_depth(coverage: DataFrame) -> DataFrame:
    w = F.col("end") - F.col("pos")
    return coverage.groupBy("sample_id").agg(rounded(ratio(F.sum(F.col("total_depth") * w), F.sum(w)), 2).alias("weighted_depth"), rounded(F.avg("total_depth"), 2).alias("plain_depth"))


def bin_widths(coverage: DataFrame, top: int = 10) -> DataFrame:
    return coverage.groupBy((F.col("end") - F.col("pos")).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(top)


def interval_depths(intervals: DataFrame, coverage: DataFrame, gene: str) -> DataFrame:
    """Depth of a gene's intervals from its covered positions; sides meet on the gene, then by range.

    Neither sample nor chromosome is part of the join, as in the views this serves.
    """
    i = intervals.where(F.col("gene") == gene).select("gene", "interval_name", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    c = coverage.where(F.col("gene") == gene).select("gene", F.col("pos").alias("p"), "sample_id", "total_depth")
    rows = i.join(c, "gene").where("p >= s and p < e")
    return rows.groupBy("interval_name", "s", "e").agg(F.count("*").alias("n"), rounded(F.avg("total_depth"), 2).alias("mean_depth"), F.min("total_depth").alias("min_depth"), F.max("total_depth").alias("max_depth")).withColumnsRenamed({"s": "start", "e": "end"})


def region_stats(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("sample_id").agg(
        F.count_distinct("chrom", "pos").alias("n_positions"), rounded(F.avg("total_depth"), 1).alias("mean_depth"), F.min("total_depth").alias("min_depth"), F.max("total_depth").alias("max_depth"),
        rounded(percentile("total_depth", 0.25), 2).alias("p25"), rounded(percentile("total_depth", 0.75), 2).alias("p75"),
    )


def undercovered_intervals(intervals: DataFrame, depth: float, least: int = 1, limit: int = 500) -> DataFrame:
    out = intervals.where(_d("mean_depth") < depth).groupBy("chrom", "start", "end", "interval_name", "gene")
    out = out.agg(F.count_distinct("sample_id").alias("n_samples"), rounded(F.avg(_d("mean_depth")), 2).alias("mean_depth"), rounded(F.avg(_d("mean_mapq")), 2).alias("mean_mapq"))
    keys = [F.col(c).asc_nulls_last() for c in ("chrom", "start", "end", "interval_name", "gene")]
    return out.where(F.col("n_samples") >= least).orderBy(F.desc("n_samples"), "mean_depth", *keys).limit(limit)


def interval_gc(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("interval_name", "gene").agg(
        rounded(F.avg(_d("mean_gc_content")), 3).alias("gc"), rounded(F.avg(_d("mean_depth")), 2).alias("mean_depth"),
        rounded(F.avg(_d("mean_frac_mapq0")), 4).alias("mapq0"), F.count_distinct("sample_id").alias("n_samples"),
    )


def exon_heatmap(intervals: DataFrame, worst: int = 30) -> DataFrame:
    """Share at 30x by interval, for genes of two intervals or more; the ``worst`` genes by their least interval."""
    cells = intervals.where("gene is not null").groupBy("gene", "interval_name").agg(rounded(F.avg(_d("frac_at_30x")), 3).alias("frac_at_30x"))
    genes = cells.groupBy("gene").agg(F.count("*").alias("n"), F.min("frac_at_30x").alias("least")).where("n >= 2").orderBy("least", "gene").limit(worst)
    return cells.join(F.broadcast(genes.select("gene")), "gene")
