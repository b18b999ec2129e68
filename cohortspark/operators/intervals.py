"""Points in intervals, best covering feature, interval merging: range joins as tile equi-joins.

Spark has no interval join: without an equi-key it compares all rows with all
rows. Here an interval is exploded into the tiles it touches and a point has
one tile, so both sides meet on (chrom, tile) in an ordinary shuffled join that
AQE can split, and the range is a residual filter. Tiles should be of the order
of the intervals' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = 1 << 14
#: Which of the features over a place gives its annotation.
PRIORITY = {"CDS": 4, "exon": 3, "UTR": 2, "gene": 0}


def tiles(intervals: DataFrame, size: int = TILE, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each tile that a non-empty interval ``[start, end)`` touches."""
    first = F.floor(F.col(start) / size)
    last = F.floor((F.col(end) - 1) / size)
    return intervals.where(F.col(start) < F.col(end)).withColumn("_tile", F.explode(F.sequence(first, last)))


def join_points(points: DataFrame, intervals: DataFrame, size: int = TILE, how: str = "inner", pos: str = "pos") -> DataFrame:
    """Points with every interval that covers them, on (chrom, tile); ``how`` is inner, left or left_semi.

    ``intervals`` has chrom, start, end and columns whose names do not occur in ``points``.
    """
    i = tiles(intervals, size).withColumnsRenamed({"chrom": "_chrom", "start": "_start", "end": "_end"})
    p = points.withColumn("_at", F.floor(F.col(pos) / size))
    covers = (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_tile")) & (F.col(pos) >= F.col("_start")) & (F.col(pos) < F.col("_end"))
    out = p.join(i, covers, how)
    return out.drop("_at", "_tile", "_chrom") if how != "left_semi" else out.drop("_at")


def merged(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a chromosome made one."""
    before = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("chrom").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    islands = intervals.where("start < end").withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def on_target(points: DataFrame, targets: DataFrame | None, size: int = TILE) -> DataFrame:
    """``on_target``: whether a target covers the place; null where no targets are given."""
    if targets is None:
        return points.withColumn("on_target", F.lit(None).cast("boolean"))
    spots = points.select("chrom", "pos").distinct()
    hit = join_points(spots, targets.select("chrom", "start", "end"), size, "left_semi").withColumn("on_target", F.lit(True))
    return points.join(hit, ["chrom", "pos"], "left").withColumn("on_target", F.coalesce("on_target", F.lit(False)))


def _priority(feature: Column) -> Column:
    kind = F.when(feature.endswith("UTR") | (feature == "UTR"), "UTR").otherwise(feature)
    out = F.lit(-1)
    for name, value in PRIORITY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def bridged(points: DataFrame, known: DataFrame) -> DataFrame:
    """``points`` with ``_name``: their chromosome as ``known`` spells it: as it is, with ``chr``, or without."""
    names = F.broadcast(known.select(F.col("chrom").alias("_name")).distinct())
    spots = points.select("chrom").distinct()
    forms = spots.select("chrom", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("chrom").alias("_name")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("chr"), "chrom").alias("_name")), F.struct(F.lit(2).alias("rank"), F.regexp_replace("chrom", "^chr", "").alias("_name")))).alias("f")).select("chrom", "f.*")
    best = forms.join(names, "_name").groupBy("chrom").agg(F.min_by("_name", "rank").alias("_name"))
    return points.join(F.broadcast(best), "chrom", "left")


def best_feature(points: DataFrame, features: DataFrame, size: int = TILE) -> DataFrame:
    """``gene, feature_type, exon_number`` of the feature of highest priority, then largest start, over each place.

    Only the place's own chromosome spelling is used if it has a feature there, else the bridged ones in turn.
    """
    spots = points.select("chrom", "pos").distinct()
    forms = [(0, F.col("chrom")), (1, F.concat(F.lit("chr"), F.col("chrom"))), (2, F.when(F.col("chrom").startswith("chr"), F.substring("chrom", 4, 1000)))]
    named = None
    for rank, form in forms:
        one = spots.select(F.col("chrom").alias("_spot"), "pos", form.alias("chrom"), F.lit(rank).alias("_rank")).where("chrom is not null")
        named = one if named is None else named.unionByName(one)
    over = join_points(named, features.select("chrom", "start", "end", "gene", "feature", "exon_number"), size)
    order = F.struct((-F.col("_rank")).alias("a"), _priority(F.col("feature")).alias("b"), F.col("_start").alias("c"), F.col("_end").alias("d"), F.col("gene").alias("e"))
    best = over.groupBy(F.col("_spot").alias("chrom"), "pos").agg(F.max_by(F.struct("gene", "feature", "exon_number"), order).alias("best"))
    kind = F.when(F.col("best.feature") != "gene", F.col("best.feature"))
    best = best.select("chrom", "pos", F.col("best.gene").alias("gene"), kind.alias("feature_type"), F.when(kind == "exon", F.col("best.exon_number")).alias("exon_number"))
    return points.join(best, ["chrom", "pos"], "left")


def last_interval(points: DataFrame, intervals: DataFrame, size: int = TILE) -> DataFrame:
    """The interval with the largest start at or before each place, if it covers the place; others are dropped."""
    over = join_points(points, intervals, size)
    own = [c for c in intervals.columns if c != "chrom"]
    keep = F.struct(*[F.col("_start").alias("start") if c == "start" else F.col("_end").alias("end") if c == "end" else F.col(c) for c in own])
    best = over.groupBy(*points.columns).agg(F.max_by(keep, F.struct("_start", "_end")).alias("i"))
    return best.select(*points.columns, "i.*")


def track(points: DataFrame, scores: DataFrame, name: str, size: int = TILE) -> DataFrame:
    """A column with the score of the interval over each place; chromosomes are bridged if not found as they are.

    Of several the one with the largest start counts, then the largest end, then the highest score.
    """
    spots = bridged(points.select("chrom", "pos").distinct(), scores)
    over = join_points(spots.select(F.col("chrom").alias("_spot"), "pos", F.col("_name").alias("chrom")).where("chrom is not null"), scores.select("chrom", "start", "end", "score"), size)
    best = over.groupBy(F.col("_spot").alias("chrom"), "pos").agg(F.max_by("score", F.struct("_start", "_end", "score")).cast("float").alias(name))
    return points.join(best, ["chrom", "pos"], "left")
