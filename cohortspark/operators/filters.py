"""The filter set of the cohort views: a predicate only where it differs from its neutral value."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded, vaf

KEY = ["sample_id", "chrom", "pos", "alt_allele"]
LOCUS = ["chrom", "pos", "ref_allele", "alt_allele"]


@dataclass
class Filters:
    """A conjunction; every field's default leaves all rows."""

    alt_min: int = 1
    alt_max: int = 0
    vaf_range: tuple[float, float] = (0.0, 1.0)
    chrom: str | None = None
    samples: tuple[str, ...] = ()
    batches: tuple[str, ...] = ()
    pipelines: tuple[str, ...] = ()
    label1: tuple[str, ...] = ()
    label2: tuple[str, ...] = ()
    label3: tuple[str, ...] = ()
    variant_types: tuple[str, ...] = ()
    recurrence: tuple[int, int] | None = None
    fwd_alt_min: int = 0
    rev_alt_min: int = 0
    overlap_agree_min: int = 0
    overlap_disagree_min: int = 0
    depth_min: int = 0
    depth_max: int = 0
    called: str | None = None  # "yes", "no" or "unknown"
    variant_filters: tuple[str, ...] = ()
    on_target: bool | None = None
    gnomad_range: tuple[float, float] | None = None
    gnomad_null: bool = True
    gene: str | None = None
    homopolymer: tuple[int, int] | None = None
    str_len: tuple[int, int] | None = None

    def scope(self) -> list[Column]:
        """The predicates that also bound what recurrence counts."""
        out = [F.col(c).isin(*v) for c, v in (("sample_id", self.samples), ("batch", self.batches), ("pipeline", self.pipelines), ("label1", self.label1), ("label2", self.label2), ("label3", self.label3)) if v]
        if self.on_target is not None:
            out.append(F.col("on_target") == F.lit(self.on_target))
        return out

    def predicates(self) -> list[Column]:
        out = self.scope()
        if self.alt_min > 1:
            out.append(F.col("alt_count") >= self.alt_min)
        if self.alt_max > 0:
            out.append(F.col("alt_count") <= self.alt_max)
        if tuple(self.vaf_range) != (0.0, 1.0):
            out.append(vaf().between(*self.vaf_range))
        if self.chrom:
            out.append(F.col("chrom") == self.chrom)
        if self.variant_types:
            out.append(F.col("variant_type").isin(*self.variant_types))
        for c, least in (("fwd_alt_count", self.fwd_alt_min), ("rev_alt_count", self.rev_alt_min), ("overlap_alt_agree", self.overlap_agree_min), ("overlap_alt_disagree", self.overlap_disagree_min), ("total_depth", self.depth_min)):
            if least > 0:
                out.append(F.col(c) >= least)
        if self.depth_max > 0:
            out.append(F.col("total_depth") <= self.depth_max)
        if self.called:
            out.append({"yes": F.col("variant_called") == F.lit(True), "no": F.col("variant_called") == F.lit(False), "unknown": F.col("variant_called").isNull()}[self.called])
        if self.variant_filters:
            out.append(F.col("variant_filter").isin(*self.variant_filters))
        inside = F.col("gnomad_af").cast("double").between(*self.gnomad_range) if self.gnomad_range else None
        if inside is not None:
            out.append(inside | F.col("gnomad_af").isNull() if self.gnomad_null else inside)
        elif not self.gnomad_null:
            out.append(F.col("gnomad_af").isNotNull())
        if self.gene:
            out.append(F.col("gene") == self.gene)
        for c, span in (("homopolymer_len", self.homopolymer), ("str_len", self.str_len)):
            if span:
                out.append(F.col(c).isNull() | F.col(c).between(*span))
        return out

    def apply(self, alt_bases: DataFrame) -> DataFrame:
        out = alt_bases
        for p in self.predicates():
            out = out.where(p)
        if self.recurrence:
            out = out.join(recurrent(alt_bases, *self.recurrence, self.scope()), LOCUS, "left_semi")
        return out

    def save(self) -> str:
        """The fields that differ from their defaults, as JSON of version 1."""
        return json.dumps({"version": 1, "filters": {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}})

    @classmethod
    def load(cls, text: str) -> tuple[Filters, list[str]]:
        """Filters from :meth:`save`'s text, and the names that are not known."""
        held = json.loads(text)
        if held.get("version") != 1:
            raise ValueError("only version 1 can be read")
        known = {f.name for f in fields(cls)}
        given = held.get("filters", {})
        tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
        return cls(**tuples), sorted(set(given) - known)

    def as_dict(self) -> dict:
        return asdict(self)


def recurrent(alt_bases: DataFrame, low: int, high: int, scope: list[Column] = ()) -> DataFrame:
    """Loci seen in ``low`` to ``high`` distinct samples of the rows in scope."""
    rows = alt_bases
    for p in scope:
        rows = rows.where(p)
    return rows.groupBy(*LOCUS).agg(F.count_distinct("sample_id").alias("n_samples")).where(F.col("n_samples").between(low, high)).select(*LOCUS)


@dataclass
class ReadFilters:
    """Per-read predicates; a range that is set drops reads without the value."""

    family_size: tuple[int, int] | None = None
    cycle: tuple[int, int] | None = None
    map_qual: tuple[int, int] | None = None
    insert_size: tuple[int, int] | None = None
    read: str | None = None  # "R1" or "R2"

    def condition(self) -> Column | None:
        parts = [F.col(c).between(*v) for c, v in (("family_size", self.family_size), ("cycle", self.cycle), ("map_qual", self.map_qual), ("insert_size", self.insert_size)) if v]
        if self.read:
            parts.append(F.col("is_read1") == F.lit(self.read == "R1"))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return F.coalesce(out, F.lit(False))

    def apply(self, reads: DataFrame) -> DataFrame:
        passing = self.condition()
        return reads if passing is None else reads.where(passing)


def with_passing_reads(alt_bases: DataFrame, reads: DataFrame, filters: ReadFilters) -> DataFrame:
    """Loci without any read, or with a read that passes."""
    passing = filters.condition()
    if passing is None:
        return alt_bases
    per = reads.groupBy(*KEY).agg(F.bool_or(passing).alias("_passes"))
    return alt_bases.join(per, KEY, "left").where(F.col("_passes").isNull() | F.col("_passes")).drop("_passes")


def recount(alt_bases: DataFrame, reads: DataFrame, filters: ReadFilters) -> DataFrame:
    """``alt_count`` counted anew from passing reads (kept where a locus has no reads), and ``original_vaf``."""
    before = alt_bases.withColumn("original_vaf", rounded(vaf(), 4))
    passing = filters.condition()
    if passing is None:
        return before
    per = reads.groupBy(*KEY).agg(F.count_if(passing).cast("int").alias("_passing"))
    joined = before.join(per, KEY, "left")
    return joined.withColumn("alt_count", F.coalesce("_passing", "alt_count")).drop("_passing")


def listing(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows with vaf, by place, allele and sample; ``limit`` is the page shown."""
    shown = rows.withColumn("vaf", rounded(vaf(), 4))
    return shown.orderBy(*[F.col(c).asc_nulls_last() for c in ("chrom", "pos", "alt_allele", "sample_id")]).limit(limit)


def read_bounds(reads: DataFrame) -> DataFrame:
    """Bounds for per-read filters."""
    return reads.agg(
        F.max("family_size").alias("max_family_size"), F.coalesce(F.max("cycle"), F.lit(300)).alias("max_cycle"),
        F.coalesce(F.max("map_qual"), F.lit(60)).alias("max_map_qual"), (F.count("insert_size") > 0).alias("has_insert_size"),
    )


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def parse_region(text: str, default_span: int = 1_000_000) -> tuple[str, int, int]:
    """``chr:a-b`` or ``chr:a`` (a span from there); commas in numbers are ignored."""
    chrom, _, rest = text.strip().rpartition(":")
    if not chrom:
        raise ValueError(f"not a region: {text!r}")
    first, dash, last = rest.replace(",", "").partition("-")
    start = int(first)
    end = int(last) if dash else start + default_span
    if start < 0 or end < start:
        raise ValueError(f"not a region: {text!r}")
    return chrom, start, end


def overlaps(chrom: str, start: int, end: int) -> Column:
    return (F.col("chrom") == chrom) & (F.col("end") > start) & (F.col("pos") < end)


def coverage_filter(rows: DataFrame, samples=(), chrom=None, gene_like=None, on_target=None, batches=(), genes=(), labels: dict | None = None) -> DataFrame:
    """Filters of the coverage views; ``gene_like`` is a part of the name in any case, ``genes`` a list of names."""
    out = rows
    if samples:
        out = out.where(F.col("sample_id").isin(*samples))
    if chrom:
        out = out.where(F.col("chrom") == chrom)
    if gene_like:
        out = out.where(F.contains(F.lower("gene"), F.lit(gene_like.lower())))
    if genes:
        out = out.where(F.col("gene").isin(*genes))
    if on_target is not None:
        out = out.where(F.col("on_target") == F.lit(on_target))
    if batches:
        out = out.where(F.col("batch").isin(*batches))
    for c, v in (labels or {}).items():
        out = out.where(F.col(c).isin(*v))
    return out
