"""Pileup: aligned reads to counts by place and allele, as staged aggregates.

Reads are filtered before anything is exploded, and a CIGAR is walked by expressions.
Only reads are shuffled, by name; their bases are counted where they are, as numbers,
and what is shuffled by place are these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import compatible, n_runs

# Flag bits of the alignment format.
PAIRED, PROPER, REVERSE, READ1, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x1, 0x2, 0x10, 0x40, 0x100, 0x400, 0x800
LOCUS = ["sample_id", "chrom", "pos"]


def usable(reads: DataFrame, min_mapq: int = 0, duplicates: bool = False, secondary: bool = False, supplementary: bool = False) -> DataFrame:
    drop = 0 if duplicates else DUPLICATE
    drop |= (0 if secondary else SECONDARY) | (0 if supplementary else SUPPLEMENTARY)
    return reads.where((F.col("flag").bitwiseAND(drop) == 0) & (F.col("mapq") >= min_mapq))


def _walk(cigar: Column) -> Column:
    """The blocks of a CIGAR as ``(kind, ref, at, size, rows)``: ``ref`` from the read's start, ``at`` in the read.

    Kinds: M bases; D deleted and N skipped bases; and, at the anchor base
    before them, I an insertion of ``size`` bases and d a deletion of as many.
    """
    block = lambda kind, ref, at, size, rows: F.struct(F.lit(kind).alias("kind"), ref.cast("long").alias("ref"), at.cast("int").alias("at"), size.alias("size"), rows.alias("rows"))
    number = lambda x: F.left(x, F.length(x) - 1).cast("int")
    none = F.array().cast("array<struct<kind:string,ref:bigint,at:int,size:int,rows:int>>")

    def step(s: Column, x: Column) -> Column:
        size, op, ref, at = number(x), F.right(x, F.lit(1)), s["ref"], s["at"]
        base, gap = op.isin("M", "=", "X"), op.isin("D", "N")
        own = (
            F.when(size == 0, none).when(base, F.array(block("M", ref, at, size, size))).when((op == "I") & s["anchored"], F.array(block("I", ref - 1, at, size, F.lit(1))))
            .when((op == "D") & s["anchored"], F.array(block("d", ref - 1, at - 1, size, F.lit(1)), block("D", ref, at, size, size)))
            .when(op == "D", F.array(block("D", ref, at, size, size))).when(op == "N", F.array(block("N", ref, at, size, size))).otherwise(none)
        )
        ahead = F.when(base | gap, size).otherwise(0)
        read = F.when(base | op.isin("I", "S"), size).otherwise(0)
        return F.struct((ref + ahead).cast("long").alias("ref"), (at + read).cast("int").alias("at"), (s["anchored"] | base).alias("anchored"), F.concat(s["out"], own).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("ref"), F.lit(0).alias("at"), F.lit(False).alias("anchored"), none.alias("out"))
    each = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), start, step, lambda s: s["out"])
    # most reads are one block
    return F.when(cigar.rlike("^[0-9]*[1-9][0-9]*[M=X]$"), F.array(block("M", F.lit(0), F.lit(0), number(cigar), number(cigar)))).otherwise(each)


def by_fragment(reads: DataFrame, partitions: int | None = None) -> DataFrame:
    """Reads of a name together: an aggregation by place and name of their bases needs no other exchange.

    Their number of partitions is fixed (``spark.sql.shuffle.partitions``), since AQE sizes
    them by the reads' bytes, which the bases exceed many times.
    """
    return reads.repartition(partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "qname")


def bases(reads: DataFrame) -> DataFrame:
    """A row for each aligned base or event, in the reads' partitions; ``seq`` is the whole read.

    ``file_row``, the reads' order in their files, is kept where they have it.
    """
    more = [c for c in ("file_row",) if c in reads.columns]
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    hard = F.when(reverse, F.regexp_extract("cigar", r"[MIDNSHP=X](\d+)H$", 1)).otherwise(F.regexp_extract("cigar", r"^(\d+)H", 1))
    tag = lambda k: F.try_element_at("tags", F.lit(k)).cast("int")
    blocks = reads.select(
        "sample_id", "chrom", "qname", F.col("read_ordinal").alias("ordinal"), "flag", "mapq", "tlen", F.col("pos").alias("start"), F.upper("seq").alias("seq"), "quals", "cigar", "tags", *more, F.explode(_walk(F.col("cigar"))).alias("b"),
    )
    rows = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b.rows") - 1)))
    kind = F.col("b.kind")
    at = F.col("b.at") + F.when(kind == "M", F.col("i")).otherwise(0)
    missing = F.raise_error(F.concat(F.lit("read "), "qname", F.lit(" has fewer bases than its CIGAR")))
    base = F.when(kind == "I", F.substring("seq", at + 1, F.col("b.size"))).when(kind != "M", "").when(at < F.length("seq"), F.substring("seq", at + 1, F.lit(1))).otherwise(missing)
    size = F.when(kind.isin("I", "d"), F.col("b.size")).otherwise(1)
    return rows.select(
        "sample_id", "chrom", (F.col("start") + F.col("b.ref") + F.col("i")).alias("pos"), "qname", "ordinal", kind.alias("kind"), base.alias("base"), size.alias("size"), F.when(kind == "M", F.get("quals", at)).alias("qual"), at.alias("at"), "flag", "mapq", "tlen",
        "seq", F.coalesce(F.when(hard != "", hard).cast("int"), F.lit(0)).alias("hard5"), tag("aD").alias("ab"), tag("bD").alias("ba"), tag("cD").alias("cd"), *more,
    )


def _plain(reads: DataFrame, min_base_qual: int) -> DataFrame:
    return bases(reads).where((F.col("kind") == "M") & (F.coalesce("qual", F.lit(0)) >= min_base_qual))


def in_region(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Reads that overlap ``[start, end)``; their bases beyond it are kept."""
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return reads.where((F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("pos") + span > start))


def _fragments(rows: DataFrame, allele: Column) -> DataFrame:
    """One row for each fragment and place: its reads in order, as (allele, is_first, forward, ordinal)."""
    read = F.struct("ordinal", allele.alias("allele"), (F.col("flag").bitwiseAND(READ1) != 0).alias("first"), (F.col("flag").bitwiseAND(REVERSE) == 0).alias("fwd"))
    return rows.groupBy(*LOCUS, "qname").agg(F.array_sort(F.collect_list(read)).alias("reads"))


_ENTRY = "struct<allele:string,n:int,fwd:int,rev:int,agree:int,disagree:int>"


def _entry(allele: Column, fwd: Column, rev: Column, agree: int, disagree: int) -> Column:
    return F.struct(allele.alias("allele"), F.lit(1).alias("n"), fwd.cast("int").alias("fwd"), rev.cast("int").alias("rev"), F.lit(agree).alias("agree"), F.lit(disagree).alias("disagree"))


def _single(x: Column) -> Column:
    return _entry(x["allele"], x["fwd"], ~x["fwd"], 0, 0)


def _snv_tally(ref: Column) -> Column:
    """What a fragment adds: a base on both reads counts once and on both strands; of a reference base
    and another only the other counts; two others count once each; N counts nothing."""
    r, a, b = F.col("reads"), F.get("reads", F.lit(0)), F.get("reads", F.lit(1))
    x, y, none = a["allele"], b["allele"], F.array().cast(f"array<{_ENTRY}>")
    one = lambda e: F.array(e).cast(f"array<{_ENTRY}>")
    lone = lambda e, d: _entry(e["allele"], e["fwd"], ~e["fwd"], 0, d)
    pair = (
        F.when((x == "N") & (y == "N"), none).when(x == "N", one(_single(b))).when(y == "N", one(_single(a)))
        .when(x == y, one(_entry(x, F.lit(1), F.lit(1), 1, 0))).when(x == ref, one(lone(b, 1))).when(y == ref, one(lone(a, 1)))
        .otherwise(F.array(lone(a, 1), lone(b, 1)).cast(f"array<{_ENTRY}>"))
    )
    each = F.transform(F.filter(r, lambda e: e["allele"] != "N"), _single).cast(f"array<{_ENTRY}>")
    return F.when(F.size(r) == 2, pair).otherwise(each)


def fragment_depth(fragments: DataFrame) -> DataFrame:
    """Depths by place from fragments: a pair is one, on the strand of its first read; lone Ns are none."""
    r = F.col("reads")
    pair = F.size(r) == 2
    known = F.size(F.filter(r, lambda e: e["allele"] != "N"))
    lead = F.when(F.get(r, F.lit(0))["first"], F.get(r, F.lit(0))["fwd"]).otherwise(F.get(r, F.lit(1))["fwd"])
    depth = F.when(pair, 1).otherwise(known)
    fwd = F.when(pair, lead.cast("int")).otherwise(F.size(F.filter(r, lambda e: (e["allele"] != "N") & e["fwd"])))
    return fragments.select(*LOCUS, depth.alias("d"), fwd.alias("f"), pair.cast("int").alias("o")).groupBy(*LOCUS).agg(
        F.sum("d").cast("int").alias("total_depth"), F.sum("f").cast("int").alias("fwd_depth"), (F.sum("d") - F.sum("f")).cast("int").alias("rev_depth"), F.sum("o").cast("int").alias("overlap_depth"),
    )


def _with_reference(rows: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """``ref``: the reference base of each place; places without one are dropped."""
    at = rows.withColumn("chunk_start", F.floor(F.col("pos") / chunk) * chunk)
    out = at.join(reference, ["chrom", "chunk_start"])
    base = F.upper(F.substring(F.col("seq"), (F.col("pos") - F.col("chunk_start") + 1).cast("int"), F.lit(1)))
    return out.withColumn("ref", base).drop("seq", "chunk_start").where("ref != '' and ref != 'N'")


def _code(base: Column) -> Column:
    """A read's allele, whether it is the first of its pair, and whether it is forward, in a number that orders like them."""
    return F.ascii(base) * 4 + (F.col("flag").bitwiseAND(READ1) != 0).cast("int") * 2 + (F.col("flag").bitwiseAND(REVERSE) == 0).cast("int")


def _pairs(plain: DataFrame) -> DataFrame:
    """``lo, hi, early, n``: by place, how many fragments of two reads have these codes; ``early`` is the earlier read's."""
    own = plain.select(*LOCUS, "qname", "ordinal", _code(F.col("base")).alias("code")).groupBy(*LOCUS, "qname").agg(
        F.count("*").alias("reads"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min_by("code", "ordinal").alias("early"),
    )
    early = F.when(F.col("first") == F.col("last"), F.col("lo")).otherwise(F.col("early"))
    return own.where("reads = 2").groupBy(*LOCUS, "lo", "hi", early.alias("early")).agg(F.count("*").alias("n"))


def _read(code: Column) -> Column:
    """The read that a code stands for, as in fragments."""
    return F.struct(F.char(F.floor(code / 4)).alias("allele"), (code.bitwiseAND(2) != 0).alias("first"), (code.bitwiseAND(1) != 0).alias("fwd"))


def _loci(reads: DataFrame, reference: DataFrame, min_base_qual: int, chunk: int) -> DataFrame:
    """A row for each place of a known reference base: ``ref``, depths, its counts, and ``others``, those of other alleles.

    Reads of a fragment count singly unless it has two. So all reads are counted by
    allele and strand, without regard to fragments; fragments of two are counted by what
    their reads show; and at each place the latter's reads are taken off the former and what
    a pair adds is put in. This is in whole numbers, thus exact, and keeps no list of reads.
    """
    single = _plain(reads, min_base_qual).groupBy(*LOCUS, _code(F.col("base")).alias("lo")).agg(F.count("*").alias("n"))
    no = F.lit(None).cast("int")
    seen = single.select(*LOCUS, "lo", no.alias("hi"), no.alias("early"), "n").unionByName(_pairs(_plain(by_fragment(reads), min_base_qual)))
    seen = seen.withColumns({"a": _read(F.col("lo")), "b": _read(F.col("hi")), "pair": F.col("hi").isNotNull()})
    known = lambda r: (F.col(r)["allele"] != "N").cast("int")
    forward = lambda r: F.col(r)["fwd"].cast("int")
    # the strand of a pair is that of its first read: the earlier one if it is, else the other
    later = F.col("lo") + F.col("hi") - F.col("early")
    lead = F.when(F.col("early").bitwiseAND(2) != 0, F.col("early")).otherwise(later).bitwiseAND(1)
    depth = F.when(F.col("pair"), 1 - known("a") - known("b")).otherwise(known("a"))
    fwd = F.when(F.col("pair"), lead - known("a") * forward("a") - known("b") * forward("b")).otherwise(known("a") * forward("a"))
    at = seen.groupBy(*LOCUS).agg(
        F.sum(depth * F.col("n")).cast("int").alias("total_depth"), F.sum(fwd * F.col("n")).cast("int").alias("fwd_depth"), F.sum(F.when(F.col("pair"), F.col("n")).otherwise(0)).cast("int").alias("overlap_depth"),
        F.collect_list(F.struct("a", "b", "pair", "n")).alias("seen"),
    )
    at = _with_reference(at.where("total_depth > 0"), reference, chunk)
    keys = [*LOCUS, "ref", "total_depth", "fwd_depth", "overlap_depth"]
    entries = at.select(*keys, F.explode("seen").alias("s")).select(*keys, "s.*").withColumn("reads", F.when(F.col("pair"), F.array("a", "b")).otherwise(F.array("a")))
    alone = F.transform(F.filter("reads", lambda e: e["allele"] != "N"), _single).cast(f"array<{_ENTRY}>")
    weigh = lambda x, sign: F.transform(x, lambda e: F.struct(e.alias("e"), (sign * F.col("n")).alias("w")))
    added = F.when(F.col("pair"), F.concat(weigh(_snv_tally(F.col("ref")), F.lit(1)), weigh(alone, F.lit(-1)))).otherwise(weigh(alone, F.lit(1)))
    tally = entries.select(*keys, F.explode(added).alias("t")).select(*keys, "t.e.*", "t.w").withColumnRenamed("n", "one")
    counts = tally.groupBy(*keys, "allele").agg(*[F.sum(F.col(c) * F.col("w")).cast("int").alias(name) for c, name in (("one", "n"), ("fwd", "fwd"), ("rev", "rev"), ("agree", "agree"), ("disagree", "disagree"))])
    every = counts.where("n > 0").groupBy(*keys).agg(F.collect_list(F.struct("allele", "n", "fwd", "rev", "agree", "disagree")).alias("counts"))
    own = F.get(F.filter("counts", lambda c: c["allele"] == F.col("ref")), F.lit(0))
    refs = [F.coalesce(own[c], F.lit(0)).alias(name) for c, name in (("n", "ref_count"), ("fwd", "fwd_ref_count"), ("rev", "rev_ref_count"), ("agree", "overlap_ref_agree"))]
    return every.select(*keys, (F.col("total_depth") - F.col("fwd_depth")).alias("rev_depth"), *refs, F.filter("counts", lambda c: c["allele"] != F.col("ref")).alias("others"))


def alt_bases(reads: DataFrame, reference: DataFrame, min_mapq: int = 0, min_base_qual: int = 0, chunk: int = 1 << 16, **include) -> DataFrame:
    """A row for each place and allele other than the reference: depths, counts by strand, pair agreement."""
    own = usable(reads, min_mapq, **include)
    loci = _loci(own, reference, min_base_qual, chunk)
    whole = [c for c in loci.columns if c != "others"]
    snv = loci.select(*whole, F.explode("others").alias("c")).select(*whole, "c.*").withColumn("variant_type", F.lit("SNV"))
    indel = loci.select(*whole).join(_indel_counts(own, reference, chunk), LOCUS).where("allele != ref and allele != 'N'")
    return snv.unionByName(indel).select(
        *LOCUS, F.col("ref").alias("ref_allele"), F.col("allele").alias("alt_allele"), "variant_type", "total_depth", F.col("n").alias("alt_count"), "ref_count", "fwd_depth", "rev_depth",
        F.col("fwd").alias("fwd_alt_count"), F.col("rev").alias("rev_alt_count"), "fwd_ref_count", "rev_ref_count", "overlap_depth", F.col("agree").alias("overlap_alt_agree"), F.col("disagree").alias("overlap_alt_disagree"), "overlap_ref_agree",
    )


def _indel_tally() -> Column:
    """What a fragment adds to indels: agreeing alleles once, the one without N; one-sided or different ones as disagreements."""
    r, a, b = F.col("reads"), F.get("reads", F.lit(0)), F.get("reads", F.lit(1))
    x, y = a["allele"], b["allele"]
    many = lambda *e: F.array(*e).cast(f"array<{_ENTRY}>")
    lone = lambda e: _entry(e["allele"], e["fwd"], ~e["fwd"], 0, 1)
    best = F.when(~F.contains(x, F.lit("N")), x).otherwise(y)
    pair = F.when((x == "") & (y == ""), many()).when(x == "", many(lone(b))).when(y == "", many(lone(a))).when(compatible(x, y), many(_entry(best, F.lit(1), F.lit(1), 1, 0))).otherwise(many(lone(a), lone(b)))
    each = F.transform(F.filter(r, lambda e: e["allele"] != ""), _single).cast(f"array<{_ENTRY}>")
    return F.when(F.size(r) == 2, pair).otherwise(each)


def _indel_alleles(reads: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """Every read at places that have an indel, with ``allele``: ``+SEQ``, ``-SEQ`` or empty."""
    events = bases(reads.where(F.col("cigar").rlike("[ID]"))).where(F.col("kind").isin("I", "d"))
    gone = events.where("kind = 'd'").select(*LOCUS, "size").distinct()
    from .annotate import windows

    longest = gone.agg(F.max("size")).first()[0] or 0  # one number
    spots = windows(gone.select("chrom", "pos").distinct(), reference, longest, chunk)
    deleted = gone.join(spots, ["chrom", "pos"]).select(*LOCUS, "size", F.substring(F.col("window"), F.col("window_at") + 2, F.col("size")).alias("cut"))
    events = events.join(deleted, [*LOCUS, "size"], "left")
    allele = F.when(F.col("kind") == "I", F.concat(F.lit("+"), "base")).when(F.length("cut") == F.col("size"), F.concat(F.lit("-"), "cut"))
    events = events.select(*LOCUS, "qname", "ordinal", allele.alias("allele"))
    at = events.select(*LOCUS).distinct()
    own = bases(reads).where(F.col("kind").isin("M", "D")).join(at, LOCUS, "left_semi")
    return own.join(events.where("allele is not null"), [*LOCUS, "qname", "ordinal"], "left").withColumn("allele", F.coalesce("allele", F.lit("")))


def _indel_counts(reads: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    fragments = _fragments(_indel_alleles(reads, reference, chunk), F.col("allele"))
    tally = fragments.select(*LOCUS, F.explode(_indel_tally()).alias("t")).select(*LOCUS, "t.*")
    counts = tally.groupBy(*LOCUS, "allele").agg(*[F.sum(c).cast("int").alias(c) for c in ("n", "fwd", "rev", "agree", "disagree")])
    return counts.withColumn("variant_type", F.when(F.col("allele").startswith("+"), "insertion").otherwise("deletion"))


def cycle() -> Column:
    """The sequencing cycle of a read's place, from 1, hard-clipped bases at the 5' end included."""
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    return F.when(reverse, F.col("hard5") + F.length("seq") - F.col("at")).otherwise(F.col("hard5") + F.col("at") + 1)


def alt_reads(reads: DataFrame, found: DataFrame, min_mapq: int = 0, min_base_qual: int = 0, **include) -> DataFrame:
    """A row for each read that supports a SNV of ``found``; of a pair that agrees only its first read."""
    plain = _plain(by_fragment(usable(reads, min_mapq, **include)), min_base_qual)
    loci = found.where("variant_type = 'SNV'").select(*LOCUS, F.col("alt_allele").alias("base")).distinct()
    hit = plain.join(loci, [*LOCUS, "base"], "left_semi")
    first = F.col("flag").bitwiseAND(READ1) != 0
    own = F.struct("ordinal", first.alias("is_read1"), cycle().cast("int").alias("cycle"), "seq", "at", "qual", "mapq", "tlen", "ab", "ba", "cd")
    whole = plain.groupBy(*LOCUS, "qname").agg(F.count("*").alias("n"))
    by = hit.groupBy(*LOCUS, "qname", "base").agg(F.array_sort(F.collect_list(own)).alias("reads")).join(whole, [*LOCUS, "qname"])
    agree = (F.col("n") == 2) & (F.size("reads") == 2)
    lead = F.when(F.col("reads")[0]["is_read1"], F.slice("reads", 1, 1)).otherwise(F.slice("reads", 2, 1))
    out = by.select(*LOCUS, "base", F.explode(F.when(agree, lead).otherwise(F.col("reads"))).alias("r")).select(*LOCUS, F.col("base").alias("alt_allele"), "r.*")
    size = F.abs("tlen")
    return out.select(
        *LOCUS, "alt_allele", "cycle", F.length("seq").alias("read_length"), "is_read1", F.col("ab").alias("ab_count"), F.col("ba").alias("ba_count"), F.col("cd").alias("family_size"),
        F.col("qual").alias("base_qual"), F.col("mapq").alias("map_qual"), F.when(size > 0, size).alias("insert_size"), *[c.cast("int").alias(n) for n, c in n_runs(F.col("seq"), F.col("at")).items()],
    )


def normal_evidence(tumor: DataFrame, reads: DataFrame, normal_sample: str, min_mapq: int = 0, min_base_qual: int = 0, **include) -> DataFrame:
    """For each tumor locus an anchor row with the normal's depth, and a row for each of its alleles.

    Depth counts fragments whose first read there is not N; the reference base
    gives no row. All loci are looked up in one join, not one by one. Of reads of one
    ordinal the first is that of the least ``file_row``, or of the least base without this column.
    """
    loci = tumor.select(F.col("sample_id").alias("tumor_sample_id"), "chrom", "pos", "ref_allele", F.col("alt_allele").alias("tumor_alt_allele")).distinct()
    plain = _plain(by_fragment(usable(reads, min_mapq, **include)), min_base_qual)
    # letters as numbers, which a hash aggregation can hold
    letter = F.min_by(F.ascii("base"), "file_row") if "file_row" in plain.columns else F.min(F.ascii("base"))
    own = plain.groupBy("chrom", "pos", "qname", "ordinal").agg(letter.alias("letter")).groupBy("chrom", "pos", "qname").agg(F.min_by("letter", "ordinal").alias("letter"))
    counts = own.groupBy("chrom", "pos", "letter").agg(F.count("*").cast("int").alias("normal_alt_count")).withColumn("normal_alt_allele", F.char("letter")).where("normal_alt_allele != 'N'")
    place = counts.groupBy("chrom", "pos").agg(F.sum("normal_alt_count").cast("int").alias("normal_depth"), F.collect_list(F.struct("normal_alt_allele", "normal_alt_count")).alias("seen"))
    anchor = F.array(F.struct(F.lit(None).cast("string").alias("normal_alt_allele"), F.lit(0).alias("normal_alt_count")))
    others = F.coalesce(F.filter("seen", lambda x: x["normal_alt_allele"] != F.col("ref_allele")), F.slice(anchor, 1, 0))
    rows = loci.join(place, ["chrom", "pos"], "left").withColumn("e", F.explode(F.concat(anchor, others)))
    return rows.select("tumor_sample_id", "chrom", "pos", "tumor_alt_allele", F.lit(normal_sample).alias("normal_sample_id"), "e.normal_alt_allele", F.coalesce("normal_depth", F.lit(0)).alias("normal_depth"), "e.normal_alt_count")
