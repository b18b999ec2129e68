"""Pileup, coverage, intervals and annotations on fixtures with known answers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark import schemas
from cohortspark.functions.alleles import compatible, homopolymer, n_runs, sbs96, tandem
from cohortspark.operators import annotate, coverage, intervals, pileup


def read(q, pos, seq, flag=0, mapq=60, qual=40, cigar=None, tlen=0, tags=None, o=0):
    return ("s", o, q, flag, "chr1", pos, mapq, cigar or f"{len(seq)}M", seq, [qual] * len(seq), tlen, tags or {})


def reads(spark, rows):
    return spark.createDataFrame([(*r[:1], i, *r[2:]) for i, r in enumerate(rows)], schemas.READS)


PAIRS = {  # depth, overlap, {allele: (n, fwd, rev, agree, disagree)} of alleles other than C
    "TT": (1, 1, {"T": (1, 1, 1, 1, 0)}), "CC": (1, 1, {}), "CT": (1, 1, {"T": (1, 0, 1, 0, 1)}), "TC": (1, 1, {"T": (1, 1, 0, 0, 1)}),
    "TG": (1, 1, {"T": (1, 1, 0, 0, 1), "G": (1, 0, 1, 0, 1)}), "NT": (1, 1, {"T": (1, 0, 1, 0, 0)}), "CN": (1, 1, {}), "NN": (1, 1, {}), "N": (0, 0, {}),
}


def test_pair_rules(spark):
    rows, at = [], {}
    for i, c in enumerate(PAIRS):
        at[50 + i] = c
        rows.append(read(f"q{i}", 50 + i, c[0], flag=0x63))
        rows += [read(f"q{i}", 50 + i, c[1], flag=0x93)] if len(c) > 1 else []
    r = reads(spark, rows)
    depth = pileup.fragment_depth(pileup._fragments(pileup.bases(r).where("kind = 'M'"), F.col("base")))
    assert {at[x.pos]: (x.total_depth, x.overlap_depth) for x in depth.collect()} == {c: v[:2] for c, v in PAIRS.items()}
    ref = spark.createDataFrame([("chr1", 0, "C" * 300)], schemas.REFERENCE)
    found = {}
    for x in pileup.alt_bases(r, ref).collect():
        found.setdefault(at[x.pos], {})[x.alt_allele] = (x.alt_count, x.fwd_alt_count, x.rev_alt_count, x.overlap_alt_agree, x.overlap_alt_disagree)
    assert found == {c: v[2] for c, v in PAIRS.items() if v[2]}


def test_three_reads_of_a_fragment_count_singly(spark):
    r = reads(spark, [read("q", 50, "T"), read("q", 50, "T"), read("q", 50, "C")])
    ref = spark.createDataFrame([("chr1", 0, "C" * 300)], schemas.REFERENCE)
    x = pileup.alt_bases(r, ref).first()
    assert (x.total_depth, x.alt_count, x.overlap_depth) == (3, 2, 0)


def test_indels(spark):
    r = reads(spark, [read("a", 10, "CCCAC", cigar="3M1I1M", flag=0x63), read("a", 10, "CCCNC", cigar="3M1I1M", flag=0x93), read("b", 10, "CCCC", cigar="2M3D2M"), read("c", 10, "CCCCC")])
    ref = spark.createDataFrame([("chr1", 0, "ACGT" * 5)], schemas.REFERENCE)
    got = {(x.pos, x.ref_allele, x.alt_allele, x.variant_type, x.alt_count, x.fwd_alt_count, x.rev_alt_count, x.overlap_alt_agree) for x in pileup.alt_bases(r, ref).where("variant_type != 'SNV'").collect()}
    assert got == {(12, "A", "+A", "insertion", 1, 1, 1, 1), (11, "T", "-ACG", "deletion", 1, 1, 0, 0)}


def test_read_filters_and_region(spark):
    r = reads(spark, [read("a", 40, "A" * 10), read("b", 40, "A" * 10, flag=0x400), read("c", 40, "A" * 10, flag=0x100), read("d", 90, "A" * 10, mapq=3)])
    assert {x.qname for x in pileup.usable(r, 5).collect()} == {"a"}
    assert pileup.usable(r, 0, duplicates=True, secondary=True).count() == 4
    assert {x.qname for x in pileup.in_region(r, "chr1", 45, 60).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("flag,cigar,seq,at,want", [(0x10, None, "A" * 10 + "T" + "A" * 9, 10, 10), (0, "5H10M", "AAAAATAAAA", 5, 11), (0x10, "10M5H", "AAAATAAAAA", 4, 11)])
def test_cycle(spark, flag, cigar, seq, at, want):
    r = reads(spark, [read("q", 40, seq, flag=flag, cigar=cigar)])
    found = spark.createDataFrame([("s", "chr1", 40 + at, "T", "SNV")], "sample_id string, chrom string, pos long, alt_allele string, variant_type string")
    assert pileup.alt_reads(r, found).first().cycle == want


@pytest.mark.parametrize("seq,at,want", [("ATGNNAA", 2, (2, 4, 0, 2, 0, 2)), ("ANNTAAA", 3, (3, 3, 2, 0, 2, 0)), ("TNNAA", 0, (0, 4, 0, 2, 0, 2)), ("AANNT", 4, (4, 0, 2, 0, 2, 0)), ("ANNTNNAA", 3, (3, 4, 2, 2, 2, 2))])
def test_n_runs(spark, seq, at, want):
    made = n_runs(F.col("seq"), F.col("at"))
    x = spark.createDataFrame([(seq, at)], "seq string, at int").select(*[c.alias(n) for n, c in made.items()]).first()
    assert tuple(x) == want


@pytest.mark.parametrize("a,b,want", [("GACTT", "GACTN", True), ("GNCTN", "GACTN", True), ("GACTT", "NNNNN", True), ("GACTT", "GACTA", False), ("GACTT", "GAC", False)])
def test_wildcards(spark, a, b, want):
    assert spark.range(1).select(compatible(F.lit(a), F.lit(b))).first()[0] is want


@pytest.mark.parametrize("window,at,want", [("ACGTCGAT", 2, (1, 0, 0)), ("ACTTTTGC", 3, (4, 1, 4)), ("ACACACACGT", 4, (1, 2, 8)), ("TTAAAAAATT", 5, (6, 1, 6))])
def test_repeats(window, at, want):
    assert (homopolymer(window, at), *tandem(window, at)) == want


def test_context_labels(spark):
    rows = [("ACG", "C", "T", "A[C>T]G"), ("CGT", "G", "A", "A[C>T]G"), ("NCG", "C", "T", None), ("TAC", "A", "G", "G[T>C]A")]
    df = spark.createDataFrame(rows, "trinuc_context string, ref_allele string, alt_allele string, want string").withColumn("got", sbs96())
    assert all(x.got == x.want for x in df.collect())


def test_coverage_counts(spark):
    r = reads(spark, [read(f"r{i}", 40, "A" * 20) for i in range(10)] + [read(f"d{i}", 40, "A" * 20, flag=0x400) for i in range(5)])
    x = coverage.tally(r).where("pos = 40").first()
    assert (x.raw_read_depth, x.total_depth, round(x.frac_dup, 6)) == (15, 10, round(5 / 15, 6))
    r = reads(spark, [read(f"r{i}", 40, "A" * 20) for i in range(10)] + [read(f"d{i}", 40, "A" * 20, mapq=0) for i in range(5)])
    x = coverage.tally(r, min_mapq=20).where("pos = 40").first()
    assert (x.raw_read_depth, x.total_depth, round(x.frac_mapq0, 6)) == (15, 10, round(5 / 15, 6))


def test_zero_fill(spark):
    r = reads(spark, [read(f"r{i}", 40, "A" * 20) for i in range(15)])
    targets = spark.createDataFrame([("chr1", 10, 60, "t")], "chrom string, start long, end long, interval_name string")
    depth = {x.pos: x.total_depth for x in coverage.cover(spark, r, targets=targets).collect()}
    assert len(depth) == 50 and depth[10] == depth[39] == 0 and depth[40] == 15
    assert coverage.cover(spark, r).count() == 20
    contigs = spark.createDataFrame([("chr1", 100)], "chrom string, length long")
    assert coverage.cover(spark, r, fill_zeros=True, contigs=contigs).count() == 100
    assert coverage.cover(spark, r, fill_zeros=True, contigs=contigs, region="chr1:31-50").count() == 30


def _covered(spark, depths):
    return spark.createDataFrame([("s", "chr1", p, d) for p, d in depths], "sample_id string, chrom string, pos long, total_depth int")


def test_adaptive_bins(spark):
    depths = [(p, 25) for p in range(20)] + [(p, 15) for p in range(20, 30)]
    rows = {(x.pos, x.end, x.bin_n) for x in coverage.binned(_covered(spark, depths), 100, 20).collect()}
    assert (0, 20, 20) in rows and (20, 21, 1) in rows and len(rows) == 11
    depths = [(p, 5 if 10 <= p < 15 else 25) for p in range(30)]
    rows = sorted((x.pos, x.end, x.bin_n) for x in coverage.binned(_covered(spark, depths), 100, 20).collect())
    assert rows == [(0, 10, 10), (0, 15, 15), *[(p, p + 1, 1) for p in range(10, 15)]]
    strict = sorted((x.pos, x.end) for x in coverage.binned(_covered(spark, depths), 100, 20, strict_spans=True).collect())
    assert (15, 30) in strict


def test_interval_summary(spark):
    r = reads(spark, [read(f"r{i}", 100, "A" * 20) for i in range(5)])
    named = spark.createDataFrame([("chr1", 100, 120, "exon1"), ("chr1", 200, 220, "exon2")], "chrom string, start long, end long, interval_name string")
    got = {x.interval_name: (x.n_bases, x.mean_depth, x.frac_at_1x) for x in coverage.interval_summary(coverage.tally(r), r, named).collect()}
    assert got == {"exon1": (20, 5.0, 1.0), "exon2": (20, 0.0, 0.0)}


def test_best_feature_and_bridging(spark):
    f = spark.createDataFrame([("chr1", 0, 1000, "gene", "G", None), ("chr1", 99, 300, "exon", "G", 2), ("chr1", 149, 400, "CDS", "G", None)], "chrom string, start long, end long, feature string, gene string, exon_number int")
    p = spark.createDataFrame([("1", 50), ("chr1", 110), ("chr1", 200), ("chr1", 2000)], "chrom string, pos long")
    got = {(x.chrom, x.pos): (x.gene, x.feature_type, x.exon_number) for x in intervals.best_feature(p, f, 64).collect()}
    assert got == {("1", 50): ("G", None, None), ("chr1", 110): ("G", "exon", 2), ("chr1", 200): ("G", "CDS", None), ("chr1", 2000): (None, None, None)}


def test_point_joins_equal_brute_force(spark):
    rng = random.Random(4)
    spans = [("c", a, a + rng.randint(0, 50)) for a in (rng.randint(0, 500) for _ in range(80))]
    points = [("c", rng.randint(0, 600)) for _ in range(200)]
    i, p = spark.createDataFrame(spans, "chrom string, start long, end long"), spark.createDataFrame(points, "chrom string, pos long")
    got = sorted((x.pos, x._start, x._end) for x in intervals.join_points(p, i, 16).collect())
    assert got == sorted((q, a, b) for _, q in points for _, a, b in spans if a <= q < b)
    hit = {x.pos: x.on_target for x in intervals.on_target(p, i, 16).collect()}
    assert hit == {q: any(a <= q < b for _, a, b in spans) for _, q in points}
    last = {x.pos: x.start for x in intervals.last_interval(p.distinct(), i, 16).collect()}
    assert last == {q: max(a for _, a, b in spans if a <= q < b) for q in {q for _, q in points} if any(a <= q < b for _, a, b in spans)}


def test_merged_intervals(spark):
    i = spark.createDataFrame([("c", 0, 10), ("c", 5, 12), ("c", 12, 14), ("c", 20, 22), ("d", 1, 1)], "chrom string, start long, end long")
    assert sorted((x.chrom, x.start, x.end) for x in intervals.merged(i).collect()) == [("c", 0, 14), ("c", 20, 22)]


def test_windows_cross_chunks(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(40))
    ref = spark.createDataFrame([("c", a, seq[a : a + 8]) for a in range(0, 40, 8)], schemas.REFERENCE)
    loci = spark.createDataFrame([("c", p) for p in (0, 3, 7, 8, 20, 39)] + [("other", 5)], "chrom string, pos long")
    got = {x.pos: (x.window, x.window_at) for x in annotate.windows(loci, ref, 5, 8).collect()}
    assert got == {p: (seq[max(0, p - 5) : p + 6], min(p, 5)) for p in (0, 3, 7, 8, 20, 39)}


def test_normal_evidence(spark):
    tumor = spark.createDataFrame([("t", "chr1", 45, "C", "T"), ("t", "chr1", 200, "C", "T")], "sample_id string, chrom string, pos long, ref_allele string, alt_allele string")
    r = reads(spark, [read(f"x{i}", 40, "CCCCCTCCCC") for i in range(3)] + [read(f"y{i}", 40, "C" * 10) for i in range(7)])
    got = {(x.pos, x.normal_alt_allele, x.normal_depth, x.normal_alt_count) for x in pileup.normal_evidence(tumor, r, "N").collect()}
    assert got == {(45, None, 10, 0), (45, "T", 10, 3), (200, None, 0, 0)}


def test_normal_evidence_of_reads_of_one_ordinal(spark, tmp_path):
    """As SQL has it on one thread: the first read of the files counts. Part keys 100,000 apart give many such reads."""
    import duckdb

    from cohortspark.plans import engine

    rng = random.Random(3)
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE rows (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT)")
    for k in range(15):  # an order once in a file, since SQL takes the rows of a vector base by base
        con.executemany("INSERT INTO rows VALUES (?, ?, ?)", [(o, 100000 * rng.randrange(6) + rng.randrange(4), rng.randint(1, 7)) for o in rng.sample(range(300), 100)])
        con.execute(f"COPY rows TO '{tmp_path}/lineitem.parquet/part-{k:02}.parquet'").execute("DELETE FROM rows")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(engine.oracle_sql()["q8_j21_normal_evidence"]).fetchall()
    got = [tuple(x) for x in engine.queries()["q8_j21_normal_evidence"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_normal_evidence_takes_the_first_row_of_an_ordinal(spark):
    tumor = spark.createDataFrame([("t", "chr1", 50, "C", "T")], "sample_id string, chrom string, pos long, ref_allele string, alt_allele string")
    r = reads(spark, [read("q", 50, b) for b in "GTA"]).withColumn("read_ordinal", F.lit(1).cast("long"))
    for order, base in (({"G": 2, "T": 1, "A": 3}, "T"), ({"G": 1, "T": 2, "A": 3}, "G")):
        placed = r.withColumn("file_row", F.expr("CASE seq " + " ".join(f"WHEN '{b}' THEN {k}L" for b, k in order.items()) + " END"))
        assert [(x.normal_alt_allele, x.normal_alt_count) for x in pileup.normal_evidence(tumor, placed, "N").orderBy("normal_alt_count").collect()] == [(None, 0), (base, 1)]
    assert [x.normal_alt_allele for x in pileup.normal_evidence(tumor, r, "N").orderBy("normal_alt_count").collect()] == [None, "A"]


def test_track(spark):
    p = spark.createDataFrame([("1", 40), ("chr1", 70), ("chr1", 95)], "chrom string, pos long")
    scores = spark.createDataFrame([("chr1", 30, 60, 0.9), ("chr1", 60, 90, 0.3)], "chrom string, start long, end long, score double")
    got = {(x.chrom, x.pos): None if x.gem150 is None else round(x.gem150, 4) for x in intervals.track(p, scores, "gem150").collect()}
    assert got == {("1", 40): 0.9, ("chr1", 70): 0.3, ("chr1", 95): None}


def test_track_of_intervals_with_one_start(spark):
    """The longest one counts, in whatever order they come."""
    p = spark.createDataFrame([("chr1", 40)], "chrom string, pos long")
    spans = [("chr1", 30, e, float(e)) for e in (60, 90, 50)]
    for rows in (spans, spans[::-1], spans[1:] + spans[:1]):
        scores = spark.createDataFrame(rows, "chrom string, start long, end long, score double").coalesce(1)
        assert intervals.track(p, scores, "gem", 64).first().gem == 90.0


def _plan(df):
    """The plan as it ran, with the exchanges that were reused."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _small(spark):
    ref = spark.createDataFrame([("chr1", 0, "ACGT" * 20)], schemas.REFERENCE)
    return reads(spark, [read("a", 10, "CCCAC", cigar="3M1I1M", flag=0x63), read("a", 10, "CCCNC", flag=0x93), read("b", 10, "CCCC", cigar="2M3D2M")]), ref


def test_pileup_has_no_python(spark):
    r, ref = _small(spark)
    assert "MapInArrow" not in _plan(pileup.alt_bases(r, ref))


def test_reads_of_one_ordinal(spark):
    """Both reads of a pair count, though nothing tells which is the earlier."""
    r = reads(spark, [read("q", 50, "T", flag=0x63), read("q", 50, "G", flag=0x93)]).withColumn("read_ordinal", F.lit(1).cast("long"))
    ref = spark.createDataFrame([("chr1", 0, "C" * 300)], schemas.REFERENCE)
    assert {x.alt_allele: (x.total_depth, x.alt_count, x.overlap_alt_disagree) for x in pileup.alt_bases(r, ref).collect()} == {"T": (1, 1, 1), "G": (1, 1, 1)}


def _walked(cigar):
    ref, at, anchored, out = 0, 0, False, []
    for size, op in ((int(x[:-1]), x[-1]) for x in re.findall(r"\d+[MIDNSHP=X]", cigar)):
        if op in "M=X":
            out += [(ref + i, at + i, "M", 1) for i in range(size)]
            ref, at, anchored = ref + size, at + size, True
        elif op == "I":
            out += [(ref - 1, at, "I", size)] if anchored else []
            at += size
        elif op in "DN":
            out += [(ref - 1, at - 1, "d", size)] if anchored and op == "D" else []
            out += [(ref + i, at, op, 1) for i in range(size)]
            ref += size
        elif op == "S":
            at += size
    return out


def test_cigars(spark):
    rng = random.Random(7)
    cigars = ["5M", "3=", "*", "2S3M1I2M2D3M4N2M1S2H", "2I3M", "1D4M", "3H2S"] + ["".join(f"{rng.randint(1, 4)}{rng.choice('MIDNS=X')}" for _ in range(rng.randint(1, 7))) for _ in range(40)]
    made = [read(f"q{i}", 100, "ACGTN" * 8, cigar=c) for i, c in enumerate(cigars)]
    got = {}
    for x in pileup.bases(reads(spark, made)).collect():
        got.setdefault(x.qname, []).append((x.pos - 100, x.at, x.kind, x.size))
        want = ("ACGTN" * 8)[x.at : x.at + x.size] if x.kind in "MI" else ""
        assert x.base == want and x.qual == (40 if x.kind == "M" else None)
    assert {q: sorted(v) for q, v in got.items()} == {f"q{i}": sorted(_walked(c)) for i, c in enumerate(cigars) if _walked(c)}


def test_too_few_bases_are_an_error(spark):
    with pytest.raises(Exception, match="fewer bases"):
        pileup.bases(reads(spark, [read("q", 10, "ACG", cigar="5M")])).select("base").collect()


def test_normal_evidence_has_no_python_and_looks_up_once(spark):
    tumor = spark.createDataFrame([("t", "chr1", 12, "C", "T")], "tumor_sample_id string, chrom string, pos long, ref_allele string, alt_allele string").withColumn("sample_id", F.lit("t"))
    plan = _plan(pileup.normal_evidence(tumor, _small(spark)[0], "N"))
    assert "MapInArrow" not in plan and plan.count("Join") <= 1


@pytest.mark.parametrize("name", ["p16_context", "p17_p18_repeats"])
def test_loci_are_piled_up_once(spark, name):
    """Two scans: reads counted singly, and reads by fragment."""
    from cohortspark.plans import engine

    plan = _plan(engine.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan parquet") == 2


def test_coverage_has_no_python_and_hash_aggregates(spark):
    plan = _plan(coverage.tally(_small(spark)[0]))
    assert "MapInArrow" not in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_strand_of_reads_of_one_ordinal(spark):
    """It does not depend on the order of the rows."""
    rows = [read("q", 50, "T", flag=f) for f in (0x63, 0x93, 0x93)]
    for some in (rows, rows[::-1]):
        r = reads(spark, some).withColumn("read_ordinal", F.lit(1).cast("long")).coalesce(1)
        x = coverage.tally(r).first()
        assert (x.total_depth, x.fwd_depth, x.rev_depth) == (1, 1, 0)
