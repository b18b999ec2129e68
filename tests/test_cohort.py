"""Cohort queries against SQL and fixtures; merging, signatures, readers, streaming."""

from __future__ import annotations

import gzip
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from cohortspark import schemas
from cohortspark.functions.alleles import contexts96
from cohortspark.operators import cohort, compare, filters, merge, profile, signatures, spectra
from cohortspark.operators.filters import Filters, ReadFilters
from cohortspark.plans import engine, queries
from cohortspark.sources import alignments, files
from cohortspark.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


SQL = queries.oracle_sql() | engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    build = (queries.queries() | engine.queries())[name]
    ours, theirs = build(spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


ALT = "sample_id string, chrom string, pos int, ref_allele string, alt_allele string, variant_type string, alt_count int, total_depth int"


def _recount_tables(spark):
    a = spark.createDataFrame([("s1", "chr1", 100, "A", "T", "SNV", 5, 20), ("s1", "chr1", 200, "C", "G", "SNV", 4, 20), ("s1", "chr1", 300, "A", "+ATG", "insertion", 3, 20)], ALT)
    r = [("s1", "chr1", 100, "T", n) for n in (1, 1, 1, 3, 3)] + [("s1", "chr1", 200, "G", 1)] * 4
    return a, spark.createDataFrame(r, "sample_id string, chrom string, pos int, alt_allele string, family_size int")


def test_recount_and_inclusion(spark):
    a, r = _recount_tables(spark)
    f = ReadFilters(family_size=(2, 1000))
    assert {x.pos: x.alt_count for x in filters.recount(a, r, f).collect()} == {100: 2, 200: 0, 300: 3}
    assert {x.pos for x in filters.with_passing_reads(a, r, f).collect()} == {100, 300}


def test_family_size_class(spark):
    a = spark.createDataFrame([("s1", "chr1", 100, "A", "T", "SNV", 4, 20, "ATA")], ALT + ", trinuc_context string")
    a = a.replace("ATA", "TAT")
    r = spark.createDataFrame([("s1", "chr1", 100, "T", n) for n in (1, 1, 1, 10)], "sample_id string, chrom string, pos int, alt_allele string, family_size int")
    kinds = lambda reads: {x.family for x in spectra.by_family_size(a, reads).where("n > 0").collect()}
    assert kinds(r) == {"singleton"}
    assert kinds(ReadFilters(family_size=(2, 1000)).apply(r)) == {"multi"}


def test_panel_fixture(spark):
    rows = [("t", "chr1", 50, "C", "T", "SNV", 5, 15), ("pon1", "chr1", 50, "C", "T", "SNV", 3, 13), ("pon2", "chr1", 50, "C", "T", "SNV", 2, 12), *[(f"pon{i}", "chr1", 100, "C", "G", "SNV", 2, 12) for i in (1, 2, 3)]]
    df = spark.createDataFrame(rows, ALT)
    x = cohort.panel_evidence(df.where("sample_id = 't'"), df.where("sample_id != 't'")).first()
    assert (x.n_pon_samples, x.pon_total_samples, round(x.max_pon_vaf, 9)) == (2, 3, round(3 / 13, 9))


def test_filters_save_and_load():
    f = Filters(alt_min=3, samples=("a", "b"), recurrence=(2, 5))
    again, unknown = Filters.load(f.save())
    assert again == f and unknown == []
    assert Filters.load('{"version": 1, "filters": {"alt_min": 2, "other": 1}}')[1] == ["other"]
    assert not Filters().predicates()


def test_profile_fixture(spark):
    rows = [("a", 100, 104, 40), ("b", 100, 101, 10), ("b", 101, 102, 20), ("b", 102, 103, 30), ("b", 103, 104, 40)]
    df = spark.createDataFrame(rows, "sample_id string, pos long, end long, total_depth int")
    got = [(x.pos_bin, x.mean_depth, x.min_depth, x.max_depth, x.n_samples) for x in profile.profile(df).orderBy("pos_bin").collect()]
    assert got == [(100 + i, m, lo, 40.0, 2) for i, (m, lo) in enumerate([(25.0, 10.0), (30.0, 20.0), (35.0, 30.0), (40.0, 40.0)])]
    wide = spark.createDataFrame([("a", 0, 4, 20), ("b", 0, 4, 40), ("b", 9, 9, 1)], df.schema)
    assert [(x.pos_bin, x.mean_depth) for x in profile.profile(wide, 4).collect()] == [(0, 30.0)]
    assert profile.display_step(wide).first()[0] == 4


def test_unique_calls_text():
    rows = [{"side_name": "PipeA", "median_vaf": 0.04, "median_total_depth": 90}, {"side_name": "PipeB", "median_vaf": 0.1, "median_total_depth": 75}]
    assert "PipeA unique calls have lower median VAF" in compare.describe_unique(rows)


def _profiles():
    a, b = np.zeros(96), np.zeros(96)
    a[:48], b[48:] = 1 / 48, 1 / 48
    return a, b


def test_signatures_are_recovered():
    a, b = _profiles()
    known = pd.DataFrame({"A": a, "B": b}, index=contexts96())
    exposure = np.array([[90.0, 10], [20, 80], [50, 50], [5, 95]])
    matrix = exposure @ np.vstack([a, b])
    w, h = signatures.nmf(matrix, 2)
    found = {signatures.matches(p, known, 1)[0][0]: signatures.matches(p, known, 1)[0][1] for p in h}
    assert set(found) == {"A", "B"} and min(found.values()) > 0.99
    m = signatures.metrics(matrix, w @ h)
    assert m["cosine"] > 0.999 and m["relative_error_pct"] < 0.05
    _, novel = signatures.guided(matrix, a[None, :])
    assert signatures.cosine(novel, b) > 0.98
    one = signatures.fit(matrix[0], known)
    assert np.allclose(one["exposures"], exposure[0]) and one["residual_pct"] < 1e-6
    assert abs(signatures.onto_simplex(np.array([0.5, 2.0, -1.0])).sum() - 1) < 1e-12
    with pytest.raises(ValueError):
        signatures.nmf(matrix[:1], 2)


def test_strand_band():
    low, high = cohort.strand_band(100)
    assert low < 100 < high


def test_merge(spark, tmp_path):
    a, r = _recount_tables(spark)
    one, two, reads = (str(tmp_path / n) for n in ("a.parquet", "b.parquet", "a.reads.parquet"))
    a.write.parquet(one)
    a.withColumn("sample_id", compare.F.lit("s2")).drop("alt_count").withColumn("alt_count", compare.F.lit(1)).write.parquet(two)
    r.withColumns({"cycle": compare.F.lit(1), "base_qual": compare.F.lit(30), "map_qual": compare.F.lit(60)}).write.parquet(reads)
    out = str(tmp_path / "cohort")
    merge.merge(spark, [one, two, reads], out)
    held = merge.open_cohort(spark, out)
    assert held["alt_bases"].count() == 6 and held["alt_reads"].count() == 9
    assert {x.sample_id: x.n_alt_loci for x in held["samples"].collect()} == {"s1": 3, "s2": 3}
    assert held["inputs"].agg(compare.F.sum("n_rows")).first()[0] == 15
    assert held["metadata"].first().n_samples == 2
    with pytest.raises(ValueError):
        merge.merge(spark, [one], out)
    with pytest.raises(ValueError):
        merge.merge(spark, [str(tmp_path / "none.parquet")], out + "2")
    assert [merge.route(p) for p in ("x/s.parquet", "s.reads.parquet", "s.normal_evidence.parquet", "s.pon_evidence.parquet", "s.coverage.parquet", "s.coverage.intervals.parquet")] == ["alt_bases", "alt_reads", "normal_evidence", "pon_evidence", "coverage", "coverage_intervals"]
    wider = str(tmp_path / "c.parquet")
    a.withColumn("more", compare.F.lit(1)).write.parquet(wider)
    with pytest.raises(ValueError):
        merge.union(spark, [one, wider])


def test_text_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    bed = files.intervals(spark, put("t.bed", "#x\nchr1\t100\t200\texon1\nchr1\t5\n")).collect()
    assert [tuple(x) for x in bed] == [("chr1", 100, 200, "exon1")]
    listed = files.intervals(spark, put("t.interval_list", "@HD\tVN:1\nchr1\t101\t200\t+\texon1\n")).collect()
    assert [tuple(x) for x in listed] == [("chr1", 100, 200, "exon1")]
    gtf = files.genes(spark, put("g.gtf", 'chr1\tx\tgene\t1\t1000\t.\t+\t.\tgene_id "ID"; gene_name "G";\nchr1\tx\texon\t100\t300\t.\t+\t.\tgene_id "ID"; exon_number "2";\n')).collect()
    assert {(x.feature, x.gene, x.start, x.end, x.exon_number) for x in gtf} == {("gene", "G", 0, 1000, None), ("exon", "ID", 99, 300, 2)}
    gff = files.genes(spark, put("g.gff3", "chr1\tx\tgene\t100\t500\t.\t+\t.\tID=gene:1;Name=BRCA1\n")).first()
    assert (gff.gene, gff.start, gff.end) == ("BRCA1", 99, 500)
    pred = "\t".join(["0", "NM1", "chr1", "-", "10", "100", "10", "100", "2", "10,60,", "30,100,", "0", "GENE", "x", "y", "z"])
    tx = files.genes(spark, put("r.txt", pred + "\n")).collect()
    assert {(x.feature, x.start, x.end, x.exon_number) for x in tx} == {("gene", 10, 100, None), ("exon", 10, 30, 2), ("exon", 60, 100, 1)}
    tsv = files.variants_tsv(spark, put("v.tsv", "chrom\tpos_start\tpos_end\tref\tvar\tpost_filter_flag\nchr1\t5\t6\tA\tT\tNoRules\nchr1\t7\t8\tA\tG\tlow\nshort\t1\n")).collect()
    assert [(x.pos, x.alt_allele, x.filter) for x in tsv] == [(5, "T", "PASS"), (7, "G", "low")]
    vcf = files.vcf(spark, put("v.vcf", "##x\n#CHROM\nchr1\t11\t.\tA\tT,G\t.\tPASS\tAF=0.1,0.2\nchr1\t20\t.\tAC\tA\t.\tq10\t.\n")).orderBy("ord", "alt_index").collect()
    assert [(x.pos, x.alt_allele, x.af, x.filter) for x in vcf] == [(10, "T", 0.1, "PASS"), (10, "G", 0.2, "PASS"), (19, "-C", None, "q10")]
    track = put("t.bedgraph", "track x\nchr1\t30\t60\t0.9\n")
    assert files.bedgraph(spark, track).first().score == 0.9
    with pytest.raises(Exception, match="ends before"):
        files.bedgraph(spark, put("bad.bedgraph", "chr1\t60\t30\t0.9\n")).collect()
    fa = files.fasta(spark, put("r.fa", ">c1 some\nACGT\nacg\n>c2\nTT\n"), 4).orderBy("chrom", "chunk_start").collect()
    assert [tuple(x) for x in fa] == [("c1", 0, "ACGT"), ("c1", 4, "ACG"), ("c2", 0, "TT")]
    (tmp_path / "v.vcf.gz").write_bytes(gzip.compress(b"chr1\t11\t.\tA\tT\t.\tPASS\t.\n"))
    assert files.vcf(spark, str(tmp_path / "v.vcf.gz")).count() == 1
    assert files.track_specs(["a:x.bg", "b:s3://y"]) == [("a", "x.bg"), ("b", "s3://y")]
    with pytest.raises(ValueError):
        files.track_specs(["nopath"])
    assert files.config('data = "x.parquet"\nreference = "s3://b/r.fa"', "/p") == {"data": "/p/x.parquet", "reference": "s3://b/r.fa"}
    with pytest.raises(ValueError):
        files.config("other = 1", "/p")
    m = files.manifest(spark, put("m.tsv", "sample\tbam\ns1\ta.bam\n")).first()
    assert (m.sample, m.bam, m.bai) == ("s1", "a.bam", None)


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(wbits=-15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam(spark, tmp_path):
    text = b"@HD\tVN:1.6\n@RG\tID:x\tSM:sampleA\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    seq = "ACGTN"
    codes = [alignments.BASES.index(b) for b in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, 6, 2))
    body = struct.pack("<iiBBHHHiiii", 0, 41, 3, 60, 0, 2, 99, 5, 0, 50, 120) + b"q1\0" + struct.pack("<II", 2 << 4 | 5, 5 << 4) + packed + bytes([30] * 5) + b"cDi" + struct.pack("<i", 4) + b"XXZhello\0" + b"fFf" + struct.pack("<f", 1.0)
    raw = head + struct.pack("<i", len(body)) + body
    path = tmp_path / "a.bam"
    path.write_bytes(_block(raw[:50]) + _block(raw[50:]) + _block(b""))
    x = alignments.bam(spark, str(path)).first()
    assert (x.sample_id, x.qname, x.flag, x.chrom, x.pos, x.mapq, x.cigar, x.seq, x.quals, x.tlen, x.tags) == ("sampleA", "q1", 99, "chr1", 41, 60, "2H5M", "ACGTN", [30] * 5, 120, {"cD": 4})
    with pytest.raises(ValueError):
        alignments.bam(spark, "x.cram")
    with pytest.raises(ValueError):
        alignments.sample_of("@RG\tID:x\n")
    sam = tmp_path / "a.sam"
    sam.write_text("@RG\tID:x\tSM:sampleA\nq1\t99\tchr1\t42\t60\t2H5M\t=\t50\t120\tACGTN\t?????\tcD:i:4\tXX:Z:hello\n")
    y = alignments.sam(spark, str(sam)).first()
    assert x.asDict() | {"read_ordinal": 0} == y.asDict() | {"read_ordinal": 0}
    assert alignments.parse_region("chr1:101-200") == ("chr1", 100, 200)


def test_schema_contract(spark):
    a = spark.createDataFrame([], schemas.ALT_BASES)
    assert schemas.check(a, "alt_bases") is a
    with pytest.raises(ValueError, match="total_depth"):
        schemas.check(a.drop("total_depth"), "alt_bases")
    assert cohort.summary(a).first().n_rows == 0
    assert schemas.present(a, ["batch", "nothing"]).first().asDict() == {"batch": False, "nothing": False}
    with pytest.raises(ValueError):
        schemas.one_of("x", schemas.READ_TYPES, "read type")


def test_streaming_ingest(spark, tmp_path):
    a, _ = _recount_tables(spark)
    box, out = str(tmp_path / "box"), str(tmp_path / "cohort")
    a.write.parquet(box)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.watch(spark, box, a.schema), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{out}/alt_bases").count() == 3
    a.withColumn("sample_id", compare.F.lit("s2")).write.mode("append").parquet(box)
    ingest.ingest(ingest.watch(spark, box, a.schema), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{out}/alt_bases").count() == 6
