"""Jobs that the driver runs for tables whose rows it has counted, and for small sets of edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.llm import common, groups


def jobs_of(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(name))


def test_rows_counted_when_written_need_no_job(spark):
    table = common.materialise(spark.range(1000).where("id % 3 = 0"), "t", count=True, digest=F.bit_xor(F.xxhash64("id")))
    (one, n), jobs = jobs_of(spark, "counted", lambda: (common.compact(table), common.n_rows(common.compact(table))))
    assert (n, jobs) == (334, 0) and one.rdd.getNumPartitions() == 1
    assert table.digest == table.agg(F.bit_xor(F.xxhash64("id"))).first()[0]
    assert common.n_rows(common.materialise(table.where("id < 0"), "t", count=True)) == 0
    assert common.n_rows(table.where("id < 30")) == 10  # another table: counted anew


def test_a_round_of_a_small_edge_set_is_one_job(spark, monkeypatch):
    edges = common.materialise(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (7, 7)], "a long, b long"), "edges")
    rounds = []
    monkeypatch.setattr(groups, "materialise", lambda *a, **b: rounds.append(1) or common.materialise(*a, **b))
    found, jobs = jobs_of(spark, "rounds", lambda: groups.components(edges))
    assert {r.id: r.comp for r in found.collect()} == {i: 0 for i in range(21)} | {40: 40, 50: 40}
    assert len(rounds) > 2 and jobs <= len(rounds) + 1  # the first also shuffles


def test_large_edge_sets_have_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(groups, "COMPACT_ROWS", 3)
    monkeypatch.setattr(groups.compact, "__defaults__", (3,))
    edges = spark.createDataFrame([(i, i + 3) for i in range(30)], "a long, b long")
    assert {r.id: r.comp for r in groups.components(edges).collect()} == {i: i % 3 for i in range(33)}
