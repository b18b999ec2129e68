"""Large buckets of many separate families are compared in full."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import groups, minhash

DOCS = "doc_id long, text string"


@pytest.fixture(autouse=True)
def quiet():
    with np.errstate(over="ignore"):
        yield


def family_rows(families):
    """Pairs of near copies; all texts share boilerplate, and in it the only register of a band."""
    for seed in range(50):
        rng = random.Random(seed)
        word = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        plate, rows = word(60), []
        for g in range(families):
            own = word(40)
            rows += [(2 * g, " ".join(plate + own)), (2 * g + 1, " ".join(plate + own[:-1] + word(1)))]
        hashes = minhash._Hashes()
        sets = {i: minhash.weighted(minhash.shingles(minhash._words(t), hashes)) for i, t in rows}
        first = minhash.signatures([e for e, _ in sets.values()], [w for _, w in sets.values()], 1)[:, 0]
        if len(set(first.tolist())) == 1:
            return rows, sets
    raise AssertionError("no seed")


def test_near_copies_in_a_large_bucket_are_all_found(spark):
    rows, sets = family_rows(40)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if minhash.similarity(sets[a], sets[b]) >= 0.8]
    assert links == [(2 * g, 2 * g + 1) for g in range(40)]
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, DOCS), bands=1, rows=1).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_links_share_a_key_of_their_prefixes():
    rng = random.Random(3)
    pool = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    sets = []
    for _ in range(30):
        base = rng.sample(range(300), rng.randint(1, 80))
        for _ in range(5):
            own = sorted({rng.randrange(300) if rng.random() < 0.05 else i for i in base})
            found = np.unique(pool[own])
            sets.append((found, 1 + np.log(np.array([rng.choice([1, 1, 1, 2, 9]) for _ in found], float))))
    counts = np.zeros(minhash.CELLS, np.int64)
    for found, _ in sets:
        np.add.at(counts, (found % np.uint64(minhash.CELLS)).astype(np.int64), 1)
    keys = [dict(zip(key.tolist(), zip(rest.tolist(), mass.tolist()))) for key, rest, mass in (minhash.prefix(f, w, counts, 0.8) for f, w in sets)]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if minhash.similarity(sets[a], sets[b]) >= 0.8 - 1e-9]
    rule = "(" + minhash._POSSIBLE.format(0.8).replace("least", "min") + ")"

    def possible(a, b, key):
        (rest_p, mass_p), (rest_q, mass_q) = keys[a][key], keys[b][key]
        even_p, even_q = (len(set(sets[i][1].tolist())) == 1 for i in (a, b))
        return eval(rule, {}, {"rest_p": rest_p, "rest_q": rest_q, "mass_p": mass_p, "mass_q": mass_q, "size_p": len(sets[a][0]), "size_q": len(sets[b][0]), "even_p": even_p, "even_q": even_q, "min": min})

    assert len(links) > 50 and all(any(possible(a, b, key) for key in keys[a].keys() & keys[b].keys()) for a, b in links)


def test_one_bucket_with_many_families(spark):
    same = spark.createDataFrame([(i, i // 2) for i in range(100)], "id long, family long")
    nodes = same.select("id", F.array(F.lit(7).cast("long")).alias("keys"))

    def verify(pairs):
        out = pairs.join(same.select(F.col("id").alias("a"), F.col("family").alias("x")), "a").join(same.select(F.col("id").alias("b"), F.col("family").alias("y")), "b")
        return out.where("x = y").select("a", "b")

    comps = groups.link_buckets(nodes, verify)
    assert {r.id: r.comp for r in comps.collect()} == {i: i // 2 * 2 for i in range(100)}


def test_near_copies_that_meet_once_in_a_small_bucket_are_all_found(spark):
    rows, _ = family_rows(8)
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, DOCS), bands=1, rows=1).collect()}
    assert got == {i: i // 2 * 2 for i in range(16)}
