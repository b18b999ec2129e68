"""Quality, toxicity, mixing, URL reputation: brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing, quality, toxicity, urls
from cohortspark.llm.common import held_out, materialise

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(found, labels, label):
    rows = found.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(label)).cast("double").alias("ok")).collect()
    return sum(r.ok for r in rows) / len(rows)


def test_quality_held_out(spark, tables):
    docs, labels = tables
    found = materialise(quality.classify(docs, labels), "q")
    assert found.count() == docs.count() and accuracy(found, labels, "quality") >= 0.97
    assert found.where("score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").count() == 0
    kept = quality.keep_good(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == found.where("predicted = 1").count()


def test_quality_does_not_see_ids_or_held_out_labels(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(held_out(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped)
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    a = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    b = {r.doc_id - 7: r.score for r in quality.score(docs.withColumn("doc_id", F.col("doc_id") + 7), model).collect()}
    assert a == b


def test_ftrl_equals_scalar_updates():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 1 << quality.BITS, 6)).astype(np.uint32), None, int(rng.integers(0, 2))) for _ in range(30)]
    rows = [(i, np.ones(len(i), np.float32), y) for i, _, y in rows]
    w, bias = quality.train(rows)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for idx, x, y in rows:
            own = {int(i): weight(int(i)) for i in idx}
            b = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
            g = 1 / (1 + math.exp(-(sum(own.values()) + b))) - y
            for i, wi in own.items():
                s = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0) + g - s * wi, n.get(i, 0) + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / quality.ALPHA * b, nb + g * g
    assert all(abs(w[i] - weight(i)) < 1e-5 for i in z) and abs(bias + zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)) < 1e-9


EDGE = [(1, None), (2, ""), (3, "\n \t"), (None, "some words here"), (4, "x"), (4, "x"), (5, "wörd " * 30_000)]


def test_scores_of_odd_texts(spark, tables):
    _, labels = tables
    rows = spark.createDataFrame(EDGE, DOCS).withColumn("label", F.lit(9))
    none = labels.limit(0)
    assert {r.predicted for r in quality.classify(rows, none).collect()} == {1}
    assert [r.score for r in toxicity.classify(rows, none).collect()] == [0.0] * len(EDGE)
    docs, _ = tables
    model = quality.fit(docs.unionByName(rows.select("doc_id", "text"), allowMissingColumns=True), labels.unionByName(spark.createDataFrame([(4, None, None), (None, 1, 1)], labels.schema)))
    assert quality.score(rows, model).count() == len(EDGE)
    assert quality.score(rows.limit(0), model).count() == 0
    tox = toxicity.fit(docs, labels)
    found = {(r.doc_id, round(r.score, 6)) for r in toxicity.tag(rows, tox).collect()}
    assert {i for i, _ in found} == {1, 2, 3, 4, 5, None} and all(s < 0.5 for _, s in found)
    assert (2, 0.0) in found and (1, 0.0) in found


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = materialise(toxicity.classify(labelled, labels), "t")
    assert found.count() == labelled.count() and accuracy(found, labels, "toxic") >= 0.97
    spans = found.where("n_spans > 0").join(docs, "doc_id").limit(20).collect()
    assert spans and all(0 <= s.start < s.stop <= len(r.text) and not r.text[s.start : s.stop].isspace() for r in spans for s in r.spans)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 4)) * 2, rng.normal(size=(2, 2))
    sizes = [4, 3, 1, 2, 4]
    mask = np.array([[i < s for i in range(4)] for s in sizes])
    p, pairs = toxicity.marginals(np.where(mask, e, 0.0), t, mask)
    want, moves = np.zeros((5, 4)), np.zeros((2, 2))
    for row, size in enumerate(sizes):
        weights = {}
        for code in range(1 << size):
            y = [code >> i & 1 for i in range(size)]
            weights[code] = math.exp(sum(e[row, i] for i in range(size) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        for code, w in weights.items():
            y = [code >> i & 1 for i in range(size)]
            for i in range(size):
                want[row, i] += w / total * y[i]
            for a, b in zip(y, y[1:]):
                moves[a, b] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, moves)


def test_toxic_words_of_several_languages(spark):
    rng = random.Random(3)
    clean = [f"wo{rng.randint(0, 900)}" for _ in range(900)]
    rows, marks = [], []
    for i in range(700):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["awful", "Grimzel" + rng.choice(["a", "ou", "ist", "en"]) + rng.choice("xyz")])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.classify(docs, labels)
    assert accuracy(found, labels, "toxic") >= 0.97
    new = spark.createDataFrame([(1, "wo1 wo2 grimzelunseen wo3 GRIMZELother wo7"), (2, "wo1 wo5 wo6")], DOCS)
    got = {r.doc_id: r for r in toxicity.tag(new, toxicity.fit(docs, labels)).collect()}
    assert got[1].score >= 0.5 > got[2].score
    assert [(s.start, s.stop) for s in got[1].spans][0] == (8, 21)


def test_mixing_matches_targets(spark, tables):
    docs, labels = tables
    found = mixing.mix(docs, labels).toPandas()
    assert len(found) == docs.count() and (found.rate >= 0).all()
    assert np.allclose(found[["p_good", "p_toxic", "p_junk"]].sum(axis=1), 1)
    total = found.tokens.sum()
    for d in mixing.DOMAINS:
        assert abs((found.rate * found.tokens * found[f"p_{d}"]).sum() / total - mixing.TARGET[d]) < 1e-4


def test_mixing_solves_the_constrained_problem(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    rows = [(int(n), *map(float, q)) for n, q in zip(rng.integers(1, 50, 60), p, strict=True)]
    member = materialise(spark.createDataFrame(rows, "tokens long, p_0 double, p_1 double, p_2 double"), "m")
    target = {"good": 0.1, "toxic": 0.1, "junk": 0.8}
    rated, info = mixing.rates(member, target, steps=200)
    r = rated.toPandas()
    assert (r.rate >= 0).all()
    n = r.tokens.sum()
    for i, d in enumerate(mixing.DOMAINS):
        assert abs((r.rate * r.tokens * r[f"p_{i}"]).sum() / n - target[d]) < 1e-3
    assert len(info["slopes"]) > 1  # some rates are held at zero


def test_mixing_edges(spark, tables):
    _, labels = tables
    rows = spark.createDataFrame(EDGE, DOCS).withColumn("rate", F.lit("mine"))
    got = mixing.mix(rows, labels.limit(0)).collect()
    assert len(got) == len(EDGE) and all(r.rate == 1.0 for r in got if r.tokens == 0)
    assert mixing.mix(rows.limit(0), labels).count() == 0
    out = mixing.apply_rates(rows, labels.limit(0), {"good": 1, "toxic": 1, "junk": 1})
    assert out.columns == rows.columns


def test_rates_apply_as_whole_copies(spark, tables):
    docs, labels = tables
    rates = {r.doc_id: r.rate for r in mixing.mix(docs, labels).collect()}
    times = {r.doc_id: r["count"] for r in mixing.apply_rates(docs, labels).groupBy("doc_id").count().collect()}
    assert all(math.floor(x) <= times.get(i, 0) <= math.ceil(x + 1e-12) for i, x in rates.items())


URLS = [
    (1, "https://WWW.Example.com/en/a?x#y"), (2, "http://a.example.com/en/"), (3, "http://example.com"), (4, "x.com/en/"), (5, None), (6, "ftp://b.net/es/1"), (7, "http://b.net/de/"), (8, "http://badexample.com/en/"),
    (9, "http://org?q=http://x.com/"), (10, "http://com/x"), (11, ""), (12, "a://b.net://c/fr/"), (13, "http://ÄB.net/fr/"), (13, "http://ÄB.net/fr/"), (14, "http://new\nline.com/a\nb"),
]


def test_url_rules(spark, tables):
    _, labels = tables
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    split = {i: (got[i].host, got[i].path, got[i].rule) for i in got}
    assert split[1] == ("www.example.com", "/en/a", "www.example.com/en/") and got[1].verdict == "allow"
    assert split[2] == ("a.example.com", "/en/", "example.com/en/") and got[2].verdict == "block"
    assert split[3] == ("example.com", "", None) and split[4] == ("", "", None) == split[5] == split[11]
    assert split[6][2] == "net/es/" and split[7][2] is None and split[8] == ("badexample.com", "/en/", "com/")
    assert split[9] == ("org", "", None) and split[10] == ("com", "/x", "com/") and split[12][:2] == ("b.net:", "//c/fr/")
    assert split[13][0] == "Äb.net" and got[13].verdict == "block" and split[14][:2] == ("new\nline.com", "/a\nb")
    assert urls.judge(pages, labels).count() == len(URLS) and urls.judge(pages.limit(0), labels).count() == 0
    kept = urls.keep_allowed(pages, labels)
    assert kept.columns == pages.columns and kept.count() == sum(1 for i, _ in URLS if got[i].verdict == "allow")


def test_reputation_shrinks(spark):
    pages = [(i, f"http://good.a.org/{i}") for i in range(40)] + [(100 + i, f"http://bad.a.org/{i}") for i in range(40)] + [(200, "http://new.a.org/")]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
    rep = {r.host: r for r in urls.reputation(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert rep["good.a.org"].bound > 0.8 > rep["new.a.org"].mean > rep["bad.a.org"].mean
    assert rep["new.a.org"].n == 0 and rep["new.a.org"].domain == "a.org"


def test_urls_equal_sql(spark, tables):
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), tables[1]
    got = sorted(map(tuple, urls.judge(pages, labels).collect()), key=str)
    cols = "page_id, host, path, rule, verdict"
    assert got == sorted(c.sql(f"SELECT {cols} FROM ({urls.sql()})").fetchall(), key=str)
