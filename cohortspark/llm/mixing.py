"""Soft-membership mixing of documents to target domain weights.

A table of labelled documents defines the domains: good (quality 1, not
toxic), toxic, and junk (quality 0, not toxic). A naive Bayes classifier over
hashed words is counted from a bounded sample of them and gives every document
its posterior over the domains. Each document then gets a nonnegative rate: how
often it is to be used. Projected-gradient least squares finds rates whose
expected domain totals, the sum of rate x tokens x posterior, match the targets.

All of it is DataFrame expressions. The gradient of a document depends on the
others through one residual per domain, so an iteration is a single aggregation
of as many numbers as there are domains, and a document's rate is an expression
of its own posterior and last rate: nothing is joined.

Defined results: a null or blank text has no tokens, the prior as posterior and
rate 1; it changes no total. Rows with a null or repeated doc_id have rates like
all others (each row counts, with the rate of its own text). Labels that are null or unknown are not
learnt from; a label's repeats are one (the least). Without labelled documents the
posterior is uniform. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts

DOMAINS = ("good", "toxic", "junk")
#: Shares of the mixture's tokens.
TARGET = {"good": 0.86, "toxic": 0.06, "junk": 0.08}
#: Buckets of the classifier's word table; the table is this long whatever the corpus.
BUCKETS = 1 << 14
#: Most labelled documents that the classifier is counted from, the first by a hash of their id.
TRAIN_ROWS = 6000
#: Gradient steps at most, and the largest residual (as a share of all tokens) that ends them.
STEPS, TOLERANCE = 40, 1e-6
#: Steps whose rates are one expression before they are written.
NESTED = 10
#: A residual beyond this share of all tokens is warned of: the targets cannot be met, or not in so many steps.
FAR = 0.005


def words(text: Column) -> Column:
    """Words between blanks, in lower case; an empty text has one empty word."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\n\t\r\f\x0b", F.lower(text))
    return F.split(plain, " ")


def _exploded(t: DataFrame, *keys: str) -> DataFrame:
    return t.select(*keys, F.explode(words(F.col("text"))).alias("word")).where("word != ''")


def _bucket() -> Column:
    return (F.xxhash64("word").bitwiseAND(BUCKETS - 1)).cast("int")


def word_table(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[float]]:
    """``bucket, w_0 .. w_k`` (log likelihood beside the mean over domains), and the log priors."""
    domain = F.when(F.col("toxic") == 1, 1).when((F.col("quality") == 0) & (F.col("toxic") == 0), 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    known = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = texts(docs).join(F.broadcast(known), "doc_id")
    k = range(len(DOMAINS))
    counts = _exploded(own, "domain").groupBy(_bucket().alias("bucket")).agg(*[F.sum(F.when(F.col("domain") == i, 1.0).otherwise(0.0)).alias(f"c_{i}") for i in k])
    counts = materialise(counts, "words")
    sums = counts.agg(*[F.coalesce(F.sum(f"c_{i}"), F.lit(0.0)) for i in k]).first()
    per = {r.domain: r["count"] for r in own.select("doc_id", "domain").distinct().groupBy("domain").count().collect()}
    logp = [F.log((F.col(f"c_{i}") + 0.5) / F.lit(sums[i] + 0.5 * BUCKETS)) for i in k]
    mean = reduce(lambda a, b: a + b, logp) / len(DOMAINS)
    # buckets without a row have the same weight in all domains but for the smoothing
    table = counts.select("bucket", *[(logp[i] - mean).alias(f"w_{i}") for i in k])
    return table, [math.log((per.get(i, 0) + 1.0) / (sum(per.values()) + len(DOMAINS))) for i in k]


def weights(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[float]]:
    """One row ``w_0 .. w_k``, each the ``BUCKETS`` weights of a domain in order, and the log priors."""
    table, prior = word_table(docs, labels, rows)
    k = range(len(DOMAINS))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(table), "bucket", "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("bucket", *[F.coalesce(f"w_{i}", F.lit(0.0)).alias(f"w_{i}") for i in k]))).alias("all"))
    return materialise(one.select(*[F.col(f"all.w_{i}").alias(f"w_{i}") for i in k]), "weights"), prior


def membership(docs: DataFrame, table: DataFrame, prior: list[float]) -> DataFrame:
    """``docs`` with ``__tokens, __p_0 .. __p_k``: array functions on the row, beside the one row of :func:`weights`.

    The log odds of a document's words are divided by the root of their number,
    so that long documents keep a soft membership.
    """
    k = range(len(DOMAINS))
    own = [F.col(f"`{c}`") for c in docs.columns]
    bare = F.filter(words(F.coalesce(F.col("text"), F.lit(""))), lambda w: w != "")
    row = docs.select(*own, F.transform(bare, lambda w: F.xxhash64(w).bitwiseAND(BUCKETS - 1).cast("int")).alias("__at"))
    row = row.join(F.broadcast(table.select(*[F.col(f"w_{i}").alias(f"__w_{i}") for i in k])))
    sums = [_sum(i) for i in k]
    n = F.size("__at").cast("long")
    row = row.select(*own, n.alias("__tokens"), *[(sums[i] / F.sqrt(F.greatest(n, F.lit(1)).cast("double")) + F.lit(prior[i])).alias(f"__z_{i}") for i in k])
    top = F.greatest(*[F.col(f"__z_{i}") for i in k])
    row = row.select(*own, "__tokens", *[F.exp(F.col(f"__z_{i}") - top).alias(f"__e_{i}") for i in k])
    whole = reduce(lambda a, b: a + b, [F.col(f"__e_{i}") for i in k])
    return row.select(*own, "__tokens", *[(F.col(f"__e_{i}") / whole).alias(f"__p_{i}") for i in k])


def _sum(i: int) -> Column:
    return F.aggregate("__at", F.lit(0.0), lambda a, b: a + F.get(F.col(f"__w_{i}"), b))


def posteriors(docs: DataFrame, table: DataFrame, prior: list[float]) -> DataFrame:
    """``doc_id, tokens, p_0 .. p_k`` for each row of ``docs``."""
    got = membership(texts(docs), table, prior)
    return got.select("doc_id", F.col("__tokens").alias("tokens"), *[F.col(f"__p_{i}").alias(f"p_{i}") for i in range(len(DOMAINS))])


def _stepped(rate: Column, p: list[Column], slope: list[float]) -> Column:
    return F.greatest(F.lit(0.0), rate - reduce(lambda a, b: a + b, [F.lit(s) * x for s, x in zip(slope, p, strict=True)]))


def rates(member: DataFrame, target: dict[str, float] | None = None, total: float | None = None, steps: int = STEPS) -> tuple[DataFrame, dict]:
    """``member`` with ``rate``, and how well the domain totals match.

    ``member`` is a written table with ``tokens, p_*``. Targets are shares of
    ``total`` tokens, by default as many as there are. The least squares weigh
    the domains' residuals by the inverse of G, the posteriors' second moments,
    and gradients are taken in the metric that weighs a document by its tokens:
    a document's gradient is then p . G^-1 e, and a step of 1 would be exact if
    no rate were held at zero. Rates that are cost further steps. The ridge in
    the inverse keeps a domain that hardly occurs from asking for huge rates.
    """
    target = target or TARGET
    k = range(len(DOMAINS))
    n, p = F.col("tokens"), [F.col(f"p_{i}") for i in k]
    share = [target[d] / sum(target.values()) for d in DOMAINS]
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).cast("double")
    got = member.agg(zero(n), *[zero(n * x) for x in p], *[zero(n * x * y) for x in p for y in p]).first()
    have, sums = got[0], list(got[1 : 1 + len(p)])
    if not have:
        nothing = dict.fromkeys(DOMAINS, 0.0)
        return member.withColumn("rate", F.lit(1.0)), {"tokens": 0.0, "totals": nothing, "target": nothing, "residual": 0.0, "slopes": []}
    goal = [s * (total or have) for s in share]
    whiten = np.linalg.pinv(np.array(got[1 + len(p) :]).reshape(len(p), len(p)) / have + 1e-4 * np.eye(len(p)))
    rated, rate, slopes = member, F.lit(1.0), []
    while True:
        e = [(a - b) / have for a, b in zip(sums, goal, strict=True)]
        residual = max(map(abs, e))
        if residual <= TOLERANCE or len(slopes) == steps:
            break
        slopes.append((whiten @ np.array(e)).tolist())
        rate = _stepped(rate, p, slopes[-1])
        if len(slopes) % NESTED == 0:  # a written column instead of an ever deeper expression
            rated, rate = materialise(rated.withColumn("rate", rate), "rates"), F.col("rate")
        sums = list(rated.agg(*[F.sum(n * x * rate) for x in p]).first())
    totals = {d: sums[i] for i, d in enumerate(DOMAINS)}
    if residual > FAR:
        warnings.warn(f"the mixture is off its targets by {residual:.1%} of all tokens: {totals} instead of {goal}", stacklevel=2)
    return rated.withColumn("rate", rate), {"tokens": have, "totals": totals, "target": dict(zip(DOMAINS, goal, strict=True)), "residual": residual, "slopes": slopes}


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, tokens, p_good, p_toxic, p_junk, rate``, one row for each row of ``docs``."""
    member = materialise(posteriors(docs, *weights(docs, labels, rows)), "posteriors")
    rated, _ = rates(member, target)
    return rated.select("doc_id", "tokens", *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("rate")).alias("rate"))


def apply_rates(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with each document as often as its rate says, all columns unchanged.

    The whole part of a rate gives so many copies; its fraction one more if a
    hash of the id and text falls below it, which keeps expected totals. A rate
    is an expression of the row's own posterior and the steps taken: no row is
    joined with another or shuffled.
    """
    table, prior = weights(docs, labels, rows)
    _, found = rates(materialise(posteriors(docs, table, prior), "posteriors"), target)
    p = [F.col(f"__p_{i}") for i in range(len(DOMAINS))]
    rate = reduce(lambda r, slope: _stepped(r, p, slope), found["slopes"], F.lit(1.0))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rated = membership(docs, table, prior).select(*own, F.when(F.col("__tokens") == 0, 1.0).otherwise(rate).alias("__rate"))
    spin = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("__rate") + F.when(spin < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return rated.select(*own, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("__copy")).select(*own)
