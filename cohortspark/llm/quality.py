"""Quality scores: hashed word n-gram logistic regression trained with FTRL.

A text's tokens are its runs of word characters and of other printing
characters. Features are hashed runs of one and two tokens and of one to three
token shapes; a shape is the case of a word's letters, "same" for a word that
equals the one before, or the first character of a run of signs. A feature's
value is its share of the text's tokens. Training goes once per epoch through a
bounded sample of labelled texts with follow-the-regularised-leader updates
(proximal, one learning rate per weight); scoring is a dot product of a text's
sparse features with the weights, in Arrow batches.

Defined results: a null or empty text has no features and its score is the
model's intercept alone. Rows with a null or repeated doc_id are scored like
others; a null doc_id is not held out. Labels without a text, texts without a
label and null labels are not learnt from; repeated labels of one id are one
(the least). Without labels of both kinds every score is the share of good
labels, or 1 where there are none: nothing is rejected. Other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, texts

BITS = 20
#: Most labelled texts that are learnt from, the first by a hash of their id.
TRAIN_ROWS = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
SCALE = 20.0
THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_U = np.uint32


class _Codes(dict):
    """Token to (word hash << 32 | shape hash); emptied when full."""

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        if token[0].isalnum() or token[0] == "_":
            shape = "0" if token.isdigit() else "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
        else:
            shape = token[0] if len(token) == 1 else token[0] * 2
        found = self[token] = (xxhash.xxh32_intdigest(token) << 32) | xxhash.xxh32_intdigest(shape, 7)
        return found


_SAME = np.uint32(0x5BD1E995)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(15))) * _U(0x2C1B3C6D)
    x = (x ^ (x >> _U(12))) * _U(0x297A2D39)
    return (x ^ (x >> _U(15))) >> _U(32 - BITS)


def features(tokens: list[str], codes: _Codes) -> np.ndarray:
    """The hashed features of a text, repeated as often as they occur."""
    both = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    w, s = (both >> np.uint64(32)).astype(_U), both.astype(_U)
    if len(w) > 1:
        s[1:][w[1:] == w[:-1]] = _SAME
        # the same word with one run of signs between
        if len(w) > 2:
            s[2:][w[2:] == w[:-2]] ^= _SAME
    out = [_mixed(w), _mixed(s * _U(3) + _U(1))]
    if len(w) > 1:
        out += [_mixed(w[:-1] * _U(0x9E3779B1) + w[1:]), _mixed(s[:-1] * _U(0x85EBCA77) + s[1:] * _U(5) + _U(2))]
    if len(w) > 2:
        out.append(_mixed(s[:-2] * _U(0xC2B2AE3D) + s[1:-1] * _U(0x27D4EB2F) + s[2:] * _U(7) + _U(3)))
    return np.concatenate(out)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept from ``(features, values, label)``, by FTRL-proximal updates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(EPOCHS):
        for idx, x, y in rows:
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            b = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1.0 / (1.0 + np.exp(-np.clip(w @ x + b, -35, 35))) - y
            gx = g * x
            sigma = (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / ALPHA
            z[idx] += gx - sigma * w
            n[idx] += gx * gx
            zb += g - (((nb + g * g) ** 0.5 - nb**0.5) / ALPHA) * b
            nb += g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w.astype(np.float32), -zb / ((BETA + nb**0.5) / ALPHA)


def sample(docs: DataFrame, labels: DataFrame, label: str, train_on, rows: int) -> DataFrame:
    """``doc_id, text, label``: at most ``rows`` labelled texts, the first by a hash of their id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    known = known.where(train_on).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = texts(docs).join(F.broadcast(known), "doc_id")
    # of the texts under one id the least, so that every run learns from the same
    return own.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """A model from the labelled texts that are not held out (crc32(doc_id) mod 4 = 2)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in slices(batches):
            out = []
            for doc, text, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = _TOKEN.findall(text)
                found, count = np.unique(features(tokens, codes), return_counts=True) if tokens else (np.empty(0, _U), np.empty(0))
                value = (count * (SCALE / max(1, len(tokens)))).astype(np.float32)
                out.append((doc, found.tobytes(), value.tobytes(), label))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "f", "x", "y"])

    chosen = sample(docs, labels, "quality", ~held_out(4, 2), rows).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    got = chosen.mapInArrow(of, "doc_id long, f binary, x binary, y int").toArrow()
    order = np.argsort([xxhash.xxh64_intdigest(str(d)) for d in got.column(0).to_pylist()], kind="stable")
    rows = got.select(["f", "x", "y"]).to_pylist()
    found = [(np.frombuffer(rows[i]["f"], _U), np.frombuffer(rows[i]["x"], np.float32), rows[i]["y"]) for i in order]
    del got, rows
    pa.default_memory_pool().release_unused()
    kinds = {y for *_, y in found}
    if len(kinds) < 2:
        share = 1.0 if not kinds else float(kinds.pop())
        return np.zeros(1 << BITS, np.float32), 20.0 if share else -20.0
    return train(found)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        weights, bias = held.value
        for batch in slices(batches):
            out = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column(1)):
                tokens = _TOKEN.findall(text.as_py())
                if tokens:
                    out[i] += float(weights[features(tokens, codes)].sum(dtype=np.float64)) * SCALE / len(tokens)
            yield pa.record_batch([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(of, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    scored = score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``, all columns unchanged.

    Every column travels through the scoring pass; nothing is joined or shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        weights, bias = held.value
        cut = np.log(threshold / (1 - threshold))
        for batch in slices(batches):
            good = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column(at)):
                tokens = _TOKEN.findall(text.as_py() or "")
                if tokens:
                    good[i] += float(weights[features(tokens, codes)].sum(dtype=np.float64)) * SCALE / len(tokens)
            yield batch.filter(pa.array(good >= cut))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots do not pass otherwise
    return plain.mapInArrow(of, plain.schema).toDF(*docs.columns)
