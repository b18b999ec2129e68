"""Toxic spans by a linear-chain conditional random field.

The labels mark whole documents, so the training tokens are labelled first: a
cue is a word beginning that toxic documents have and clean ones, but for words
known to be ordinary, (all but) lack; cues are chosen greedily, each time the one
that explains most toxic documents still unexplained, longer beginnings first
among equals. A token with a cue that is no ordinary word, in a toxic document,
is a toxic token; all others are clean.

The chain has the states clean and toxic. A token's emission is a sum of hashed
weights of its word, its beginnings of two to eight characters and its ending;
two by two transition weights link neighbours. Weights maximise the regularised
likelihood of the labelled windows by AdaGrad steps with exact gradients from
forward-backward. A text is read in windows of ``WINDOW`` words, every word in
one; forward-backward gives each word's marginal probability of being toxic,
for all windows of a batch at once.

A document's score joins the marginals of its likeliest words of p 0.5 or more,
eight at most, as independent evidence, 1 - prod(1 - p), and their number, in a
logistic regression calibrated on labelled documents that the chain was not
trained on. Offending offsets are the spans, in code points, of runs of words
with p of 0.5 or more.

Defined results: a null, empty or wordless text has score 0 and no spans. Rows
with a null or repeated doc_id are scored like others; a null doc_id is not held
out. Null labels, labels without a text and texts without a label are not learnt
from; repeated labels of one id are one (the least). Without toxic labels, or
without any cue, all scores are 0. Other columns are not read.
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

BITS, WINDOW = 18, 64
#: Most labelled documents of either kind that are learnt from, the first by a hash of their id.
TRAIN_ROWS = 2000
#: A cue occurs in so many toxic documents at least, and clean documents are at most this share of its documents.
CUE_ROWS, CUE_CLEAN = 3, 0.06
#: How likely a cue's documents are all toxic by accident, at most.
CUE_CHANCE = 1e-3
CUES = 2000
#: Words whose marginals make a document's score: more of a kind are no further evidence.
MOST = 8
EPOCHS, RATE, RIDGE = 30, 0.5, 1e-4
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")
_BEGINNINGS = range(2, 9)


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    names = [f"w{word}", "b", f"e{word[-3:]}", *(f"p{word[:n]}" for n in _BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in names]


_U = np.uint64


def cue_hashes(word: str) -> list[tuple[int, int]]:
    """Hash and rank of each beginning of three to eight characters, and of the whole word.

    Among cues that explain as much, the longest beginning goes first, then the shortest whole word.
    """
    out = [(xxhash.xxh64_intdigest(word[:n]) >> 1, n) for n in range(3, 9) if len(word) > n]
    return out + ([(xxhash.xxh64_intdigest(word + "$") >> 1, -min(len(word), 99))] if len(word) > 1 else [])


class Corpus:
    """Documents as numbers of words in one vocabulary, with the hashes that cues are made of."""

    def __init__(self, texts_: list[str], toxic: list[bool]):
        held: dict[str, int] = {}
        self.docs = [np.array([held.setdefault(w, len(held)) for w in t.split()], np.int32) for t in texts_]
        self.toxic = np.array(toxic, bool)
        self.words = list(held)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in held], _U)
        names, ranks, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int8)], [np.zeros(1, np.int64)]
        for a in range(0, len(self.words), 20_000):  # arrays piece by piece: lists of all would be large
            part = [cue_hashes(w) for w in self.words[a : a + 20_000]]
            names.append(np.array([h for n in part for h, _ in n], np.int64))
            ranks.append(np.array([r for n in part for _, r in n], np.int8))
            sizes.append(np.array([len(n) for n in part], np.int64))
        self.names, self.ranks, self.first = np.concatenate(names), np.concatenate(ranks), np.cumsum(np.concatenate(sizes))

    def names_of(self, words: np.ndarray) -> np.ndarray:
        """Places in ``names`` of some words' hashes."""
        size = self.first[words + 1] - self.first[words]
        return np.repeat(self.first[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def some(self, which: np.ndarray) -> Corpus:
        out = object.__new__(Corpus)
        out.__dict__ |= self.__dict__ | {"docs": [self.docs[i] for i in which], "toxic": self.toxic[which]}
        return out


def copies(corpus: Corpus) -> np.ndarray:
    """A group number for each document; near copies have the same one (bands of a small MinHash)."""
    group = list(range(len(corpus.docs)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    odd = np.random.default_rng(3).integers(1, 2**62, 48, dtype=_U) | _U(1)
    seen: dict[tuple[int, bytes], int] = {}
    for i, own in enumerate(corpus.docs):
        if len(own):
            with np.errstate(over="ignore"):
                low = ((corpus.hashes[np.unique(own)][:, None] * odd[None, :]) >> _U(20)).min(axis=0)
            for b in range(6):
                j = seen.setdefault((b, low[8 * b : 8 * b + 8].tobytes()), i)
                group[root(i)] = root(j)
    return np.array([root(i) for i in range(len(group))], np.int64)


def _met(corpus: Corpus, which: np.ndarray, group: np.ndarray, ordinary: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, group) pairs of the documents ``which``, ordinary words apart, sorted by name."""
    names, groups = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in which:
        own = np.unique(corpus.docs[i])
        found = np.unique(corpus.names[corpus.names_of(own[~ordinary[own]])])
        if among is not None:
            found = found[np.isin(found, among, assume_unique=True)]
        names.append(found)
        groups.append(np.full(len(found), group[i]))
    name, of = np.concatenate(names), np.concatenate(groups)
    order = np.lexsort((of, name))
    name, of = name[order], of[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
    return name[new], of[new]


def find_cues(corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the cues, and which words are ordinary: never toxic tokens whatever they begin with.

    Cues are word beginnings and whole words. Every other clean document tells
    which words are ordinary; the rest of them tell how often a cue's other words
    meet in clean documents. Near copies count as one document, and a cue must be
    no likely accident of so many draws. Cues that explain nothing new are taken
    too if they are beyond all doubt.
    """
    group = copies(corpus)
    bad, clean = np.flatnonzero(corpus.toxic), np.flatnonzero(~corpus.toxic)
    bad_in, clean_in = np.zeros(len(corpus.words), np.int64), np.zeros(len(corpus.words), np.int64)
    for i in bad:
        bad_in[np.unique(corpus.docs[i])] += 1
    for i in clean[::2]:
        clean_in[np.unique(corpus.docs[i])] += 1
    ordinary = (clean_in > 0) & (4 * clean_in >= bad_in)
    none = np.empty(0, np.int64)
    name, of = _met(corpus, bad, group, ordinary, None)
    if not len(name):
        return none, ordinary
    start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.concatenate([start, [len(name)]]))
    start, size = start[size >= CUE_ROWS], size[size >= CUE_ROWS]
    where = {int(name[a]): set(of[a : a + n].tolist()) for a, n in zip(start, size, strict=True)}
    known, counts = np.unique(_met(corpus, clean[1::2], group, ordinary, name[start])[0], return_counts=True)
    met = dict.fromkeys(where, 0) | dict(zip(known.tolist(), counts.tolist(), strict=True))
    by, at = np.unique(corpus.names, return_index=True)
    rank = {n: int(corpus.ranks[at[np.searchsorted(by, n)]]) for n in where}
    every = set(group[bad].tolist())
    others = max(1, len(set(group[clean[1::2]].tolist())))
    draw = np.log(len(every) / (len(every) + others))  # of a document being toxic
    scale = len(every) / others
    usable = {n: d for n, d in where.items() if met[n] * scale <= CUE_CLEAN * len(d) and len(d) * draw < np.log(CUE_CHANCE)}
    sure = [n for n, d in usable.items() if met[n] * scale <= CUE_CLEAN / 3 * len(d) and len(d) * draw < np.log(CUE_CHANCE) * 3]
    left, chosen = set(every), []
    while left and usable and len(chosen) < CUES:
        gain = {n: len(d & left) for n, d in usable.items()}
        best = max(usable, key=lambda n: (gain[n] - 4 * scale * met[n], rank[n], n))
        if gain[best] < CUE_ROWS:
            break
        chosen.append(best)
        left -= usable.pop(best)
        usable = {n: d for n, d in usable.items() if gain.get(n, 0) >= CUE_ROWS}
    return np.unique(np.array(chosen + sure, np.int64)), ordinary


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(emission: np.ndarray, transition: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over ``(windows, places)`` log-odds emissions of the toxic state.

    Returns each word's probability of being toxic, and expected transitions
    summed over windows. ``mask`` marks words; each window's words come first.
    """
    n, t = emission.shape
    f = np.zeros((t, 2, n))
    e = emission.T
    f[0, 1] = e[0]
    for i in range(1, t):
        on = mask[:, i]
        for y in (0, 1):
            step = _log_add(f[i - 1, 0] + transition[0, y], f[i - 1, 1] + transition[1, y]) + (e[i] if y else 0.0)
            f[i, y] = np.where(on, step, f[i - 1, y])
    total = _log_add(f[-1, 0], f[-1, 1])
    b = np.zeros((2, n))
    p = np.zeros((t, n))
    pairs = np.zeros((2, 2))
    p[-1] = np.exp(f[-1, 1] - total)
    for i in range(t - 2, -1, -1):
        on = mask[:, i + 1]
        for x in (0, 1):
            for y in (0, 1):
                q = np.exp(f[i, x] + transition[x, y] + (e[i + 1] if y else 0.0) + b[y] - total)
                pairs[x, y] += q[on].sum()
        new = [_log_add(transition[x, 0] + b[0], transition[x, 1] + e[i + 1] + b[1]) for x in (0, 1)]
        b = np.where(on, np.array(new), b)
        p[i] = np.exp(f[i, 1] + b[1] - total)
    return np.where(mask, p.T, 0.0), pairs


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For words of texts laid end to end: each word's window and place, and the number of windows."""
    count = -(-sizes // WINDOW)
    start = np.cumsum(count) - count
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(start, sizes) + within // WINDOW, within % WINDOW, int(count.sum())


def train(corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Emission, transition and document weights; None where there is nothing to tell apart.

    Three quarters of the documents train the chain; all but those calibrate
    how a document's marginals make its score.
    """
    every = np.arange(len(corpus.docs))
    chain = _train_chain(corpus.some(every[every % 4 != 0]))
    if chain is None:
        return None
    emit = _Emissions(chain[0])
    rest = [i for i in every[::4] if len(corpus.docs[i])]
    p = _chances([np.array([emit[corpus.words[w]] for w in corpus.docs[i]]) for i in rest], chain[1])
    x = np.array([_evidence(q) for q in p]).reshape(-1, 3)
    y = corpus.toxic[rest].astype(float)
    weights = np.array([0.0, 1.0, 0.0])
    prior = weights.copy()
    for _ in range(100):  # short Newton steps for a logistic regression, drawn to the prior
        q = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - q) - (weights - prior))
        weights = weights + step * min(1.0, 0.3 / max(1e-9, float(np.linalg.norm(step))))
    return *chain, weights


def _evidence(p: np.ndarray) -> tuple[float, float, float]:
    """Of a document's marginals: 1, log odds of any of its ``MOST`` likeliest words being toxic, how many are."""
    top = np.sort(p)[-MOST:]
    some = top[top >= THRESHOLD]
    joint = -np.log1p(-np.minimum(some, 1 - 1e-6)).sum() if len(some) else -np.log1p(-top[-1]) if len(top) else 1e-6
    return 1.0, float(np.log(np.expm1(min(max(joint, 1e-6), 30.0)))), float(np.log1p(len(some)))


def _features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' features end to end, and how many each has."""
    flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for a in range(0, len(vocabulary), 20_000):
        part = [word_features(w) for w in vocabulary[a : a + 20_000]]
        flat.append(np.array([f for own in part for f in own], np.int32))
        sizes.append(np.array([len(own) for own in part], np.int64))
    return np.concatenate(flat), np.concatenate(sizes)


def _train_chain(corpus: Corpus) -> tuple[np.ndarray, np.ndarray] | None:
    cues, ordinary = find_cues(corpus)
    if not len(cues):
        return None
    begins = np.zeros(len(corpus.words), bool)
    owner = np.repeat(np.arange(len(corpus.words)), np.diff(corpus.first))
    begins[owner[np.isin(corpus.names, cues)]] = True
    sequences, targets = [], []
    rng = np.random.default_rng(7)
    for own, bad in zip(corpus.docs, corpus.toxic, strict=True):
        for a in range(0, len(own), WINDOW):
            part = own[a : a + WINDOW]
            if begins[part].any() or rng.random() < 0.15:
                sequences.append(part)
                targets.append(begins[part] & ~ordinary[part] if bad else np.zeros(len(part), bool))
    used, ids = np.unique(np.concatenate(sequences), return_inverse=True)
    vocabulary = [corpus.words[w] for w in used]
    sizes = np.array([len(s) for s in sequences])
    row, place, n = _windows(sizes)
    y = np.zeros((n, WINDOW), bool)
    y[row, place] = np.concatenate(targets)
    mask = np.zeros((n, WINDOW), bool)
    mask[row, place] = True
    flat, sizes_of = _features(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), sizes_of)
    observed = np.array([[(mask[:, 1:] & (y[:, :-1] == bool(a)) & (y[:, 1:] == bool(b))).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, t = np.zeros(1 << BITS), np.zeros((2, 2))
    gw, gt = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(EPOCHS):
        score = np.bincount(owner, w[flat], len(vocabulary))
        e = np.zeros((n, WINDOW))
        e[row, place] = score[ids]
        p, pairs = marginals(e, t, mask)
        wrong = (y - p)[row, place]
        per_word = np.bincount(ids, wrong, len(vocabulary))
        grad = np.bincount(flat, per_word[owner], 1 << BITS) - RIDGE * n * w
        step = observed - pairs - RIDGE * n * t
        gw += grad * grad
        gt += step * step
        w += RATE * grad / np.sqrt(gw)
        t += RATE * step / np.sqrt(gt)
    return w.astype(np.float32), t


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """A model from labelled texts that are not held out (crc32(doc_id) mod 5 = 0)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("label"))
    known = known.where(~held_out(5, 0))
    pick = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows * (2 - y)) for y in (0, 1)]
    own = texts(docs).join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")
    own = own.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of the texts under one id the least

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = pa.array([" ".join(_WORD.findall(t.as_py().lower())) for t in batch.column(1)], pa.string())
            yield pa.record_batch([batch.column(0), lists, batch.column(2)], names=["doc_id", "words", "label"])

    got = own.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(of, "doc_id long, words string, label int").toArrow()
    got = got.sort_by("doc_id")
    toxic = [y == 1 for y in got.column(2).to_pylist()]
    if not any(toxic):
        return None
    corpus = Corpus(got.column(1).to_pylist(), toxic)
    del got
    return train(corpus)


class _Emissions(dict):
    """Lower-case word to emission; emptied when full."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = float(self.weights[word_features(word)].sum(dtype=np.float64))
        return found


def tag(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """``doc_id, score, spans`` for each row of ``docs(doc_id, text)``; spans are ``(start, stop, p)`` in code points."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "doc_id long, score double, spans array<struct<start: long, stop: long, p: double>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = _Emissions(held.value[0]) if held.value else None
        for batch in slices(batches):
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            if emit is not None:
                for a, b, chances in _batched(batch.column(1), emit, held.value[1]):
                    for i, p in zip(range(a, b), chances, strict=True):
                        if len(p):
                            bad = np.flatnonzero(p >= THRESHOLD)
                            scores[i] = 1.0 / (1.0 + np.exp(-np.clip(np.dot(_evidence(p), held.value[2]), -30, 30)))
                            if len(bad):
                                spans[i] = _spans(batch.column(1)[i].as_py(), bad, p)
            yield pa.record_batch([batch.column(0), pa.array(np.clip(scores, 0.0, 1.0)), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    return texts(docs).mapInArrow(of, kinds)


#: Words whose windows are worked on at once.
_AT_ONCE = 300_000


def _batched(column: pa.Array, emit: _Emissions, transition: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """``(first row, last row + 1, marginals of each row's words)``."""
    a, held, total = 0, [], 0
    for i in range(len(column)):
        words = _WORD.findall(column[i].as_py().lower())
        held.append(np.fromiter(map(emit.__getitem__, words), np.float64, len(words)))
        total += len(words)
        if total >= _AT_ONCE or i + 1 == len(column):
            yield a, i + 1, _chances(held, transition)
            a, held, total = i + 1, [], 0


def _chances(held: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    sizes = np.array([len(h) for h in held])
    if not sizes.sum():
        return held
    row, place, n = _windows(sizes)
    flat = np.concatenate(held)
    out = np.zeros(len(flat))
    cells = row * WINDOW + place
    for first in range(0, n, 8192):
        on = slice(*np.searchsorted(row, [first, first + 8192]))
        rows = min(8192, n - first)
        e, mask = np.zeros(rows * WINDOW), np.zeros(rows * WINDOW, bool)
        e[cells[on] - first * WINDOW] = flat[on]
        mask[cells[on] - first * WINDOW] = True
        p, _ = marginals(e.reshape(rows, WINDOW), transition, mask.reshape(rows, WINDOW))
        out[on] = p.ravel()[cells[on] - first * WINDOW]
    return np.split(out, np.cumsum(sizes)[:-1])


def _spans(text: str, bad: np.ndarray, p: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of offending words as offsets in the original text.

    Lower-casing can change a text's length, so words are found in the
    original; a word that lower-cases into several is one span.
    """
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if len(at) != len(p):
        at = [(m.start(), m.end()) for m in _WORD.finditer(text) for _ in _WORD.findall(m.group().lower())]
    out: list[tuple[int, int, float]] = []
    last = -2
    for i in bad.tolist():
        if i >= len(at):
            break
        if i == last + 1:
            out[-1] = (out[-1][0], at[i][1], max(out[-1][2], float(p[i])))
        else:
            out.append((*at[i], float(p[i])))
        last = i
    return out


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_spans, spans`` for each row of ``docs``."""
    tagged = tag(docs, fit(docs, labels, rows))
    return tagged.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
