"""Near-duplicates by probability Jaccard: ProbMinHash, banding, verification.

A text's words are its runs of word characters, lower-cased; its shingles are
all runs of five words (a text of one to four words is one shingle), weighted
1 + ln(count), so that one line repeated hundreds of times does not outweigh the
rest of a text. Every shingle is a Poisson process whose rate is its
weight; each arrival falls on one of the signature's registers and the register
keeps its earliest one. A process is followed until it is later than every
register of the text, so a text of n shingles costs about n + m ln m arrivals
for m registers. Registers of two texts agree with the probability Jaccard
similarity of their weighted shingles.

Texts with the same words are one node. Bands of registers give buckets, and
each pair of texts that meet in one is in one class in the end or was verified
on the whole texts (:func:`link_buckets`): it is a link if the exact probability
Jaccard, or the plain Jaccard of the two sets of shingles, is at least
``threshold``. Pairs that are in one class by other links are not compared, so
the result is the classes and each document's membership, not a list of links.

Defined results: a null or wordless text has no shingle and is alone in its
class. Rows that repeat a doc_id and its text are one document; an id's other
texts are documents of their own. A class is a connected component of links,
named by its least doc_id; its first document by (doc_id, hash of the text) is
kept. Rows with a null doc_id are classes of their own (null class_id, kept).
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, small, texts
from .groups import link_buckets

WORDS, BANDS, ROWS, THRESHOLD = 5, 32, 5, 0.8
_WORD = re.compile(r"\w+")
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    """Word to 64-bit hash; emptied when it is full, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[str], hashes: _Hashes, k: int = WORDS) -> np.ndarray:
    """A hash for every run of k words; repeated runs repeat."""
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        out += _mix(h[j : j + len(out)] * _ODD[j % 5] + _U(j))
    return _mix(out)


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their weights."""
    found, count = np.unique(hashes, return_counts=True)
    return found, 1.0 + np.log(count)


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m registers for each weighted set; no set may be empty."""
    out = np.zeros((len(elements), m), _U)
    sizes = np.array([len(e) for e in elements])
    grade = np.frexp(sizes)[1]
    with np.errstate(over="ignore"):
        for g in np.unique(grade):
            rows = np.flatnonzero(grade == g)
            step = max(1, 2_000_000 // max(m, int(sizes[rows].max())))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                out[part] = _arrivals([elements[i] for i in part], [weights[i] for i in part], m)
    return out


def _arrivals(elements: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    n = len(elements)
    least = min(map(len, elements))
    block = max(1, min(1024, int(m * np.log(m) / least)))
    el, w = np.concatenate(elements), np.concatenate(weights).astype(np.float64)
    doc = np.repeat(np.arange(n), [len(e) for e in elements])
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, _U)
    clock, k = np.zeros(len(el)), 0
    while len(el):
        for a in range(0, len(el), 1_000_000 // block + 1):
            s = slice(a, a + 1_000_000 // block + 1)
            turn = np.arange(k + 1, k + block + 1, dtype=_U) * _ODD[0]
            z = _mix(el[s, None] + turn[None, :])
            gap = -np.log1p(-((z >> _U(11)).astype(np.float64) * 2.0**-53))
            at = clock[s, None] + np.cumsum(gap, axis=1)
            clock[s] = at[:, -1]
            at /= w[s, None]
            place = (_mix(z ^ _ODD[1]) >> _U(32)) * _U(m) >> _U(32)
            cell = (doc[s, None] * m + place.astype(np.int64)).ravel()
            at = at.ravel()
            use = np.flatnonzero(at < first[cell])
            cell, at, src = cell[use], at[use], use // block + a
            np.minimum.at(first, cell, at)
            won = first[cell] == at
            kept[cell[won]] = el[src[won]]
        k += block
        late = first.reshape(n, m).max(axis=1)
        on = np.flatnonzero(clock / w < late[doc])
        el, w, doc, clock = el[on], w[on], doc[on], clock[on]
    return kept.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, of two sets given as sorted distinct elements and their weights.

    The sum over shared d of 1 / sum over e of max(wa[e]/wa[d], wb[e]/wb[d]).
    With r[e] = wb[e]/wa[e], the inner maximum is the first ratio exactly when
    r[e] <= r[d], so the elements sorted by r and two running sums give all terms.
    """
    both = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(both)), np.zeros(len(both))
    wa[np.searchsorted(both, a[0])] = a[1]
    wb[np.searchsorted(both, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = wb / wa
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    low = np.cumsum(wa)
    high = wb.sum() - np.cumsum(wb)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    on = (wa > 0) & (wb > 0)
    return float(np.sum(1.0 / (low[last][on] / wa[on] + high[last][on] / wb[on])))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and plain Jaccard."""
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    if not both:
        return 0.0
    plain = both / (len(a[0]) + len(b[0]) - both)
    return max(plain, probability_jaccard(a, b))


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, k: int) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    salt = _mix(np.arange(1, bands + 1, dtype=_U) * _ODD[2])
    for part in slices(batches, 1024):
        ids, digests, content, sets = [], [], [], []
        with np.errstate(over="ignore"):
            for key, text, digest in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                s = shingles(_words(text.as_py()), hashes, k)
                if not len(s):
                    continue
                ids.append(key)
                digests.append(digest)
                content.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sets.append(weighted(s))
            if not ids:
                continue
            sig = signatures([e for e, _ in sets], [w for _, w in sets], bands * rows).reshape(len(ids), bands, rows)
            key = np.zeros((len(ids), bands), _U)
            for r in range(rows):
                key = _mix(key * _ODD[3] + sig[:, :, r])
            key = _mix(key ^ salt[None, :])
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(content, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))],
            names=["doc_id", "digest", "content", "keys"],
        )


def _compare(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(key: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        if key not in held:
            if len(held) >= 64:
                held.clear()
            with np.errstate(over="ignore"):
                held[key] = weighted(shingles(_words(text.as_py()), hashes, k))
        return held[key]

    for batch in slices(batches):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = [i for i in range(len(a)) if similarity(of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i])) >= threshold - 1e-9]
        yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


#: Cells that shingles are counted in for their order from rare to common.
CELLS = 1 << 18


def prefix(found: np.ndarray, weights: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct shingles, the rarest, of which any two sets that are a link share one.

    ``counts`` of shingle cells give an order that is the same for all sets. The
    first shared shingle leaves at least ``threshold`` of either set from there
    on: of its shingles for the plain Jaccard, and of its weight for the
    probability Jaccard, which is at most the sum of the smaller shares of weight.
    Returns the shingles, and how many and what share of the weight follow from
    each of them on. Shingles whose cell counts one set are shared with none and
    are left out.
    """
    often = counts[(found % _U(CELLS)).astype(np.int64)]
    order = np.lexsort((found, often))
    spare = 1 - threshold + 1e-6
    mass = np.cumsum(weights[order]) / weights.sum()
    n = max(int(spare * len(found)), int(np.searchsorted(mass, spare, side="right"))) + 1
    first = order[:n]
    on = np.flatnonzero(often[first] > 1)
    return found[first[on]], len(found) - on, 1 - np.concatenate([[0.0], mass])[on]


#: Whether two texts can be a link whose first shared shingle this is. Texts without
#: repeated shingles have equal weights, and their probability Jaccard is the plain one.
_POSSIBLE = """least(rest_p, rest_q) >= {0} * (size_p + size_q - least(rest_p, rest_q)) - 1e-6
    or (not (even_p and even_q) and least(mass_p, mass_q) >= {0} - 1e-6)"""


def _sets(batch: pa.RecordBatch, hashes: _Hashes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    with np.errstate(over="ignore"):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield key, *weighted(shingles(_words(text.as_py()), hashes, k))


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes, total = _Hashes(), np.zeros(CELLS, np.int64)
    for batch in slices(batches):
        for _, found, _ in _sets(batch, hashes, k):
            np.add.at(total, (found % _U(CELLS)).astype(np.int64), 1)
    cells = np.flatnonzero(total)
    yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in slices(batches):
        for node, found, weights in _sets(batch, hashes, k):
            key, rest, mass = prefix(found, weights, counts, threshold)
            n = len(key)
            columns = [pa.array(key.view(np.int64)), pa.array(np.full(n, node, np.int64)), pa.array(rest.astype(np.int64)), pa.array(mass), pa.array(np.full(n, len(found), np.int64)), pa.array(np.full(n, weights.max() == weights.min()))]
            yield pa.record_batch(columns, names=["key", "id", "rest", "mass", "size", "even"])


def _nodes(docs: DataFrame, bands: int, rows: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest, content`` of texts with words, and ``id, content, doc_id, digest, keys`` of different ones.

    A node's own text is that of its least ``(doc_id, digest)``. Node ids are
    numbers given to the written rows: no two contents share one.
    """
    kinds = "doc_id long, digest long, content binary, keys array<long>"
    t = texts(docs).where("doc_id is not null").withColumn("digest", _digest())
    signed = materialise(t.mapInArrow(lambda it: _sign(it, bands, rows, k), kinds), "signed")
    node = signed.groupBy("content").agg(F.min(F.struct("doc_id", "digest")).alias("own"), F.first("keys").alias("keys"))
    node = node.select(F.monotonically_increasing_id().alias("id"), "content", "own.doc_id", "own.digest", "keys")
    return signed.drop("keys"), materialise(node, "node")


def _components(docs: DataFrame, node: DataFrame, k: int, threshold: float) -> DataFrame:
    """``id, comp`` of linked nodes."""
    body = None

    def text_of(ids: DataFrame) -> DataFrame:
        """``id, text`` of some nodes; the texts of nodes that meet others are read once."""
        return body.join(small(ids), "id", "left_semi")

    def describe(ids: DataFrame) -> None:
        nonlocal body
        own = node.join(small(materialise(ids, "ids")), "id", "left_semi").select("id", "doc_id", "digest")
        t = texts(docs).where("doc_id is not null").withColumn("digest", _digest())
        found = t.join(small(materialise(own, "own")), ["doc_id", "digest"]).select("id", "text")
        body = materialise(found.dropDuplicates(["id"]), "texts", compression="zstd")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        own = text_of(ids)
        both = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = both.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _compare(it, k, threshold), "a long, b long")

    def finer(ids: DataFrame) -> DataFrame:
        """Rare shingles of which any two texts that are a link share one."""
        own = text_of(ids).select("id", "text")
        counts = np.zeros(CELLS, np.int64)
        for r in own.mapInArrow(lambda it: _count(it, k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
            counts[r.column(0).to_numpy()] = r.column(1).to_numpy()
        held = own.sparkSession.sparkContext.broadcast(counts)
        kinds = "key long, id long, rest long, mass double, size long, even boolean"
        return own.mapInArrow(lambda it: _prefixes(it, held.value, k, threshold), kinds)

    return link_buckets(node.select("id", "keys"), verify, finer=finer, finer_keep=_POSSIBLE.format(threshold), describe=describe)


def _digest() -> Column:
    return F.xxhash64("text", F.length("text"))


def _classed(docs: DataFrame, bands: int, rows: int, k: int, threshold: float) -> DataFrame:
    """``doc_id, digest, class_id, head`` of texts with words, written; ``head``: the class's own text."""
    signed, node = _nodes(docs, bands, rows, k)
    comps = _components(docs, node, k, threshold)
    own = F.struct("doc_id", "digest")
    named = node.select("content", "id", own.alias("own")).join(small(materialise(comps, "comps")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = materialise(named.select("content", "comp", "own"), "named")
    least = materialise(named.groupBy("comp").agg(F.min("own").alias("own"), F.count("*").alias("n")).where("n > 1").select("comp", F.col("own").alias("least")), "least")
    named = materialise(named.join(small(least), "comp", "left").select("content", F.coalesce("least", "own").alias("least")), "named")
    found = signed.groupBy("doc_id", "digest", "content").agg(F.count("*").alias("copies")).join(named, "content")
    found = found.select("doc_id", "digest", F.col("least.doc_id").alias("class_id"), F.col("least").eqNullSafe(own).alias("head"))
    return materialise(found, "classed")


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, kept``: a row for each document, that is, each different (id, text).

    ``class_size`` counts a class's documents. Where an id has several texts,
    each is a document of its own, and of one class one of them is kept.
    """
    whole = _classed(docs, bands, rows, k, threshold)
    sizes = whole.groupBy("class_id").agg(F.count("*").alias("class_size"))
    sizes = materialise(sizes.where("class_size > 1"), "sizes")
    out = texts(docs).select("doc_id", _digest().alias("digest")).distinct().join(whole, ["doc_id", "digest"], "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id")).join(small(sizes), "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("head", F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are not their class's first, all columns unchanged.

    A document goes by its id and its text, so another text under the same id stays.
    """
    gone = _classed(docs, bands, rows, k, threshold).where("not head").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    gone = small(materialise(gone, "gone"))
    text = F.coalesce(docs["text"], F.lit(""))
    match = (docs["doc_id"] == gone["__id"]) & (F.xxhash64(text, F.length(text)) == gone["__digest"])
    return docs.join(gone, match, "left_anti")
