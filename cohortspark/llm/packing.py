"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any number of
pieces is a histogram of at most ``capacity`` counts. The reduction fixes item
sets that provably dominate every alternative for their largest item, as often
as the counts allow; best-fit in falling length places the remainder. Both work
on counts and give patterns (lengths, times), whose number does not grow with
the corpus. Pieces are then dealt to the patterns' places by their rank among
the pieces of their length: partition counts and running sums, no global sort.

Token ids are those of the ``tokenizers`` library for a byte-level BPE file, in
its default setting: strings of special tokens are those tokens. The end id
follows. Ids are computed with ``tiktoken`` from the same file's vocabulary, which
gives equal ids (tests compare them) in a quarter of the time. A run of more than
``RUN`` blanks is cut out before the pattern sees it, at the place where the
pattern would cut: all but its last one are a token run of their own, since the
pattern's recursion has no bound on such runs.

Defined results: a null or empty text is one piece of the end id alone. Rows
with a null or repeated doc_id are packed like all others, each row its own
pieces. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, slices, texts

CAPACITY, END = 1024, 2
_ENCODERS: dict[str, Encoder] = {}

# How byte-level BPE files split text, and the bytes they write as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


# The characters that the pattern's blank class stands for.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 500


class Encoder:
    """Ids of the byte-level BPE file at ``path``."""

    def __init__(self, path: str):
        import tiktoken

        shown = [b for lo, hi in PRINTED for b in range(lo, hi + 1)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.own = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.run = re.compile(f"[{BLANK}]{{{RUN},}}")

    def ids(self, text: str) -> list[int]:
        if not self.run.search(text):
            return self.own.encode(text, allowed_special="all", disallowed_special=())
        out: list[int] = []
        for part in self.names.split(text) if self.names else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            at = 0
            for m in self.run.finditer(part):
                out += self.own.encode_ordinary(part[at : m.start()])
                at = m.end() if m.end() == len(part) else m.end() - 1
                out += self.own._encode_single_piece(part[m.start() : at])
            out += self.own.encode_ordinary(part[at:])
        return out


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).ids
    part, dealt = TaskContext.get().partitionId(), {}
    for batch in slices(batches):
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encode(text.as_py()), end], "<u4")
            first = (len(ids) - 1) % capacity + 1
            at = 0
            for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                own = ids[at:stop]
                nth = dealt[len(own)] = dealt.get(len(own), -1) + 1
                out.append((doc, piece, at, len(own), zlib.crc32(own.tobytes()), part, nth, own.tobytes() if with_ids else None))
                at = stop
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.record_batch(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])


class _Counts:
    """Counts by length with the lengths still present in order."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {s: c for s, c in histogram.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, times: int) -> None:
        self.n[size] -= times
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def put(self, size: int, times: int) -> None:
        if size not in self.n:
            self.n[size] = 0
            insort(self.order, size)
        self.n[size] += times

    def at_most(self, size: int) -> int:
        """The largest length present up to ``size``, or 0."""
        i = bisect_left(self.order, size + 1)
        return self.order[i - 1] if i else 0

    def least(self, k: int) -> list[int]:
        """The k shortest items."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out


def _best_with(left: _Counts, room: int) -> tuple[int, ...] | None:
    """Items that beside the item being placed dominate every other choice within ``room``.

    One set dominates another if the other's items can be dealt into groups,
    each no longer than an item of the first.
    """
    one = left.at_most(room)
    if not one:
        return ()
    if one == room:
        return (one,)  # any other choice fits into this item's place
    few = left.least(3)
    if len(few) < 2 or few[0] + few[1] > room:
        return (one,)  # no second item fits, and this is the longest
    if len(few) == 3 and sum(few) <= room:
        return None  # three items fit: nothing is proved
    left.take(one, 1)
    two = left.at_most(room - one)
    left.put(one, 1)
    if not two:
        return None
    # the longest that the shorter of two items can be in any choice
    short = 0
    for s in reversed(left.order):
        if 2 * s <= room and (left.n[s] > 1 or left.at_most(room - s) > s):
            short = s
            break
    return (one, two) if two >= short else None


def reduce(left: _Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, from the longest item down; ``left`` keeps the rest."""
    fixed = []
    for size in sorted(left.order, reverse=True):
        while size in left.n:
            left.take(size, 1)
            best = _best_with(left, capacity - size)
            left.put(size, 1)
            if best is None:
                break
            bin_ = (size, *best)
            # taking items away only shrinks the alternatives: the proof holds until one runs out
            times = min(left.n[s] // bin_.count(s) for s in set(bin_))
            for s in bin_:
                left.take(s, times)
            fixed.append((bin_, times))
    return fixed


def best_fit(left: _Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit in falling length, whole groups of equal bins at a time."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def add(room: int, items: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((items, times))

    for size in sorted(left.order, reverse=True):
        todo = left.n[size]
        while todo:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                items, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, items, times = capacity, (), todo
            each = room // size
            full = min(times, todo // each)
            rest = todo - full * each if full < times else 0
            if full:
                add(room - each * size, (*items, *[size] * each), full)
            if rest:
                add(room - rest * size, (*items, *[size] * rest), 1)
            if items and times - full - bool(rest):
                add(room, items, times - full - bool(rest))
            todo -= full * each + rest
    return [x for group in open_.values() for x in group]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use every item of ``histogram`` once."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    left = _Counts(histogram)
    return reduce(left, capacity) + best_fit(left, capacity)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, items in a sequence, offset of the first."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for items, times in patterns:
        at = 0
        for s in sorted(set(items), reverse=True):
            q = items.count(s)
            rows.setdefault(s, []).append((ranks.get(s, 0), base, q, at))
            ranks[s] = ranks.get(s, 0) + q * times
            at += q * s
        base += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in rows.items()}


def _deal(batches: Iterator[pa.RecordBatch], places: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            on = np.flatnonzero(length == s)
            first, base, q, at = places[int(s)]
            i = np.searchsorted(first, rank[on], side="right") - 1
            within = rank[on] - first[i]
            sequence[on] = base[i] + within // q[i]
            offset[on] = at[i] + within % q[i] * s
        keep = [c for c in batch.schema.names if c != "rank"]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """A row for each piece of ``docs(doc_id, text)``: where it is cut and placed.

    ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``; ``ids``
    (little-endian unsigned 32-bit) is null unless ``with_ids``. A text of more
    than ``capacity`` ids is cut into pieces of that many, the first being the
    shorter one.
    """
    t = texts(docs)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary"
    cut = materialise(t.mapInArrow(lambda it: _pieces(it, path, capacity, end, with_ids), kinds), "pieces")
    counts = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(pack_histogram(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "part"])
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    ranked = ranked.select(*own, (F.col("before") + F.col("nth")).alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _deal(it, places), kinds)
