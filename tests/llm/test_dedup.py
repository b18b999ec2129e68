"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import exact_dedup, groups, lines, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


ODD = [(5, "a b"), (1, "ab"), (2, "a  b\n"), (3, ""), (4, None), (7, " \t"), (8, "other"), (9, "é e"), (10, "ée"), (11, "ab"), (11, "ab"), (None, "nobody"), (None, None)]


def test_exact_decisions(spark):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decisions(docs(spark, ODD)).collect()]
    bare = [(i, len(t or ""), re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in ODD]
    want = []
    for i, _, b in bare:
        own = [(j, n) for j, n, c in bare if c == b]
        keep = min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        want.append((i, keep, len(own), keep == i, hashlib.sha256(b.encode()).hexdigest()))
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)


def test_exact_shards_agree(spark, monkeypatch):
    rows = [(i, f"text {i % 40}" if i % 3 else f"alone {i}") for i in range(200)]
    one = {tuple(r) for r in exact_dedup.decisions(docs(spark, rows)).collect()}
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 30)
    assert {tuple(r) for r in exact_dedup.decisions(docs(spark, rows)).collect()} == one


def test_exact_keeps_columns(spark):
    extra = docs(spark, [r for r in ODD if r[0] is not None]).withColumns({"kept": F.lit("mine"), "r": F.lit(1), "sha": F.lit("x"), "a.b": F.lit(2)})
    out = exact_dedup.deduplicate(extra)
    assert out.columns == extra.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 8, 9]
    again = docs(spark, [(0, "same text"), (1, "same text"), (1, "only here"), (None, "same text"), (None, "x  y"), (None, "xy")])
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.deduplicate(again).collect()) == [("0", "same text"), ("1", "only here"), ("None", "x  y")]
    assert exact_dedup.deduplicate(extra.limit(0)).count() == 0
    assert exact_dedup.decisions(extra.limit(0)).count() == 0


def prose(rng, n):
    return [f"w{rng.randint(0, 4000)}" for _ in range(n)]


def near_rows(seed=1):
    rng = random.Random(seed)
    rows, at = [], 0
    for g in range(25):
        base = prose(rng, rng.choice([30, 120, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, len(words) // 12])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            rows.append((at, " ".join(words) + ("." if g % 2 else "")))
            at += 1
    common = " ".join(prose(rng, 60))
    rows += [(at + i, common + " " + " ".join(prose(rng, 60))) for i in range(12)]
    return rows + [(900, ""), (901, None), (902, "one two"), (903, "One, two!"), (904, "..."), (905, "huge " * 3000)]


def brute_classes(rows):
    hashes = minhash._Hashes()
    sets = {i: minhash.weighted(minhash.shingles(minhash._words(t or ""), hashes)) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a][0]) and len(sets[b][0]) and minhash.similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.fixture(autouse=True)
def quiet():
    with np.errstate(over="ignore"):
        yield


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_edges(spark):
    rows = near_rows()[:8] + [(3, near_rows()[3][1]), (None, "a b c d e f g"), (None, None)]
    table = docs(spark, rows).withColumns({"class_id": F.lit("mine"), "bucket": F.lit(1)})
    out = minhash.deduplicate(table)
    assert out.columns == table.columns and out.where("doc_id is null").count() == 2
    assert minhash.classes(table.limit(0)).count() == 0
    got = minhash.classes(table)
    assert got.where("doc_id is not null").count() == len({r for r in rows if r[0] is not None})
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.where("doc_id is not null").collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_one_large_family_of_near_copies(spark, seed):
    """Copies of similarities 0.2 to 0.95 to their origin and to each other, with and without the origin."""
    rng = random.Random(seed)
    base, rows = prose(rng, 90), []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 20])):
            words[at] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    rows = [r for r in rows if seed % 2 or r[1] != " ".join(base)]
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_rows_of_one_id_with_different_texts(spark):
    rows = near_rows()
    copy = rows[0][1]
    table = docs(spark, [(0, copy), (1, copy), (1, "quite another text than the one above"), (2, ""), (2, copy), (2, copy), (3, copy + " end")])
    out = sorted((r.doc_id, r.text) for r in minhash.deduplicate(table).collect())
    assert out == [(0, copy), (1, "quite another text than the one above"), (2, "")]
    assert minhash.classes(table).count() == 6


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    els = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = (np.sort(els[:45]), rng.uniform(0.5, 4, 45)), (np.sort(els[10:]), rng.uniform(0.5, 4, 50))
    exact = minhash.probability_jaccard(a, b)
    slow = sum(1 / sum(max(_w(a, e) / _w(a, d), _w(b, e) / _w(b, d)) for e in els) for d in els if _w(a, d) and _w(b, d))
    assert abs(exact - slow) < 1e-12
    m = 4096
    x, y = minhash.signatures([a[0], b[0]], [a[1], b[1]], m)
    assert abs((x == y).mean() - exact) < 4 * (exact * (1 - exact) / m) ** 0.5


def _w(s, e):
    i = np.searchsorted(s[0], e)
    return s[1][i] if i < len(s[0]) and s[0][i] == e else 0.0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_line_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), "z") if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        rows.append((a, "".join(b), rng.randint(0, 30)))
    for _ in range(60):  # several pieces, edited or repeating themselves
        a = " ".join(rng.choice(["ab", "ünd", "xyz", "same"]) for _ in range(rng.randint(0, 200)))
        b = list(a if rng.random() < 0.8 else a[: len(a) // 2] * 2)
        for _ in range(rng.randint(0, 40)):
            b.insert(rng.randint(0, len(b)), "z") if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        rows.append((a, "".join(b), rng.randint(0, 60)))
    df = spark.createDataFrame(rows, "x string, y string, most int")
    above = df.select(F.transform(F.array(F.struct("x", "y")), lambda p: lines._at_most(p))[0].alias("c"), F.levenshtein("x", "y").alias("d")).collect()
    assert all(r.c >= r.d for r in above) and sum(r.c <= 2 * r.d for r in above) > 100
    got = df.select(lines._close("x", "y", "most").alias("c"), (F.levenshtein("x", "y") <= F.col("most")).alias("w")).collect()
    assert all(r.c == r.w for r in got)


def test_simhash(spark):
    forms = [(1, "the cat sat on the mat"), (2, "a"), (3, " ".join(f"w{i}" for i in range(300))), (4, "a b"), (5, "a b c d"), (6, " ".join(f"v{i}" for i in range(127))), (7, " ".join(f"v{i}" for i in range(129)))]
    words = sorted({w for _, f in forms for w in f.split()})
    h = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = {}
    for i, f in forms:
        own = [h[w] for w in set(f.split())]
        first = min(own, key=lambda x: x - (x >> 63 << 64))  # the least as a signed number
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) + (first >> b & 1) > len(own))
    got = {r.id: r.simhash & (2**64 - 1) for r in lines.simhashes(spark.createDataFrame(forms, "id long, form string")).collect()}
    assert got == want


def test_keys_of_lines_equal_plain_cuts(spark):
    rng = random.Random(7)
    forms = [" ".join(prose(rng, n)) for n in (1, 2, 9, 10, 11, 21, 30, 47, 100, 170, 700)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, form string")
    got = {r.i: r.n for r in df.select("i", F.size(lines.keys(F.col("form"), F.split("form", " "))).alias("n")).collect()}
    for i, f in enumerate(forms):
        w, cuts = f.split(), set()
        if len(w) <= lines.SHORT:
            cuts = {tuple(w)} | {tuple(w[:k] + w[k + 1 :]) for k in range(len(w))}
            cuts |= {(side, f[:at] if side else f[-at:]) for at in (len(f) // 2, (len(f) + 1) // 2) for side in (0, 1)}
        for t, (low, size, step) in enumerate(lines.TIERS):
            high = lines.TIERS[t + 1][0] if t + 1 < len(lines.TIERS) else 10**9
            if low * 0.9 <= len(w) < high / 0.9:
                at = range(0, (len(w) - 1) // 2 + 1, step)
                cuts |= {(t, 0, k, *w[k : k + size]) for k in at} | {(t, 1, k, *w[len(w) - k - size : len(w) - k]) for k in at}
        assert got[i] == len(cuts)


def meet(spark, pairs):
    """Whether the lines of each pair (kind, words, x, y) meet and pass what is asked before the edit distance."""
    df = spark.createDataFrame(pairs, "kind string, words int, x string, y string").withColumn("i", F.monotonically_increasing_id()).persist()
    both = df.select((F.col("i") * 2).alias("id"), F.col("x").alias("form")).unionByName(df.select((F.col("i") * 2 + 1).alias("id"), F.col("y").alias("form")))
    sim = lines.simhashes(both)
    one = df.join(sim.select((F.col("id") / 2).cast("long").alias("i"), (F.col("id") % 2).alias("side"), "simhash").groupBy("i").agg(F.bit_xor("simhash").alias("apart")), "i")
    share = F.size(F.array_intersect(lines.keys(F.col("x"), F.split("x", " ")), lines.keys(F.col("y"), F.split("y", " ")))) > 0
    short = F.least(F.size(F.split("x", " ")), F.size(F.split("y", " "))) <= lines.SHORT
    return one.select("kind", "words", (share & (short | (F.bit_count("apart") <= lines.BITS))).alias("met")).collect()


def by_length(rows):
    out = {}
    for r in rows:
        size = next(k for k in (8, 16, 32, 64, 10**9) if r.words <= k)
        out.setdefault((r.kind, size), []).append(r.met)
    return {k: (sum(v) / len(v), len(v)) for k, v in out.items()}


def test_recall_of_edited_lines(spark):
    """One place of a line is edited so that its similarity is 0.85 or more: nine in ten meet at every length."""
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(250).collect()]
    forms = sorted({" ".join(re.findall(r"[^\W_]+", x.lower())) for t in texts for x in (t or "").split("\n")})
    pairs = []
    for f in (f for f in forms if len(f) >= 7):
        n, at = len(f.split()), rng.randrange(len(f))
        pairs.append(("changed", n, f, " ".join((f[:at] + "q" + f[at + 1 :]).split())))
        pairs.append(("more", n, f, f[:at] + "q" + f[at:]))
        w = f.split()
        k = rng.randrange(n)
        if n > 1 and len(w[k]) + 1 <= 0.15 * len(f):
            pairs.append(("word less", n, f, " ".join(w[:k] + w[k + 1 :])))
    found = by_length(meet(spark, pairs))
    assert all(share >= 0.9 for share, n in found.values() if n >= 20), found


def test_recall_against_plain_edit_similarity(spark):
    """All pairs of different lines with similarity 0.85 or more, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    form = docs.select(F.explode(F.split("text", "\n")).alias("raw")).select(lines.normalised(F.col("raw")).alias("form")).where("form != ''").distinct()
    form = form.withColumn("n", F.length("form")).withColumn("k", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / 0.85))).cast("int")).repartition(16).persist()
    x = form.select(F.col("form").alias("x"), F.col("n").alias("nx"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    near = x.join(form.select(F.col("form").alias("y"), F.col("n").alias("ny"), "k"), "k").where("x < y and least(nx, ny) >= 0.85 * greatest(nx, ny)")
    near = near.where(F.call_function("levenshtein", "x", "y", F.expr("int(floor(greatest(nx, ny) * 0.15 + 1e-9))")) >= 0).select("x", "y").collect()
    found = by_length(meet(spark, [("any", len(r.x.split()), r.x, r.y) for r in near]))
    assert len(near) > 300 and all(share >= 0.9 for share, n in found.values() if n >= 20), found


def line_rows():
    rng = random.Random(5)
    rows = []
    base = [" ".join(prose(rng, rng.randint(3, 60))) for _ in range(30)]
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            kind = rng.randint(0, 4)
            own.append(line if kind == 0 else line.upper() + "!!" if kind == 1 else line.replace("w1", "w 1", 1) if kind == 2 else line + "s" if kind == 3 else " ".join(prose(rng, 20)))
        rows.append((i, "\n".join(own)))
    return rows + [(50, ""), (51, None), (52, "\n\n..."), (53, base[0] + "\n" + base[0])]


def brute_lines(spark, rows):
    """Links are pairs of forms with a small edit distance, whatever their hashes."""
    spots = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    df = spark.createDataFrame(spots, "doc_id long, line int, raw string").select("doc_id", "line", lines.normalised(F.col("raw")).alias("form")).where("form != ''")
    forms = df.select(F.xxhash64("form").alias("id"), "form").distinct()
    h = forms.collect()
    root = {r.form: r.form for r in h}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for a, b in itertools.combinations(h, 2):
        longer = max(len(a.form), len(b.form))
        if abs(len(a.form) - len(b.form)) <= 0.15 * longer and 1 - distance(a.form, b.form) / longer >= lines.SIMILARITY - 1e-9:
            root[find(a.form)] = find(b.form)
    first, dropped = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.line)):
        c = find(r.form)
        if c in first:
            dropped.setdefault(r.doc_id, []).append(r.line)
        first.setdefault(c, r)
    return dropped


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    got = {r.doc_id: r.dropped for r in lines.summary(docs(spark, rows)).collect()}
    want = brute_lines(spark, rows)
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v} == want
    out = {r.doc_id: r.text for r in lines.deduplicate(docs(spark, rows)).collect()}
    for i, t in rows:
        gone = set(want.get(i, ()))
        assert out[i] == (t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))


def test_lines_edges(spark):
    table = docs(spark, [(None, "a\na"), (1, "x y\nx y"), (1, "x y\nx y")]).withColumn("line", F.lit("mine"))
    assert {(r.doc_id, tuple(r.dropped)) for r in lines.summary(table).collect()} == {(1, (1,))}
    out = lines.deduplicate(table)
    assert out.columns == table.columns and out.where("doc_id is null").first().text == "a\na"
    assert lines.summary(table.limit(0)).count() == 0


def test_lines_of_repeated_rows_and_ids(spark):
    long = " ".join(f"word{i}" for i in range(120))
    same = [(1, long)] * 6 + [(2, "-----\n-----\n" + long), (3, "ha " * 4000), (3, "first text\nonly here"), (3, "other text\nand there")]
    table = docs(spark, same)
    out = sorted((r.doc_id, r.text) for r in lines.deduplicate(table).collect())
    assert out == sorted([(1, long)] * 6 + [(2, "-----\n-----"), (3, "ha " * 4000), (3, "first text\nonly here"), (3, "other text\nand there")])
    assert lines.summary(table).count() == 5
