"""The pipeline's stages against brute force, each on what its predecessor kept."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import minhash, mixing, packing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.where("length(text) > 400").limit(3).collect()
    odd = [(None, None), (None, some[0].text), (90001, None), (90001, some[1].text), (90001, some[2].text + " "), (90001, some[2].text), (90002, ""), (90003, " \n"), (90004, "\n" * 3000), (90005, "a <|endoftext|> b " * 900), (90006, some[0].text), (90006, some[0].text)]
    more = spark.createDataFrame([(i, t, "en", "s", None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    whole = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(more)
    whole.withColumns({"kept": F.lit("mine"), "bucket": F.lit(1), "rate": F.lit(0.5), "a.b": F.lit("x")}).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


def count(df):
    return Counter(tuple(r) for r in df.collect())


def test_every_stage(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept, folder)
        before, after = kept.collect(), made.collect()
        if name != "packing":
            assert made.columns == kept.columns
        if name == "quality classifier":
            weights, bias = quality.fit(docs, labels)
            codes = quality._Codes()
            good = []
            for r in before:
                tokens = quality._TOKEN.findall(r.text or "")
                z = bias + (weights[quality.features(tokens, codes)].sum(dtype=np.float64) * quality.SCALE / len(tokens) if tokens else 0.0)
                good += [r] if 1 / (1 + np.exp(-z)) >= quality.THRESHOLD else []
            assert Counter(map(tuple, after)) == Counter(map(tuple, good))
        elif name == "exact dedup":
            bare = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
            best = {}
            for r in before:
                best[bare(r)] = max(best.get(bare(r), (0, False, 0)), (len(r.text or ""), r.doc_id is not None, -(r.doc_id or 0)))
            assert Counter((len(r.text or ""), r.doc_id is not None, -(r.doc_id or 0)) for r in after) == Counter(best.values())
        elif name == "near dedup":
            hashes = minhash._Hashes()
            with np.errstate(over="ignore"):
                sets = [minhash.weighted(minhash.shingles(minhash._words(r.text or ""), hashes)) for r in before]
            root = list(range(len(before)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in itertools.combinations(range(len(before)), 2):
                if before[a].doc_id is not None and before[b].doc_id is not None and len(sets[a][0]) and len(sets[b][0]) and minhash.similarity(sets[a], sets[b]) >= 0.8:
                    root[find(a)] = find(b)
            classes = {}
            for i, r in enumerate(before):
                classes.setdefault(find(i), []).append(r.doc_id)
            first = lambda ids: min(ids, key=lambda x: (x is None, x or 0))
            assert Counter(r.doc_id for r in after) == Counter(first(own) for own in classes.values())
        elif name == "mixing":
            rated = mixing.mix(kept, labels, corpus_pipeline.TARGET).collect()
            rates = {}
            for r in rated:
                rates.setdefault(r.doc_id, []).append(r.rate)
            got = Counter(r.doc_id for r in after)
            for doc, own in rates.items():
                assert sum(map(np.floor, own)) <= got[doc] <= sum(np.floor(x) + 1 for x in own)
            assert not Counter(map(tuple, after)).keys() - Counter(map(tuple, before)).keys()
        else:
            ids = packing.encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).ids
            assert sum(r.length for r in after) == sum(len(ids(r.text or "")) + 1 for r in before)
            places = {}
            for r in after:
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for own in places.values():
                ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
                assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
        spark.createDataFrame(after, made.schema).coalesce(2).write.parquet(f"{folder}/{name.replace(' ', '-')}")
        kept = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == kept.columns
    assert count(whole.select("doc_id", "piece", "length", "ids_crc32")) == count(kept.select("doc_id", "piece", "length", "ids_crc32"))


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
