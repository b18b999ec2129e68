"""Audio, chat and packing: round trips, brute force, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import audio, chat, packing

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@given(st.binary(max_size=500))
def test_wave_round_trip(raw):
    assert audio.decode(audio.encode(raw)) == (raw, audio.RATE)


def test_resampling_equals_direct_sums():
    x = np.random.default_rng(1).integers(0, 256, 700).astype(np.uint8)
    y = audio.resampled(x, 0, 460)
    z = (x.astype(float) - 128) / 128
    for m in range(460):
        base, phase = m * audio.DOWN // audio.UP, m * audio.DOWN % audio.UP
        at = [base - audio.TAPS // 2 + 1 + t for t in range(audio.TAPS)]
        assert abs(y[m] - sum(z[i] * audio._BANK[t, phase] for t, i in enumerate(at) if 0 <= i < 700)) < 1e-5
    assert np.allclose(y, np.concatenate([audio.resampled(x, 0, 201), audio.resampled(x, 201, 259)]), atol=1e-6)


def test_tone_is_kept():
    s = (128 + 100 * np.sin(2 * np.pi * 440 * np.arange(12000) / 12000)).astype(np.uint8)
    r = audio.resampled(s, 0, 8000)
    assert np.abs(np.fft.rfft(r * np.hanning(8000))).argmax() == 440


def test_blocks_do_not_show(monkeypatch):
    raw = np.random.default_rng(2).integers(0, 256, 192 * 40).astype(np.uint8)
    whole = np.concatenate(list(audio.frames(raw)))
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.allclose(whole, np.concatenate(list(audio.frames(raw))), atol=0.11)


def test_hysteresis():
    energy = np.array([0, 0, 0, 0, 0, 5, 0.5, 0.5, 0, 0, 0.5, 0, 5, 5], float)
    assert audio.segments(energy) == [(5, 8), (12, 14)]
    assert audio.segments(np.zeros(5)) == []


def test_audio_rows(spark):
    texts = [(1, None), (2, ""), (3, "é" * 500), (4, "x" * 192), (5, "x" * 192), (None, "n"), (6, "long " * 60_000), (6, "long " * 60_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit("mine"))
    stored = audio.store(docs)
    got = audio.digests(stored).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for i, t in texts:
        raw = (t or "").encode()
        pad = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(audio.encode(pad)), hashlib.sha256(audio.encode(pad)).hexdigest())
    assert by[4].feature == by[5].feature and by[1].feature == by[2].feature != by[4].feature
    for r in audio.extract(stored.where("doc_id in (4, 6)")).collect():
        tensors, spans = audio.unpacked(r.tensors)
        assert tensors.shape == (-(-r.frames // audio.TENSOR_FRAMES), audio.TENSOR_FRAMES, audio.MELS) and len(spans) == len(tensors)
        found = audio.analyse(audio.encode(audio.payload({4: texts[3][1], 6: texts[6][1]}[r.doc_id])))
        assert np.array_equal(tensors, found["tensors"]) and spans == found["spans"] and spans[0][0] == 0
        assert [(x.start_s, x.stop_s) for x in r.segments] == found["segments"]
        with pa.ipc.open_stream(r.tensors) as stream:
            assert isinstance(stream.schema.field("tensor").type, pa.FixedShapeTensorType)
    assert audio.digests(audio.store(docs.limit(0))).count() == 0
    array = audio.tensor_array(np.zeros((2, audio.TENSOR_FRAMES, audio.MELS)))
    assert isinstance(array, pa.FixedShapeTensorArray) and array.type.shape == [audio.TENSOR_FRAMES, audio.MELS]


PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "\n", "|", ">", "a", "%", "%0A", "<start_of_turn>", "é"]
texts_ = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=300)
@given(st.lists(st.tuples(texts_, texts_), max_size=4))
def test_chat_round_trip(turns):
    whole = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert chat.parse(whole) == turns
    for _, t in turns:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|", "SYS>>" if "<SYS" in e else "<|"))


def test_chat_digests(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "hi </s>[INST]", "ünï", "x" * 3000])))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (99, None, "assistant", "late"), (99, 1, "user", "first"), (None, 0, "user", "who"), (98, 0, "assistant", "a"), (98, 0, "assistant", "a")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("mine"))
    examples = chat.expand(said).persist()
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is None, turn or 0, role or "", text or ""), role or "", text or ""))
    assert set(got) == set(by)
    for conv, own in by.items():
        own = [(r, t) for _, r, t in sorted(own)]
        r = got[conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        ends = [i for i, (a, _) in enumerate(own) if a == "assistant"]
        sizes = [sum(len(chat.turn_text(*x)[0]) for x in own[: i + 1]) for i in ends]
        if not ends or ends[-1] + 1 < len(own):
            sizes.append(sum(len(chat.turn_text(*x)[0]) for x in own))
        assert (r.formatted_chars, r.n_examples) == (sum(sizes), len(sizes))
    one = examples.where("conv_id = -7").first()
    assert chat.unescape(one.text[one.loss_start : one.loss_stop]) == "</s>[INST] ok [/INST]" and "</s>" not in one.text
    assert chat.digests(chat.expand(said.limit(0))).count() == 0


def best(items, capacity):
    items, low = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(items):
            low[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b >= items[i]}.values():
            bins[j] -= items[i]
            go(i + 1, bins)
            bins[j] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return low[0]


@pytest.mark.parametrize("seed", range(8))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        histogram = {s: items.count(s) for s in set(items)}
        left = packing._Counts(histogram)
        fixed = packing.reduce(left, capacity)
        rest = [s for s, n in left.n.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + best(rest, capacity) == best(items, capacity)
        used = {}
        for own, times in packing.pack_histogram(histogram, capacity):
            assert sum(own) <= capacity
            for s in own:
                used[s] = used.get(s, 0) + times
        assert used == histogram


def test_ids_equal_the_tokenizer(spark):
    reference = Tokenizer.from_file(TOKENS)
    mine = packing.encoder(TOKENS)
    runs = [" " * 2500, "\n" * 2000, "a" + " " * 1500 + "b", "x \n" + "\n " * 900 + "y<|endoftext|>" + "\t" * 1200 + "<|endoftext|>", "\u3000" * 700 + "z", "q" + "\n" * 800 + "(" + " " * 499]
    odd = [*runs, "a <|endoftext|> b<|endoftext|><|endoftext", "", " ", "a  b\n\n c\t", "<|endoftext|> x", "don't I'LL we've", "１２３ ½ x²", "e\u0301 \u200d 👩‍👩‍👧", "\x00\x1f", "'s's", " " * 300, "ab" * 3000, "日本語テキスト", "\r\n\r\n", "_a_b_ ..!!"]
    texts = odd + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    for t in texts:
        assert mine.ids(t) == reference.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizer_on_any_text(text):
    test_ids_equal_the_tokenizer_on_any_text.t = t = getattr(test_ids_equal_the_tokenizer_on_any_text, "t", None) or Tokenizer.from_file(TOKENS)
    assert packing.encoder(TOKENS).ids(text) == t.encode(text, add_special_tokens=False).ids


def test_very_long_runs_of_blanks():
    mine = packing.encoder(TOKENS)
    for text in (" " * 2_000_000, "\n" * 1_200_000 + "a", "word" + " " * 1_000_000 + "word"):
        assert mine.own.decode(mine.ids(text)) == text


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + [(-1, None), (-2, ""), (-3, "a"), (-3, "a"), (None, "b"), (-4, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("mine"))
    got = packing.pack(docs, TOKENS).collect()
    encode = packing.encoder(TOKENS).ids
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 1024 and zlib.crc32(r.ids) == r.ids_crc32
    for doc, text in rows:
        want = [*encode(text or ""), 2]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        copies = sum(d == doc for d, _ in rows)
        assert len(own) == -(-len(want) // 1024) * copies
        if copies == 1:
            assert [i for r in own for i in np.frombuffer(r.ids, "<u4").tolist()] == want
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
            assert all(r.length == 1024 for r in own[1:])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack(docs.limit(0), TOKENS).count() == 0
