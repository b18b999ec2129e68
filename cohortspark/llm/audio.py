"""Audio features of text payloads stored as 8-bit sound.

A payload is a text's UTF-8 bytes, padded with blanks to a positive multiple of
``FRAME_BYTES``. It is stored as a mono 8-bit RIFF/WAVE file, whose samples are
exactly the payload's bytes, and everything else is computed from the stored
bytes read back: the samples are resampled by a polyphase filter (``UP`` /
``DOWN``), cut into overlapped windows, and turned into log-mel energies;
windows of high energy form segments by hysteresis (a segment begins above the
high and ends below the low threshold). Mel frames are stored as fixed-shape
tensors of ``TENSOR_FRAMES`` x ``MELS`` values (Arrow's fixed_shape_tensor over
32-bit floats), each with the time span it covers.

Samples are worked on in blocks, so that memory is bounded whatever a text's
length; block borders depend on frame numbers alone, so equal texts give equal
values. Energies are rounded to 0.1 dB.

Defined results: a null or empty text is one frame of blanks. Rows with a null
or repeated doc_id are treated like all others. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialise, slices, texts

FRAME_BYTES = 192
RATE, UP, DOWN = 12_000, 2, 3
TAPS = 8  # taps of each phase, on either side of a sample half as many
WINDOW, HOP, MELS = 256, 128, 16
TENSOR_FRAMES = 32
BLOCK = 2048  # frames worked on at once
#: Segments begin so many dB above the median energy and end below the lower figure.
HIGH_DB, LOW_DB = 1.0, 0.3


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % FRAME_BYTES if raw else FRAME_BYTES)


def encode(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of one 8-bit channel; an odd number of samples gets the format's pad byte."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def decode(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file by :func:`encode`, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _phases() -> np.ndarray:
    """``(TAPS, UP)`` filters of a windowed sinc that passes what both rates can hold."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    cut = 1.0 / max(UP, DOWN)
    h = np.sinc(cut * n) * cut * UP * np.hanning(TAPS * UP + 2)[1:-1]
    bank = h.reshape(TAPS, UP)[::-1]
    return (bank / bank.sum(axis=0)).astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(30.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


_BANK = _phases()
_HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
_MEL = _mel_bank(RATE * UP / DOWN)


def resampled(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` samples at the new rate from the ``first`` on; zero beyond the ends.

    Output m = UP * q + r lies at input position m * DOWN / UP; its phase picks
    one column of the filter bank, so no zero-stuffed signal is ever made.
    """
    m = np.arange(first, first + count, dtype=np.int64)
    base, phase = m * DOWN // UP, m * DOWN % UP
    lo = int(base[0]) - TAPS // 2 + 1 if count else 0
    hi = int(base[-1]) + TAPS // 2 + 1 if count else 0
    x = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    if b > a:
        x[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128.0) / 128.0
    out = np.empty(count, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    for p in range(UP):
        on = np.flatnonzero(phase == p)
        if len(on):
            start = int(base[on[0]]) - int(base[0])
            out[on] = np.ascontiguousarray(view[start::DOWN][: len(on)]) @ _BANK[:, p]
    return out


def frames(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of log-mel frames in dB, rounded to 0.1."""
    total = -(-len(samples) * UP // DOWN)
    count = 1 + max(0, -(-(total - WINDOW) // HOP))
    for f in range(0, count, BLOCK):
        n = min(BLOCK, count - f)
        y = resampled(samples, f * HOP, (n - 1) * HOP + WINDOW)
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(cut * _HANN, axis=1).astype(np.complex64)) ** 2
        yield np.round(10.0 * np.log10(power @ _MEL + 1e-6), 1).astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames by hysteresis: begun at the high threshold, ended below the low one."""
    mid = np.median(energy)
    state = np.where(energy >= mid + HIGH_DB, 1, np.where(energy < mid + LOW_DB, -1, 0))
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    step = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))


def analyse(media: bytes) -> dict:
    """Tensors, their time spans and the segments of a stored file."""
    raw, rate = decode(media)
    mel = np.concatenate(list(frames(np.frombuffer(raw, np.uint8))))
    hop = HOP * DOWN / (UP * rate)
    energy = np.log10(np.mean(10.0 ** (mel / 10.0), axis=1)) * 10.0
    short = -len(mel) % TENSOR_FRAMES
    tensors = np.concatenate([mel, np.full((short, MELS), -60.0, np.float32)]).reshape(-1, TENSOR_FRAMES, MELS)
    spans = [(i * TENSOR_FRAMES * hop, min(len(mel), (i + 1) * TENSOR_FRAMES) * hop) for i in range(len(tensors))]
    return {"samples": raw, "frames": len(mel), "mel": mel, "tensors": tensors, "spans": spans, "segments": [(a * hop, b * hop) for a, b in segments(np.round(energy, 1))]}


def tensor_array(tensors: np.ndarray) -> pa.ExtensionArray:
    """An Arrow array of fixed-shape tensors from ``(n, TENSOR_FRAMES, MELS)``."""
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS], dim_names=["frame", "mel"])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(tensors, np.float32).ravel()), TENSOR_FRAMES * MELS)
    return pa.ExtensionArray.from_storage(kind, flat)


def packed(found: dict) -> bytes:
    """An Arrow stream with a row for each tensor: ``part, start_s, stop_s, tensor`` (fixed-shape)."""
    n = len(found["tensors"])
    columns = {"part": pa.array(range(n), pa.int32()), "start_s": pa.array([a for a, _ in found["spans"]], pa.float64()), "stop_s": pa.array([b for _, b in found["spans"]], pa.float64()), "tensor": tensor_array(found["tensors"])}
    rows = pa.record_batch(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(stream: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensors ``(n, TENSOR_FRAMES, MELS)`` of a stream by :func:`packed` and their time spans."""
    rows = pa.ipc.open_stream(stream).read_all().combine_chunks()
    tensor = rows.column("tensor").chunk(0)
    return tensor.to_numpy_ndarray(), list(zip(rows.column("start_s").to_pylist(), rows.column("stop_s").to_pylist(), strict=True))


def _feature(tensors: np.ndarray, spans: list[tuple[float, float]], segments_: list[tuple[float, float]], frames_: int) -> str:
    """A text of what was stored: sizes, time in segments, mean of each mel band, digest of the tensors."""
    mel = tensors.reshape(-1, MELS)[:frames_]
    mean = ",".join(f"{x:.1f}" for x in np.round(mel.mean(axis=0, dtype=np.float64), 1) + 0.0)
    inside = sum(b - a for a, b in segments_)
    sha = hashlib.sha256(np.ascontiguousarray(tensors, np.float32).tobytes()).hexdigest()[:16]
    return f"frames={frames_};tensors={len(tensors)};stop={spans[-1][1]:.3f};segments={len(segments_)};seconds={inside:.3f};mel={mean};sha={sha}"


def extract(media: DataFrame) -> DataFrame:
    """What is computed from the stored files read back, a row for each.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, frames, segments, tensors``: segments in seconds; ``tensors``
    is an Arrow stream (:func:`unpacked`) of fixed-shape tensors with time spans.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments array<struct<start_s: double, stop_s: double>>, tensors binary"
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("stop_s", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span, pa.binary()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "tensors"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, size, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = stored.as_py()
                found = analyse(stored)
                back = found["samples"]
                out.append((key, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), found["frames"], [{"start_s": a, "stop_s": b} for a, b in found["segments"]], packed(found)))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return media.mapInArrow(of, kinds)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` for each row of ``docs(doc_id, text)``, written to the shared folder.

    ``n_bytes`` is the unpadded length in bytes.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.as_py() for t in batch.column(1)]
            sizes = pa.array([len(t.encode("utf-8")) for t in raw], pa.int64())
            yield pa.record_batch([batch.column(0), sizes, pa.array([encode(payload(t)) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return materialise(texts(docs).mapInArrow(of, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def digests(media: DataFrame) -> DataFrame:
    """A row for each stored document: what was read back, and its features from the stored tensors."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    stored = materialise(extract(media), "tensors", compression="zstd")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features = []
            for frames_, own, stream in zip(batch.column("frames").to_pylist(), batch.column("segments").to_pylist(), batch.column("tensors"), strict=True):
                tensors, spans = unpacked(stream.as_py())
                features.append(_feature(tensors, spans, [(x["start_s"], x["stop_s"]) for x in own], frames_))
            yield pa.record_batch([*batch.columns[:7], pa.array(features, pa.string())], names=[*batch.schema.names[:7], "feature"])

    return stored.mapInArrow(of, kinds)
