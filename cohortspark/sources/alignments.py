"""Aligned reads from BAM and SAM files as the relation ``schemas.READS``.

BAM files are read with Spark's binary reader, a row for each file, and decoded
in Python on the executors: blocks are inflated one after another and records
leave in Arrow batches, so a file's decoded form is never held. CRAM needs a
native library and is refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import READS

# Fixed values of the format: CIGAR operations, 4-bit bases, sizes of integer tag types.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
INTEGERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
SIZES = {"A": 1, "f": 4} | {k: struct.calcsize(v) for k, v in INTEGERS.items()}
_PAIRS = [a + b for a in BASES for b in BASES]


def inflate(raw: bytes) -> Iterator[bytes]:
    """The content of each gzip member of a blocked file."""
    while raw:
        stream = zlib.decompressobj(31)
        yield stream.decompress(raw)
        raw = stream.unused_data if not stream.eof or stream.unused_data else b""


def _blocks(raw: memoryview) -> Iterator[bytes]:
    """Like :func:`inflate`, by the block sizes that the members' headers state."""
    at = 0
    while at + 18 <= len(raw):
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        field, size = at + 12, None
        while field < at + 12 + extra:
            one, two, n = struct.unpack_from("<BBH", raw, field)
            if (one, two) == (66, 67):
                size = struct.unpack_from("<H", raw, field + 4)[0] + 1
            field += 4 + n
        if size is None:
            yield from inflate(bytes(raw[at:]))
            return
        yield zlib.decompress(raw[at + 12 + extra : at + size - 8], -15)
        at += size


class _Reader:
    """Bytes from an iterator of blocks."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            block = next(self.blocks, None)
            if block is None:
                break
            parts.append(block)
            have += len(block)
        data = b"".join(parts) if len(parts) > 1 else parts[0]
        self.held = data[n:]
        return data[:n]


def sample_of(header: str) -> str:
    """The first sample that a read group names."""
    for line in header.splitlines():
        if line.startswith("@RG"):
            for field in line.split("\t")[1:]:
                if field.startswith("SM:"):
                    return field[3:]
    raise ValueError("no read group names a sample (SM)")


def _tags(data: bytes) -> dict[str, int]:
    """Integer tags only."""
    found, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in INTEGERS:
            found[name] = struct.unpack_from(INTEGERS[kind], data, at)[0]
        if kind in SIZES:
            at += SIZES[kind]
        elif kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return {k: v for k, v in found.items() if -(2**31) <= v < 2**31}


def records(raw: bytes) -> Iterator[dict]:
    """Mapped reads of a BAM file in file order."""
    reader = _Reader(_blocks(memoryview(raw)))
    if reader.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    header = reader.take(struct.unpack("<i", reader.take(4))[0]).rstrip(b"\0").decode()
    sample = sample_of(header)
    names = []
    for _ in range(struct.unpack("<i", reader.take(4))[0]):
        names.append(reader.take(struct.unpack("<i", reader.take(4))[0])[:-1].decode())
        reader.take(4)
    ordinal = 0
    while len(size := reader.take(4)) == 4:
        data = reader.take(struct.unpack("<i", size)[0])
        ref, pos, name_size, mapq, _, n_ops, flag, n_seq, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        qname = data[at : at + name_size - 1].decode()
        at += name_size
        ops = struct.unpack_from(f"<{n_ops}I", data, at)
        at += 4 * n_ops
        packed = data[at : at + (n_seq + 1) // 2]
        at += len(packed)
        quals = list(data[at : at + n_seq])
        at += n_seq
        if ref >= 0 and not flag & 0x4:
            yield {
                "sample_id": sample, "read_ordinal": ordinal, "qname": qname, "flag": flag, "chrom": names[ref], "pos": pos, "mapq": mapq, "cigar": "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops),
                "seq": "".join(_PAIRS[b] for b in packed)[:n_seq], "quals": quals, "tlen": tlen, "tags": list(_tags(data[at:]).items()),
            }
        ordinal += 1


_ARROW = pa.schema([("sample_id", pa.string()), ("read_ordinal", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("quals", pa.list_(pa.int32())), ("tlen", pa.int32()), ("tags", pa.map_(pa.string(), pa.int32()))])


def bam(spark: SparkSession, *paths: str, batch: int = 20_000) -> DataFrame:
    if any(p.endswith(".cram") for p in paths):
        raise ValueError("CRAM cannot be decoded without a native library; convert it to BAM")
    files = spark.read.format("binaryFile").load(list(paths)).select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for raw in files.column(0):
                held = []
                for r in records(raw.as_py()):
                    held.append(r)
                    if len(held) == batch:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return files.mapInArrow(decode, READS)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped reads of a text alignment file; the sample is in its header."""
    lines = spark.read.text(path)
    header = lines.where("value like '@RG%'").select(F.regexp_extract("value", r"\tSM:([^\t]+)", 1).alias("s")).where("s != ''").first()
    if header is None:
        raise ValueError("no read group names a sample (SM)")
    rows = lines.where("value not like '@%' and value != ''").select(F.monotonically_increasing_id().alias("read_ordinal"), F.split("value", "\t").alias("f"))
    quals = F.when(F.col("f")[10] == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split(F.col("f")[10], ""), lambda c: F.ascii(c) - 33))
    tags = F.map_from_entries(F.transform(F.filter(F.expr("slice(f, 12, 1000)"), lambda t: t.rlike("^..:i:")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 100).cast("int"))))
    at = lambda i, kind: F.col("f")[i].cast(kind)
    out = rows.select(
        F.lit(header.s).alias("sample_id"), "read_ordinal", F.col("f")[0].alias("qname"), at(1, "int").alias("flag"), F.col("f")[2].alias("chrom"), (at(3, "long") - 1).alias("pos"), at(4, "int").alias("mapq"),
        F.col("f")[5].alias("cigar"), F.upper(F.col("f")[9]).alias("seq"), quals.alias("quals"), at(8, "int").alias("tlen"), tags.alias("tags"),
    )
    return out.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("chrom") != "*"))


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, for provenance columns."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("s")).first().s


def parse_region(text: str) -> tuple[str, int, int]:
    """``chr:start-end``, 1-based and inclusive, as 0-based and half-open."""
    m = re.fullmatch(r"(.+):([\d,]+)-([\d,]+)", text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    return m[1], int(m[2].replace(",", "")) - 1, int(m[3].replace(",", ""))
