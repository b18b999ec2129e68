"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, then the turn itself, whose text alone is trainable. A turn is written
``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break.
Control strings inside texts and roles are broken by a backslash after their
first character (one more if there are some already), which is undone exactly.

Turns after the last assistant turn, and conversations without one, are kept in
an example without a trainable span, so the output holds every turn.

Defined results: turns are ordered by turn (nulls last), then role and text; a
null text or role is empty. Repeated rows are turns of their own. Rows with a
null conv_id are one conversation. An empty table gives no examples. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, STOP = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
# What follows the first character of a control string of common chat templates.
_AFTER = {"<": [r"\|", r"/?s>", r"/?SYS>>", r"(?:start|end)_of_turn>"], "[": [r"/?INST\]"]}
_CONTROL = "|".join(f"{re.escape(a)}{{}}(?={'|'.join(b)})" for a, b in _AFTER.items())
_FREE = re.compile("(" + _CONTROL.replace("{}", r"\\*") + ")")
_HELD = re.compile("(" + _CONTROL.replace("{}", r"\\+") + ")")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _FREE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _HELD.sub(lambda m: m[0][:-1], text)


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text begins and ends."""
    head = f"{START}{_role_out(role)}\n"
    body = escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example; an error if anything else is in it."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"stray text at {at}")
        turns.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"stray text at {at}")
    return turns


_KINDS = "conv_id long, example int, turns int, text string, loss_start long, loss_stop long, last boolean"
_NAMES = ["conv_id", "example", "turns", "text", "loss_start", "loss_stop", "last"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, turns, text, loss_start, loss_stop, last``: one row for each example.

    The loss span is in code points of ``text`` and null in an example that only
    keeps closing turns; ``last`` marks the example that holds all turns. A
    conversation's rows are sorted in one partition and read as a stream; only
    its formatted text so far, which the next example repeats, is held.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        conv, prefix, chars, turns, n, held = object(), [], 0, 0, 0, None

        def close() -> None:
            nonlocal held
            if held is not None:
                if turns > held[2]:  # closing turns: an example of their own
                    out.append((*held, False))
                    out.append((conv, n, turns, "".join(prefix), None, None, True))
                else:
                    out.append((*held, True))
            elif turns:
                out.append((conv, n, turns, "".join(prefix), None, None, True))
            held = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
            made = pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)
            out.clear()
            return made

        for batch in slices(batches):
            for key, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != conv:
                    close()
                    conv, prefix, chars, turns, n = key, [], 0, 0, 0
                own, a, b = turn_text(role, text)
                prefix.append(own)
                turns += 1
                if role == TRAINED:
                    if held is not None:
                        out.append((*held, False))
                    prefix = ["".join(prefix)]
                    held = (key, n, turns, prefix[0], chars + a, chars + b)
                    n += 1
                    size += len(prefix[0])
                chars += len(own)
                if size > 4_000_000:
                    yield flush()
                    size = 0
        close()
        yield flush()

    return rows.mapInArrow(of, _KINDS)


def digests(examples: DataFrame) -> DataFrame:
    """A row for each conversation, from the written examples alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples``.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for conv, example, _, text, a, b, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest() if last else None
                out.append((conv, example, len(turns), sha, "" if a is None else unescape(text[a:b]), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "example", "n", "sha", "loss", "chars"])

    read = examples.mapInArrow(of, "conv_id long, example int, n long, sha string, loss string, chars long")
    losses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    one = read.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), losses.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return one.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
