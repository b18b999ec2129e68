"""Exact deduplication behind a two-pass counting Bloom filter.

Pass one hashes every text and counts how many rows fall on each of its two
filter cells. Pass two keeps the rows both of whose cells were hit more than
once: only these can have a copy, and only these are shuffled by their digest.
All other rows are unique and pass straight through.

The filter is cut into shards by the digest's leading bits so that the cells
of one shard that were hit repeatedly stay below a bound that does not grow
with the corpus; each shard's cells are broadcast by themselves.

Defined results: a null text is empty; texts are compared without the
characters of ``[\\x20\\x09-\\x0D]``, so empty and blank texts are equal. Of
equal texts the row with most code points stays, then the least doc_id; null
ids come last. Rows that repeat one doc_id with equal text are one document:
:func:`decisions` gives each of them the same row. :func:`deduplicate` returns
one row of each text, whatever ids repeat. Columns other than id and text are carried untouched and may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small, texts

#: Filter cells for each row; two are hit by each row.
CELLS_PER_ROW = 16
#: Most rows whose cells make up one shard. About an eighth of the cells are hit twice.
SHARD_ROWS = 4_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")


def _digests(docs: DataFrame) -> DataFrame:
    t = texts(docs)
    bare = normalised(F.col("text"))
    return t.select("doc_id", F.sha2(bare.cast("binary"), 256).alias("sha"), F.length("text").cast("long").alias("chars"))


def _cells(rows: int, shards: int) -> tuple[Column, Column, Column]:
    """Shard and the two cells inside it, all from the digest alone."""
    per_shard = max(64, rows * CELLS_PER_ROW // shards)
    cell = lambda a: F.conv(F.substring("sha", a, 12), 16, 10).cast("long") % per_shard
    return (F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % shards).cast("int"), cell(9), cell(21) + per_shard


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, sha, chars, suspect``, written; suspect: whether the text may occur more than once.

    Digests are written by shard, so that each shard's branch reads its own alone.
    """
    rows = docs.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    shard, one, two = _cells(rows, shards)
    digests = materialise(_digests(docs).withColumn("shard", shard), "digests", "shard" if shards > 1 else None)
    celled = digests.withColumns({"one": one, "two": two})
    hit = celled.select("shard", F.explode(F.array("one", "two")).alias("cell")).groupBy("shard", "cell").count()
    # a cell's number is unique within its shard; both probes have cells of their own
    hit = materialise(hit.where("count > 1").select("shard", "cell"), "bloom", "shard" if shards > 1 else None)
    parts = []
    for k in range(shards):
        cells = small(hit.where(F.col("shard") == k).select("cell"), 4 * SHARD_ROWS)
        part = celled.where(F.col("shard") == k)
        for name in ("one", "two"):
            found = cells.select(F.col("cell").alias(name), F.lit(True).alias(f"hit_{name}"))
            part = part.join(found, name, "left")
        parts.append(part.withColumn("suspect", F.col("hit_one").isNotNull() & F.col("hit_two").isNotNull()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialise(out.select("doc_id", "sha", "chars", "suspect"), "marked")


def _order() -> Column:
    return F.struct("chars", F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("least"))


def decisions(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs(doc_id, text)``."""
    marked = _marked(docs)
    groups = marked.where("suspect").groupBy("sha").agg(F.max_by("doc_id", _order()).alias("keep_id"), F.count("*").alias("group_size"))
    groups = small(materialise(groups, "groups"))  # written, so that a hot digest's rows can be split over tasks
    again = marked.where("suspect").join(groups, "sha").select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(again)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each set of equal texts, all columns unchanged.

    Rows whose text is found once are taken from the scan as they are, whatever
    their ids. Of the others each task first picks its best row of a text, so a
    hot text sends one row from each.
    """
    again = _marked(docs).where("suspect").groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("__sha"))
    again = small(materialise(again, "again"))
    text = F.coalesce(docs["text"], F.lit(""))
    sha = F.sha2(normalised(text).cast("binary"), 256)
    alone = docs.join(again, sha == again["__sha"], "left_anti")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    order = F.struct(F.length(text), docs["doc_id"].isNotNull(), F.bitwise_not(docs["doc_id"]), text, F.to_json(row))
    best = docs.join(again, sha == again["__sha"]).groupBy("__sha").agg(F.max_by(row, order).alias("r"))
    return alone.unionByName(best.select("r.*"))


def sql() -> str:
    return """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                      sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS sha FROM documents),
         g AS (SELECT sha, arg_max(doc_id, (chars, -doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY sha)
    SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.sha AS text_sha256
    FROM d JOIN g USING (sha)"""
