"""Links inside buckets and connected components, both as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import COMPACT_ROWS, compact, forget, materialise, n_rows, small


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, comp)``, comp the least id.

    Large-star and small-star rounds until the edge set no longer changes.
    Every round is two aggregations by minimum (combined before the shuffle)
    and two equi-joins; each round's edges are written to the shared folder.
    A small edge set is one partition and has windows in place of joins, so that a round
    is one job, without a shuffle or a broadcast. Ids without an edge are not returned.
    """

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = materialise(e.where("u > v").distinct(), "cc", count=True, digest=F.bit_xor(F.xxhash64("u", "v")))
        return e, (n_rows(e), e.digest)

    def twice(e: DataFrame, *pairs: tuple[str, str], names: tuple[str, str]) -> DataFrame:
        """Each edge as rows of these columns; a union would be of two partitions."""
        each = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(pair, names, strict=True)]) for pair in pairs])
        return e.select(F.inline(each))

    def with_least(e: DataFrame, few: bool) -> DataFrame:
        """``m`` is the least ``v`` of the row's ``u``."""
        if few:
            return e.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    e, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(rounds):
        few = before[0] <= COMPACT_ROWS
        both = twice(compact(e), ("u", "v"), ("v", "u"), names=("u", "v"))
        large = with_least(both, few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # of a node's rows one has the least itself, which is the node's own edge; the others' are from theirs to the least
        e, now = written(with_least(large, few).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return twice(compact(e), ("u", "v"), ("v", "v"), names=("id", "comp")).distinct()


def link_buckets(nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], keep: str | None = None, finer: Callable[[DataFrame], DataFrame] | None = None, finer_keep: str | None = None, describe: Callable[[DataFrame], DataFrame] | None = None, place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components ``(id, comp)`` of the links among ``nodes(id, keys)``; nodes without a link are not returned.

    Nodes that have a key in common meet in its bucket; rows that repeat a node
    are one. Nodes may also come as rows ``(id, bucket, ...)``, with columns of numbers
    from -1 on that ``keep`` reads as those of ``describe``; ``place`` may change them
    once nodes are described. ``verify`` takes pairs ``(a, b)`` and returns those that are links.
    ``describe`` is given the ids of nodes that meet others, before any is
    verified, and returns ``(id, ...)``; ``keep`` is an SQL condition that every
    candidate meets, on its columns x as ``x_p`` and ``x_q``: part of the join,
    so that other pairs are never rows.

    1. A bucket's members are compared with its head, the one that meets most
       others: a group of n copies costs n pairs, not n squared.
    2. Members outside the component of a bucket's head are its minor ones. They
       are compared with the foremost minor one.
    3. The members that are minor even then are compared with every member of
       another component that they meet, so all pairs that meet are in one
       component or were verified. With ``finer``, which takes ids and returns
       ``(key, id, ...)`` such that any two that are a link share a key at which
       ``finer_keep`` holds, only such are compared: the others are no link.

    Counting is combined before the shuffle, and the joins on hot buckets are
    plain ones that AQE can split.
    """
    if places := [c for c in nodes.columns if c not in ("id", "keys", "bucket")]:
        # dealt once: both sides of the join read one exchange, which must have the same columns for both
        dealt = nodes.select("id", "bucket", *places).repartition("bucket")
        shared = dealt.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), *[F.max(c).alias(c) for c in places])
        shared = shared.where(" and ".join(["lo < hi", *(f"{c} >= -1" for c in places)])).select("bucket")
        met = dealt.join(shared.hint("shuffle_hash"), "bucket").groupBy("bucket", "id")
        # a node that is at several places of a bucket is at none: pairs of places would be their product
        met = materialise(met.agg(*[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(-1).alias(c) for c in places]), "met")
    else:
        members = nodes.select("id", F.explode("keys").alias("bucket"))
        shared = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
        shared = materialise(shared.select("bucket"), "shared")
        # always the same join, whose cost grows with the nodes, whatever their number
        met = materialise(members.join(shared.hint("merge"), "bucket").distinct(), "met")
    forget(nodes.sparkSession)
    sizes = small(materialise(met.groupBy("bucket").agg(F.count("*").alias("n")), "sizes", count=True))
    about = materialise(met.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("degree")), "about", count=True)
    carry: list[str] = []
    if described := describe(about.select("id")) if describe else None:
        carry = [c for c in described.columns if c != "id"]
        about = materialise(about.join(described, "id"), "about", count=True)
    carry += places
    met = place(met) if place else met
    live = compact(materialise(met.join(small(about), "id"), "live", count=True))
    rank = F.struct("degree", F.bitwise_not("id").alias("least"))
    tried = comps = None

    def head(rows: DataFrame) -> DataFrame:
        top = rows.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "label", *carry)).alias("h"))
        return top.select("bucket", F.bitwise_not("h.rank.least").alias("id"), F.col("h.label").alias("label"), *[F.col(f"h.{c}").alias(c) for c in carry])

    def pairs_of(left: DataFrame, right: DataFrame, on: str = "bucket", also: list[str] = carry, where: str | None = keep) -> DataFrame:
        x = left.select(on, F.col("id").alias("p"), F.col("label").alias("lp"), *[F.col(c).alias(f"{c}_p") for c in also])
        y = right.select(on, F.col("id").alias("q"), F.col("label").alias("lq"), *[F.col(c).alias(f"{c}_q") for c in also])
        both = x.join(y, on).where("lp != lq")
        both = both.where(where) if where else both
        both = both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        return both if tried is None else both.join(small(tried), ["a", "b"], "left_anti")

    def learn(pairs: DataFrame) -> bool:
        """Verify ``pairs`` and update the components; whether there was a link."""
        nonlocal tried, comps
        pairs = materialise(pairs, "pairs", count=True)
        if not n_rows(pairs):
            return False
        found = materialise(verify(pairs).select("a", "b"), "links", count=True)
        tried = pairs if tried is None else materialise(tried.unionByName(pairs), "tried", count=True)
        if not n_rows(found):
            return False
        # components so far stand for their links
        known = found if comps is None else found.unionByName(comps.where("id != comp").select(F.col("id").alias("a"), F.col("comp").alias("b")))
        comps = compact(materialise(components(known), "comps", count=True))
        forget(nodes.sparkSession)
        return True

    def labelled(rows: DataFrame) -> DataFrame:
        if comps is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(small(comps), "id", "left").withColumn("label", F.coalesce("comp", "id")).drop("comp")

    def minor(rows: DataFrame) -> DataFrame:
        """Members outside the component of their bucket's head, written."""
        top = rows.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "label")).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        top = materialise(top.where("lo < hi").select("bucket", F.col("h.label").alias("top")), "mixed", count=True)
        return compact(materialise(rows.join(small(top), "bucket").where("label != top").drop("top"), "minor", count=True))

    forget(nodes.sparkSession)
    first = live.withColumn("label", F.col("id"))
    learn(pairs_of(materialise(head(first), "heads"), first))
    rest = minor(labelled(live))
    if n_rows(rest):
        if learn(pairs_of(materialise(head(rest), "heads"), rest)):
            rest = minor(labelled(live))
        if finer is None:
            learn(pairs_of(rest, labelled(live)))
        else:
            who = materialise(labelled(live.select("id").distinct()), "who", count=True)
            keyed = materialise(finer(who.select("id")), "finer")
            also = [c for c in keyed.columns if c not in ("key", "id")]
            keyed = keyed.join(small(who), "id")
            few = materialise(rest.select("id").distinct(), "few", count=True)
            learn(pairs_of(keyed.join(small(few), "id", "left_semi"), keyed, "key", also, finer_keep))
    if comps is None:
        return nodes.sparkSession.createDataFrame([], "id long, comp long")
    return comps
