"""Substitution classes, sequence context, wildcard alleles, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType
from pyspark.sql.types import IntegerType, StructField, StructType

BASES = "ACGT"
SBS6 = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")


def complement(x: Column) -> Column:
    return F.translate(x, "ACGT", "TGCA")


def sbs6(ref: str = "ref_allele", alt: str = "alt_allele") -> Column:
    """The substitution seen from its pyrimidine; null unless both are single bases that differ."""
    r, a = F.col(ref), F.col(alt)
    plain = F.concat(r, F.lit(">"), a)
    other = F.concat(complement(r), F.lit(">"), complement(a))
    base = r.isin(*BASES) & a.isin(*BASES) & (r != a)
    return F.when(base & r.isin("C", "T"), plain).when(base, other)


def sbs96(context: str = "trinuc_context", ref: str = "ref_allele", alt: str = "alt_allele") -> Column:
    """``A[C>T]G``, seen from the pyrimidine; null for other than three plain bases."""
    c, r, a = F.col(context), F.col(ref), F.col(alt)
    flip = r.isin("A", "G")
    c, r, a = F.when(flip, F.reverse(complement(c))).otherwise(c), F.when(flip, complement(r)).otherwise(r), F.when(flip, complement(a)).otherwise(a)
    label = F.concat(F.substring(c, 1, 1), F.lit("["), r, F.lit(">"), a, F.lit("]"), F.substring(c, 3, 1))
    fine = F.col(context).rlike("^[ACGT]{3}$") & F.col(ref).isin(*BASES) & F.col(alt).isin(*BASES)
    return F.when(fine, label)


def contexts96() -> list[str]:
    """All labels: by substitution, then the base before, then the base after."""
    return [f"{a}[{s}]{b}" for s in SBS6 for a in BASES for b in BASES]


def contexts(spark: SparkSession) -> DataFrame:
    """``ord, context`` of the 96 labels."""
    return spark.createDataFrame(list(enumerate(contexts96())), "ord int, context string")


def compatible(x: Column, y: Column) -> Column:
    """Whether alleles agree, N on either side agreeing with any base."""
    each = F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: (a == "N") | (b == "N") | (a == b))
    return (x == y) | ((F.length(x) == F.length(y)) & F.forall(each, lambda e: F.coalesce(e, F.lit(False))))


def n_runs(read: Column, at: Column) -> dict[str, Column]:
    """Around the 0-based place ``at`` of a read: bases and Ns on either side, and runs of N next to it."""
    left, right = F.substring(read, F.lit(1), at), F.substring(read, at + 2, F.length(read))
    ns = lambda x: F.length(x) - F.length(F.replace(x, F.lit("N"), F.lit("")))
    return {
        "n_before_alt": F.length(left), "n_after_alt": F.length(right), "n_n_before_alt": ns(left), "n_n_after_alt": ns(right),
        "leading_n_run_len": F.length(F.regexp_extract(left, "N*$", 0)), "trailing_n_run_len": F.length(F.regexp_extract(right, "^N*", 0)),
    }


def homopolymer(window: str, at: int) -> int:
    """Length of the run of equal bases that holds place ``at``."""
    a = b = at
    while a > 0 and window[a - 1] == window[at]:
        a -= 1
    while b + 1 < len(window) and window[b + 1] == window[at]:
        b += 1
    return b - a + 1


def tandem(window: str, at: int) -> tuple[int, int]:
    """Period (1 to 6, the smallest) and length of a tandem repeat of two or more copies over ``at``; (0, 0) if none.

    The repeat is the first, from the left, whose whole copies cover the place.
    """
    n = len(window)
    for k in range(1, 7):
        for start in range(max(0, n - 2 * k + 1)):
            copies = 1
            while window[start : start + k] == window[start + copies * k : start + (copies + 1) * k]:
                copies += 1
            if copies >= 2 and start <= at < start + copies * k:
                return k, copies * k
    return 0, 0


def _repeats(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for window, at in parts:
        rows = [(homopolymer(w, i), *tandem(w, i)) if w and 0 <= i < len(w) else (0, 0, 0) for w, i in zip(window, at, strict=True)]
        yield pd.DataFrame(rows, columns=["homopolymer_len", "str_period", "str_len"])


def repeats(window: str, at: str) -> Column:
    """A struct of repeat metrics of a window's column and the place in it; for distinct loci only."""
    kind = StructType([StructField(c, IntegerType()) for c in ("homopolymer_len", "str_period", "str_len")])
    return F.pandas_udf(_repeats, kind, PandasUDFType.SCALAR_ITER)(window, at)
