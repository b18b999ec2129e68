"""Arithmetic that gives the same value in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the binary value: round(x * 10^n) / 10^n."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def vaf(alt: str = "alt_count", depth: str = "total_depth") -> Column:
    """Variant allele fraction."""
    return ratio(alt, depth)


def strand_balance() -> Column:
    """Share of alternate reads on the forward strand, null without any."""
    return ratio(F.col("fwd_alt_count"), F.col("fwd_alt_count") + F.col("rev_alt_count"))


def percentile(x: str, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(F.col(x).cast("double"), q)
