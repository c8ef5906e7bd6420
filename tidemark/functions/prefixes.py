"""Byte-string prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix_length(a: Column, b: Column) -> Column:
    """Bytes that two binary columns have in common at their beginning; 0 if either is null.

    Bisection over the length, as prefixes that are equal are equal up to any shorter length: 24 comparisons, for keys of
    under 16 MB.
    """
    least = F.least(F.octet_length(a), F.octet_length(b))

    def step(acc: Column, bit: Column) -> Column:
        longer = acc + bit
        return F.when((longer <= least) & (F.substring(a, F.lit(1), longer) == F.substring(b, F.lit(1), longer)), longer).otherwise(acc)

    powers = F.array(*[F.lit(1 << k) for k in reversed(range(24))])
    return F.coalesce(F.aggregate(powers, F.lit(0), step), F.lit(0))
