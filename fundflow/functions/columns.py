"""Column expressions that several operators use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence labels, most certain first.
CONFIDENCE = ("CONFIRMED", "HIGH_CONFIDENCE", "PROBABLE", "UNKNOWN")


def address(c: Column) -> Column:
    """Hex addresses are trimmed and lower-cased, all others only trimmed."""
    bare = F.trim(c)
    return F.when(bare.startswith("0x") | bare.startswith("0X"), F.lower(bare)).otherwise(bare)


def confidence_rank(c: Column) -> Column:
    """4 for CONFIRMED down to 1; unknown labels are 0."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(CONFIDENCE) for x in (k, 4 - i)]), F.upper(c)), F.lit(0))


def positive(c: Column) -> Column:
    """Finite and above zero."""
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def cents(c: Column) -> Column:
    return c.cast("decimal(38,2)")


def total(c: Column) -> Column:
    """A sum of money that doesn't depend on the order of rows."""
    return F.sum(cents(c)).cast("double")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def seconds(a: Column, b: Column) -> Column:
    """b - a of two timestamps, in seconds."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def value_weight(value: Column) -> Column:
    """Cost of an edge that carries so much: less for more; 1e6 for nothing."""
    log = F.log10(value + 1)
    return F.when(positive(value) & (log > 1e-6), 1 / log).otherwise(1e6)


def proximity(deviation: Column, limit: float) -> Column:
    if limit <= 0:
        return F.when(deviation <= 0, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1 - deviation / limit)


def band(value: Column, share: float) -> Column:
    """Numbers that values share or neighbour if the greater of two is at most
    ``1 / (1 - share)`` times the less; one band for all from a share of 1 on."""
    if share >= 1:
        return F.lit(0).cast("long")
    return F.floor(F.log(value) / (max(-math.log1p(-max(share, 0.0)), 1e-9) * (1 + 1e-6)))


def around(number: Column) -> Column:
    """A band and its neighbours."""
    return F.array(number - 1, number, number + 1)
