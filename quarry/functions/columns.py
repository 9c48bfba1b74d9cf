"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, halves up; a margin keeps the noise of summation order from turning ties."""
    return F.floor(col(c) * 1e6 + 0.500123) / 1e6


def clip(c: Column | str, low: float, high: float) -> Column:
    """Within low and high; null stays null (least and greatest alone pass over nulls)."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high))))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def norm(*parts: Column | str) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + col(p) * col(p)
    return F.sqrt(total)


def draw(*parts) -> Column:
    """A number from 0 to 2**32 - 1 from the md5 of the parts: a draw that partitioning can't change."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def is_finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
