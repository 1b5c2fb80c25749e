"""Exact fractions as num and den, reduced, the sign on num, den above 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gcd(a: Column | str, b: Column | str) -> Column:
    """Euclid over BIGINTs; a pair of longs takes at most 93 steps."""
    start = F.struct(F.abs(_col(a)).cast("long").alias("x"), F.abs(_col(b)).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def reduced(num: Column | str, den: Column | str) -> Column:
    """struct<num, den>; null where den is 0."""
    n, d = _col(num).cast("long"), _col(den).cast("long")
    g = gcd(n, d)
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1))
    # division of decimals: doubles would round what is over 2^53
    part = lambda x: (F.try_divide(x.cast("decimal(20,0)"), g.cast("decimal(20,0)"))).cast("long") * sign
    return F.when(d != 0, F.struct(part(n).alias("num"), part(d).alias("den")))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """A share, or null (not applicable) of nothing."""
    return reduced(part, whole)


def count(n: Column | str) -> Column:
    return F.struct(_col(n).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))


def subtract(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return reduced(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])
