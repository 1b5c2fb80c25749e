"""Ranges with open and closed ends over a dense order.

A lower end is a number (value, open), an upper end (value, closed); both are ordered so that max
gives the tightest lower end and min the tightest upper end, an open end winning ties. Nulls are
absent ends, the loosest, and greatest() and least() skip them. Two carriers:

packed   values of at most 17 digits as one BIGINT, unscaled value * 2 + flag: hash aggregation
         and comparisons stay on longs in generated code.
struct   DECIMAL(38, 18) values with the flag in a struct: any exact bound of a knowledge base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- packed ends -----------------------------------------------------------------------------


def packed_lower(value: Column | str, is_open: Column, scale: int = 2) -> Column:
    return (_col(value) * 10**scale).cast("long") * 2 + is_open.cast("long")


def packed_upper(value: Column | str, is_open: Column, scale: int = 2) -> Column:
    return (_col(value) * 10**scale).cast("long") * 2 + (~is_open).cast("long")


def end_value(end: Column | str, scale: int = 2) -> Column:
    return (F.shiftright(_col(end), 1).cast(f"decimal(18,{scale})") / F.lit(10**scale)).cast(f"decimal(18,{scale})")


def packed_empty(lo: Column | str, hi: Column | str) -> Column:
    """No value lies in [lo, hi]; never null: an absent end bounds nothing."""
    lo, hi = _col(lo), _col(hi)
    a, b = F.shiftright(lo, 1), F.shiftright(hi, 1)
    return F.coalesce((a > b) | ((a == b) & ((lo.bitwiseAND(F.lit(1)) == 1) | (hi.bitwiseAND(F.lit(1)) == 0))), F.lit(False))


def fold_packed(bounds: DataFrame, by: list[str], value: str = "value", side: str = "side", is_open: str = "is_open", scale: int = 2) -> DataFrame:
    """The tightest ends (lo, hi) of bounds per group."""
    lower, upper = F.col(side) == "lower", F.col(side) == "upper"
    return bounds.groupBy(*by).agg(
        F.max(F.when(lower, packed_lower(value, F.col(is_open), scale))).alias("lo"),
        F.min(F.when(upper, packed_upper(value, F.col(is_open), scale))).alias("hi"),
    )


def ranges_conflict_free(a: Column | str, b: Column | str) -> Column:
    """Whether two sets of ranges (arrays of quantity, lo, hi; a quantity once each) hold together:
    every range alone, and those of one quantity together, have a value. Both sets count in full,
    so a quantity that only one side bounds must still be non-empty."""
    a, b = _col(a), _col(b)
    alone = lambda x: packed_empty(x["lo"], x["hi"])
    both = F.exists(a, lambda x: F.exists(b, lambda y: (x["quantity"] == y["quantity"]) & packed_empty(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"]))))
    return ~(F.exists(a, alone) | F.exists(b, alone) | both)


# --- struct ends -----------------------------------------------------------------------------


def valid_bound(value: Column | str, openness: Column | str, side: Column | str) -> Column:
    """A bound that every predicate here may use; all others overlap nothing and empty nothing."""
    return F.coalesce(_col(value).isNotNull() & _col(openness).isin("open", "closed") & _col(side).isin("lower", "upper"), F.lit(False))


def single_bound_law(bounds: Column | str) -> Column:
    """The first surface profile: exactly one valid bound, of a value of at least 0."""
    bounds = _col(bounds)
    return (F.size(bounds) == 1) & F.forall(bounds, lambda b: valid_bound(b["value"], b["openness"], b["side"]) & F.coalesce(b["value"] >= 0, F.lit(False)))


def fold_structs(bounds: DataFrame, by: list[str], value: str = "bound", openness: str = "openness", side: str = "side") -> DataFrame:
    """Per group lo = (v, open), hi = (v, closed), and whether all bounds were valid."""
    ok = valid_bound(value, openness, side)
    lower = F.when(ok & (F.col(side) == "lower"), F.struct(F.col(value).alias("v"), (F.col(openness) == "open").cast("int").alias("f")))
    upper = F.when(ok & (F.col(side) == "upper"), F.struct(F.col(value).alias("v"), (F.col(openness) == "closed").cast("int").alias("f")))
    return bounds.groupBy(*by).agg(F.max(lower).alias("lo"), F.min(upper).alias("hi"), F.bool_and(ok).alias("all_valid"))


def struct_empty(lo: Column | str, hi: Column | str) -> Column:
    lo, hi = _col(lo), _col(hi)
    crossed = (lo["v"] > hi["v"]) | ((lo["v"] == hi["v"]) & ((lo["f"] == 1) | (hi["f"] == 0)))
    return F.coalesce(crossed, F.lit(False))


def intersect(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """Common ranges of two folded tables; a group of only one side keeps its ends."""
    a, b = one.select(*on, F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")), two.select(*on, F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    return a.join(b, on, "full").select(*on, F.greatest("lo_a", "lo_b").alias("lo"), F.least("hi_a", "hi_b").alias("hi"))


def satisfies(value: Column | str, bound: Column | str, openness: Column | str, side: Column | str) -> Column:
    """Whether a value lies on the inner side of a bound."""
    v, b, o, s = _col(value), _col(bound), _col(openness), _col(side)
    return (
        F.when((o == "closed") & (s == "lower"), v >= b)
        .when((o == "open") & (s == "lower"), v > b)
        .when((o == "closed") & (s == "upper"), v <= b)
        .when((o == "open") & (s == "upper"), v < b)
        .otherwise(F.lit(False))
    )


def coherent(ge: Column | str, gt: Column | str, le: Column | str, lt: Column | str) -> Column:
    """An interval record: at least one bound, at most one on each side, some value between."""
    ge, gt, le, lt = map(_col, (ge, gt, le, lt))
    some = F.coalesce(ge, gt, le, lt).isNotNull()
    lower, upper = F.coalesce(ge, gt), F.coalesce(le, lt)
    one_each = ~(ge.isNotNull() & gt.isNotNull()) & ~(le.isNotNull() & lt.isNotNull())
    room = F.coalesce((lower < upper) | ((lower == upper) & gt.isNull() & lt.isNull()), F.lit(True))
    return some & one_each & room
