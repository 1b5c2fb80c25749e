"""Pairs of opposed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.schema import POSITIVE


def is_positive(direction: Column | str) -> Column:
    return (F.col(direction) if isinstance(direction, str) else direction).isin(*POSITIVE)


def eligible_pairs(rules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs of rules (group_id, action_key, id, positive) of one group and action whose
    directions oppose: a_id < b_id, polarities differ. The equi-keys carry the join, so it is
    hash-partitioned and Spark may split a hot action. `keep` columns come as a_ and b_."""
    side = lambda p: rules.select("group_id", "action_key", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "positive", *keep)])
    joined = side("a").join(side("b"), ["group_id", "action_key"])
    return joined.where((F.col("a_id") < F.col("b_id")) & (F.col("a_positive") != F.col("b_positive"))).drop("a_positive", "b_positive")


def numbered(pairs: DataFrame, group: str = "group_id", a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Pairs with n, counted from 1 within the group in order of ids. Number before dropping pairs."""
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(a, b)))


def query_ids(pairs: DataFrame) -> DataFrame:
    """Adds the pair id and the ids of its overlap and deontic queries."""
    base = F.concat(F.lit("q."), F.regexp_replace("group_id", r"^group\.", ""), F.lit(".pair"), F.col("n").cast("string"))
    return pairs.withColumns({"pair_id": F.concat(F.lit("pair"), F.col("n").cast("string")), "q1_id": F.concat(base, F.lit(".overlap")), "q2_id": F.concat(base, F.lit(".deontic"))})
