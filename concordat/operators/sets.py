"""Set differences, relational division, attachments, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both directed differences of two sets of rows, with the side that has each."""
    mine = left.join(right, left.columns, "left_anti").distinct().withColumn("side", F.lit("left"))
    return mine.unionByName(right.join(left, left.columns, "left_anti").distinct().withColumn("side", F.lit("right")))


def all_hold(owners: DataFrame, items: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Owners none of whose items fails the predicate; owners without items hold."""
    return owners.join(items.where(~F.coalesce(predicate, F.lit(False))).select(key), key, "left_anti")


def attach_preceding(df: DataFrame, partition: str, order: list[str], is_anchor: Column, value: Column, name: str) -> DataFrame:
    """For each row the value of the last anchor row before it in its partition, or null."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_anchor, value), ignorenulls=True).over(w))


def slot(values: Column) -> tuple[Column, Column]:
    """(status, value) of the distinct readings of a slot: missing, ok with its value, ambiguous."""
    n = F.size(values)
    return F.when(n == 0, "missing").when(n == 1, "ok").otherwise("ambiguous"), F.when(n == 1, values[0])


def counted(df: DataFrame, partition: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in order; filter misses before, they consume no number."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))


def dense_from_zero(df: DataFrame, partition: str, number: str) -> DataFrame:
    """Partitions whose numbers aren't 0 .. n-1, each once."""
    return df.groupBy(partition).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n"), F.count_distinct(number).alias("d")).where("lo <> 0 or hi + 1 <> n or d <> n").select(partition)
