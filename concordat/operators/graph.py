"""Ancestors in forests by pointer doubling: as many passes as the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.session import drop_written, written


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; cuts the lineage of loops. Joins with it sort and
    merge: its few MB of compressed files may be hundreds in memory, which Spark would broadcast."""
    return written(df, "pass")[0].hint("merge")


def roots(edges: DataFrame, key: list[str], parent: list[str]) -> DataFrame:
    """(key..., root..., depth) for rows whose key columns name a vertex and whose parent columns
    name the vertex above it (null for a root, or a vertex that has no row: then a root too).
    Each pass doubles how far up a row looks, so a climb that goes on after as many passes as the row
    count has bits is a cycle and raises. Every pass is written; the one before it is deleted."""
    names = [f"r{i}" for i in range(len(key))]
    known = edges.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).distinct()
    cond = lambda left, right: [F.col(a) == F.col(b) for a, b in zip(left, right)]
    up = edges.join(known, cond(parent, [f"k{i}" for i in range(len(key))]), "left")
    at = up.select(*key, *[F.col(f"k{i}").alias(n) for i, n in enumerate(names)])
    at = at.withColumn("depth", F.when(F.col(names[0]).isNotNull(), 1).otherwise(0).cast("long"))
    at = at.select(*key, *[F.coalesce(F.col(n), F.col(k)).alias(n) for n, k in zip(names, key)], "depth")
    last = None
    for _ in range(int(edges.count()).bit_length() + 2):
        at, path = written(at, "pass")
        if last:
            drop_written(edges.sparkSession, last)
        last = path
        above = at.select(*[F.col(k).alias(f"a{i}") for i, k in enumerate(key)], *[F.col(n).alias(f"b{i}") for i, n in enumerate(names)], F.col("depth").alias("more")).where("more > 0")
        step = at.join(above, cond(names, [f"a{i}" for i in range(len(key))]), "left")
        if step.where("more is not null").isEmpty():
            return at
        at = step.select(*key, *[F.coalesce(F.col(f"b{i}"), F.col(n)).alias(n) for i, n in enumerate(names)], (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    raise ValueError("the edges have a cycle")
