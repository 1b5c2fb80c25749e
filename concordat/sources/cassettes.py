"""Recorded model calls: lookup, and the bounded repair loop over them. No live calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text

KEY = ("route", "source", "seed")


def replay(asked: DataFrame, tape: DataFrame) -> DataFrame:
    """asked (route, source, seed, ...) with the recorded output, or why there is none:
    missing, constraint_drift or invalid_hex."""
    t = tape.select(*KEY, "output_hex", F.col("constraint_hash").alias("recorded_hash"))
    joined = asked.join(t, list(KEY), "left")
    output = text.unhex_text("output_hex")
    problem = F.when(F.col("output_hex").isNull(), "missing").when(F.col("constraint_hash") != F.col("recorded_hash"), "constraint_drift").when(output.isNull(), "invalid_hex")
    return joined.withColumn("problem", problem).withColumn("output", F.when(F.col("problem").isNull(), output)).drop("output_hex", "recorded_hash")


def violations(tape: DataFrame) -> DataFrame:
    """Keys recorded more than once, and records without a key or output."""
    twice = tape.groupBy(*KEY).count().where("count > 1").select(*KEY, F.lit("KeyMismatch").alias("kind"))
    holes = tape.where(" or ".join(f"{c} is null" for c in (*KEY, "output_hex"))).select(*KEY, F.lit("Incomplete").alias("kind"))
    return twice.unionByName(holes)


def accepted(attempts: DataFrame, limit: int, ok: Column, terminal: Column) -> DataFrame:
    """Per (route, source, draw) the first accepted attempt among 0 .. limit, none after a terminal
    reject, with how many repairs were spent. attempts: route, source, draw, attempt, output."""
    a = attempts.where(F.col("attempt") <= limit).withColumns({"ok": F.coalesce(ok, F.lit(False)), "stop": F.coalesce(terminal, F.lit(False))})
    key = ["route", "source", "draw"]
    ends = a.groupBy(*key).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("hit"), F.min(F.when(F.col("stop") & ~F.col("ok"), F.col("attempt"))).alias("dead"), F.max("attempt").alias("last"))
    good = F.col("hit").isNotNull() & (F.col("dead").isNull() | (F.col("hit") < F.col("dead")))
    ends = ends.withColumn("accepted", good).withColumn("used", F.when(good, F.col("hit")).otherwise(F.coalesce("dead", "last")))
    won = a.select(*key, F.col("attempt").alias("hit"), "output")
    return ends.join(won, [*key, "hit"], "left").select(*key, "accepted", F.col("used").alias("repairs"), F.when(F.col("accepted"), F.col("output")).alias("output"))


def ungrounded(used: DataFrame, known: DataFrame) -> DataFrame:
    """Region ids that an output names and its document lacks: (document_id, region_id)."""
    return used.select("document_id", "region_id").distinct().join(known.select("document_id", "region_id"), ["document_id", "region_id"], "left_anti")


def off_vocabulary(used: DataFrame, lexicon_ids: DataFrame) -> DataFrame:
    """Ids an output uses that the lexicon lacks: (document_id, id)."""
    return used.select("document_id", "id").distinct().join(lexicon_ids.select("id"), "id", "left_anti").select("document_id", "id")
