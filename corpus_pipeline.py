"""From raw documents to token ids: five stages over the operators of concordat.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns
to the shared folder and gives the reread table to the next. All but the last return the columns
of their input, extra ones included. Null texts count as empty. Rows with a null doc_id pass the
stages that compare documents. Empty tables pass through all stages.

quality          documents whose posterior chance of being good is under one half go
lines            lines covered by repeated three-line windows go; a document goes if nothing
                 but white space is left of it
near_duplicates  of each group of linked documents the smallest doc_id stays, and of rows that
                 repeat a doc_id one for each text
decontaminate    contaminated documents go; all others stay as they are
encode           doc_id, n_tokens and the digests of the ids and of the decoded bytes
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import bpe, decontaminate, jaccard, lines, quality
from concordat.llm.common import written
from concordat.session import read_table

NAME = "pipeline"
_OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shielded(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) with the columns of docs, whatever extra ones are called."""
    hidden = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in _OWN}
    given = docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns])
    return step(given).select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shielded(docs, lambda d: quality.judged(d, spark, sf_dir).where("keep"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        out = lines.dedup_lines(d).where(~(F.col("n_removed") > 0) | F.col("n_removed").isNull() | F.col("text").rlike(r"\S"))
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in d.columns else out

    return _shielded(docs, step)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        groups, _ = written(jaccard.similar_components(d.select("doc_id", "text")), "groups")
        out = d.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
        again = groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
        if again.isEmpty():
            return out
        return out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    return _shielded(docs, step)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shielded(docs, lambda d: decontaminate.contamination(d, read_table(spark, sf_dir, "benchmark")).where("not contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: Neither the classifier nor the encoder can be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


query = run
