"""The controlled language's registry as tables: surfaces, their forms, and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat import schema
from concordat.sources import cnl


def surfaces(spark: SparkSession) -> DataFrame:
    """(kind, id, surface); usable in either direction."""
    rows = [("concept", i, s) for s, i in cnl.CONCEPTS.items()] + [("drug", i, s) for s, i in cnl.DRUGS.items()]
    rows += [("action", cnl.ACTION, "takes"), ("quantity", cnl.QUANTITY, "age"), ("population", cnl.POPULATION, "patient")]
    return spark.createDataFrame(rows, "kind string, id string, surface string")


def word_forms(table: DataFrame) -> DataFrame:
    """Lexicon entries (form, surface, lemma, gender) of all surfaces and of fixed verbs and units."""
    fixed = [("noun_sg", "year", "year", "neutr"), ("noun_pl", "years", "year", "neutr"), ("tv_finsg", "takes", "take", None), ("tv_infpl", "take", "take", None), ("tv_finsg", "has", "have", None), ("tv_infpl", "have", "have", None)]
    own = table.where("kind <> 'action'").select(F.when(F.col("kind") == "drug", "pn_sg").otherwise("noun_sg").alias("form"), "surface", F.col("surface").alias("lemma"), F.when(F.col("kind") == "population", "human").otherwise("neutr").alias("gender"))
    return own.unionByName(table.sparkSession.createDataFrame(fixed, "form string, surface string, lemma string, gender string"))


def entry_lines(forms: DataFrame) -> DataFrame:
    """Entries as the lines of a user lexicon, sorted."""
    q = lambda c: F.when(F.col(c).rlike(r"\A[a-z][a-z0-9_]*\z"), F.col(c)).otherwise(F.concat(F.lit("'"), F.col(c), F.lit("'")))
    return forms.select(F.concat("form", F.lit("("), F.concat_ws(", ", q("surface"), q("lemma"), F.col("gender")), F.lit(").")).alias("line")).distinct().orderBy("line")


def read_lines(lines: DataFrame) -> DataFrame:
    """(form, surface, lemma, gender) of the lines of a user lexicon (column `line`); comments and blank
    lines drop out, a line that is no entry comes with a null form."""
    word = r"(?:'((?:[^'\\\\]|\\\\.)*)'|([a-z][a-z0-9_]*))"
    entry = rf"\A([a-z_]+)\({word}, {word}(?:, ([a-z]+))?\)\.\z"
    part = lambda k: F.regexp_extract("line", entry, k)
    either = lambda a, b: F.when(part(a) != "", part(a)).otherwise(part(b))
    given = lines.select(F.trim("line").alias("line")).where("line <> '' and not startswith(line, '%')")
    ok = F.col("line").rlike(entry)
    return given.select(F.when(ok, part(1)).alias("form"), F.when(ok, either(2, 3)).alias("surface"), F.when(ok, either(4, 5)).alias("lemma"), F.when(ok & (part(6) != ""), part(6)).alias("gender"))


def integrity(table: DataFrame) -> DataFrame:
    """(problem, subject): ids of the closed vocabulary without a surface, surfaces of unknown ids,
    and surfaces that stand for more than one id."""
    spark = table.sparkSession
    closed = [("concept", i) for i in schema.CONCEPTS] + [("drug", i) for i in schema.ACTION_TARGETS] + [("action", i) for i in schema.ACTION_KINDS] + [("quantity", i) for i in schema.QUANTITIES] + [("population", i) for i in schema.POPULATIONS]
    vocabulary = spark.createDataFrame(closed, "kind string, id string")
    bare = vocabulary.join(table, ["kind", "id"], "left_anti").select(F.lit("uncovered").alias("problem"), F.col("id").alias("subject"))
    alien = table.join(vocabulary, ["kind", "id"], "left_anti").select(F.lit("unknown").alias("problem"), F.col("id").alias("subject"))
    twice = table.groupBy("surface").agg(F.count_distinct("id").alias("n")).where("n > 1").select(F.lit("ambiguous").alias("problem"), F.col("surface").alias("subject"))
    return bare.unionByName(alien).unionByName(twice)
