"""What a run leaves on disk. Paths stay under the run's folder; nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from concordat.functions import canon
from concordat.operators import kb
from concordat.sources.registry import Lexicon, safe_path


class SinkError(ValueError):
    """A write outside the run's folder, or one that doesn't read back."""


def inside(folder: str, path: str) -> str:
    if not safe_path(path):
        raise SinkError(f"unsafe path {path}")
    return f"{folder.rstrip('/')}/{path}"


def land(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written as Parquet under the run's folder and read back; the rows read must be those
    written (counts and order-free checksums agree), and they are what later stages use. The checksum
    of what is written is observed while it is."""
    path = inside(folder, name)
    marks = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("h")]
    seen = Observation()
    df.observe(seen, *marks).write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if seen.get != back.agg(*marks).first().asDict():
        raise SinkError(f"{name} doesn't read back as written")
    return back


def query_texts(found: DataFrame) -> DataFrame:
    """(group_id, path, body) of all query files of compiled pairs."""
    each = F.explode(F.array(*[F.struct(F.col(q).alias("query_id"), F.col(b).alias("body")) for q, b in (("q1_id", "q1_body"), ("q2_id", "q2_body"))]))
    rows = found.select("group_id", each.alias("x"))
    return rows.select("group_id", F.concat(F.lit("groups/"), "group_id", F.lit("/smt/"), F.col("x.query_id"), F.lit(".smt2")).alias("path"), "x.body")


def write_queries(found: DataFrame, folder: str) -> int:
    """Each query text byte for byte as its own file, groups/<group>/smt/<query>.smt2, and how many.
    Rows come to the driver partition by partition; files go through the folder's file system."""
    spark = found.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path_of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for r in query_texts(found).toLocalIterator():
        out = fs.create(path_of(inside(folder, r["path"])), False)
        try:
            out.write(bytearray(r["body"].encode()))
        finally:
            out.close()
        n += 1
    return n


def write_facts(base: kb.Kb, folder: str, name: str = "facts", one_file: bool = False) -> None:
    """The fact lines, sorted, each once: part files in order, or one file for a small base."""
    lines = kb.fact_lines(base)
    (lines.coalesce(1) if one_file else lines).select(F.col("line").alias("value")).write.mode("errorifexists").text(inside(folder, name))


def statement_schema(lexicon: Lexicon) -> str:
    """A JSON Schema, canonical, that limits a model's statements to the lexicon's ids."""
    ids = sorted(lexicon.concepts)
    pick = lambda prefix: [i for i in ids if i.startswith(prefix)]
    text = {"type": "string"}
    enum = lambda values: {"enum": sorted(set(values)), "type": "string"}
    many = lambda values: {"items": enum(values), "type": "array"}
    return canon.emit(
        {
            "type": "object",
            "required": ["action", "condition", "direction", "population", "region_ids", "strength"],
            "additionalProperties": False,
            "properties": {
                "action": {"type": "object", "required": ["kind", "target"], "properties": {"kind": enum(lexicon.actions.values()), "target": enum(pick("drug."))}},
                "condition": many([i for i in ids if not i.startswith(("drug.", "pop."))]),
                "direction": enum(m.direction for m in lexicon.modality.values()),
                "strength": enum(m.strength for m in lexicon.modality.values()),
                "population": many(pick("pop.")),
                "certainty": enum(lexicon.certainty.values()),
                "region_ids": {"items": text, "type": "array"},
            },
        }
    )
