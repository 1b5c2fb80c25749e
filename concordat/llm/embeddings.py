"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are spread over a bounded sample of the vectors. A vector is described by
its TOP nearest pivots in order; two vectors are candidates if they share SHARED of them that rank
high in both: the ranks (from 0) add up to RANKS at most. The inverted lists are kept by SHARED pivots
at once, so every list holds just the vectors with that shared count, and candidates are verified by
cosine in double precision within their list. A pair that meets in several lists is counted in one
only, that of its smallest shared pivots.

Identical vectors are first drawn together, so a group of copies costs one vector. Lists are counted
with partial aggregation; a long one is dealt into blocks of about BLOCK vectors by hash, each pair of
blocks a task's group; pairs aren't written out, only a count of links and a smallest connected vector
per vector and list.

The index is fitted on a sample (PIVOTS reference points from FIT * PIVOTS vectors, more with the
cube root of the table up to MOST_PIVOTS); every vector is indexed. Recall against brute force is
above 0.99 in the tests, on pairs that lie at the threshold. Components are scaled by the largest of
their vector, so neither large nor small numbers over- or underflow.

Vectors link only with the same label (not null) and the same length. Null or zero vectors, and
those with null or non-finite components, link with nothing. Rows with a null vec_id don't link.
Rows that repeat a vec_id are vectors of their own, identical or not, and the smallest id of a
component counts once. Vectors are told apart by 64-bit hashes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import components, drop_written, grouped, mix64, written
from concordat.session import in_arrow, read_table

NAME = "op3_embedding_near_dedup"
COSINE = 0.98
TOP, SHARED, RANKS = 8, 3, 10
PIVOTS, MOST_PIVOTS, PIVOTS_UPTO, FIT = 256, 4096, 65_536, 4
BLOCK = 512


def pivot_count(n: int) -> int:
    return int(min(MOST_PIVOTS, round(PIVOTS * max(1.0, n / PIVOTS_UPTO) ** (1 / 3))))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length about 1: by their largest component first, so that squares neither over- nor
    underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each the farthest from those before."""
    unit = scaled(sample)
    nearest, at, out = np.full(len(unit), 3.0), 0, []
    for _ in range(min(count, len(unit))):
        out.append(at)
        nearest = np.minimum(nearest, 1 - unit @ unit[at])
        at = int(nearest.argmax())
        if nearest[at] <= 1e-9:
            break
    return unit[out]


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column whose lists have one length, as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1)


def codes(top: np.ndarray) -> np.ndarray:
    """Of ordered pivots (rows) the combinations that a vector is listed by, one number each."""
    width = top.shape[1]
    some = min(SHARED, width)
    pick = np.array([c for c in combinations(range(width), some) if sum(c) <= RANKS])
    chosen = np.sort(top[:, pick], axis=2).astype(np.int64)
    out = np.zeros(chosen.shape[:2], np.int64)
    for k in range(some):
        out = out * (MOST_PIVOTS + 1) + chosen[:, :, k] + 1
    return out


def descriptions(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(rep, mult, x) with `top`, the ordered nearest pivots, and `lists`, the keys of all
    combinations of SHARED of them."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(2).to_numpy()
            for d in np.unique(dim):
                part = batch.filter(pa.array(dim == d))
                near = scaled(matrix(part.column(3))) @ shared.value[int(d)].T
                top = np.argsort(-near, axis=1, kind="stable")[:, :TOP]
                own = codes(top)
                seed = mix64(part.column(1).to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))[:, None]
                keys = mix64(mix64(seed + own.view(np.uint64)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), own.shape[1]).cast(pa.list_(pa.int64()))
                tops = pa.FixedSizeListArray.from_arrays(pa.array(top.astype(np.int16).ravel()), top.shape[1]).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(3), tops, lists], names=["rep", "mult", "x", "top", "lists"])

    return vectors.select("rep", "label", "dim", "x", "mult").transform(in_arrow, run, f"rep long, mult long, x {dict(vectors.dtypes)['x']}, top array<short>, lists array<long>")


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric boolean matrix, per row."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(group: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(vector, links counted here, smallest vector connected here) of one list or pair of blocks."""
    n = group.num_rows
    if n < 2:
        return None
    blk, rep, mult, nth = (group.column(k).to_numpy() for k in (3, 4, 5, 6))
    unit = scaled(matrix(group.column(8)))
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if group.column(1)[0] != group.column(2)[0]:
        linked &= blk[:, None] != blk[None, :]
    if not linked.any():
        return None
    own = codes(matrix(group.column(7), np.int64))
    smaller = own < own[0, nth[0]]  # combinations whose list comes before this one
    _, which, count = np.unique(own[smaller], return_inverse=True, return_counts=True)
    held = np.zeros((n, len(count)), np.float32)
    held[np.nonzero(smaller)[0], which] = 1
    held = held[:, count > 1]
    mine = linked & (held @ held.T == 0)
    links = mine @ mult
    order = np.argsort(rep, kind="stable")
    label = local_components(linked[np.ix_(order, order)])
    some = linked.any(1)
    other = np.empty(n, np.int64)
    other[order] = rep[order][label]
    return rep[some], links[some].astype(np.int64), other[some]


def near_duplicates(df: DataFrame, least: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable) and kept."""
    spark = df.sparkSession
    kind = "array<float>" if dict(df.dtypes)[embedding] == "array<float>" else "array<double>"
    given = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast(kind).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = given.withColumn("fine", fine).withColumns({"dim": F.when(F.col("fine"), F.size("x")), "h1": F.when(F.col("fine"), F.xxhash64("x")), "h2": F.when(F.col("fine"), F.xxhash64(F.lit("second"), "x"))})
    key = ["label", "dim", "h1", "h2"]
    one = rows.where("fine").groupBy(*key).agg(F.min("vec_id").alias("lowest"), F.count("*").alias("mult"), F.min_by("x", "vec_id").alias("x")).withColumn("rep", F.xxhash64(F.lit("vector"), *key))
    one, one_path = written(one, "vectors")

    pivots = {}
    for r in one.groupBy("dim").count().collect():
        want = pivot_count(r["count"])
        sample = one.where(F.col("dim") == r["dim"]).select(F.xxhash64(F.lit("pivot"), "h1", "h2").alias("o"), "x").orderBy("o", "x").limit(FIT * want).collect()
        pivots[r["dim"]] = spread(np.array([s["x"] for s in sample], np.float64), want)

    described, described_path = written(descriptions(one, pivots), "described")
    each = described.select("rep", F.posexplode("lists").alias("nth", "key"))
    counts = each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    lists = (
        each.join(counts, "key")
        .withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), "rep"), "blocks"))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "rep", "nth")
        .join(described.select("rep", "mult", "top", "x"), "rep")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lists.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep").select("key", "lo", "hi", "blk", "rep", "mult", "nth", "top", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["v", "links", "other"])

        for group in grouped(batches, 3):
            if (got := compare(group, least)) is not None:
                held.append(got)
            if len(held) >= 512:
                yield out()
        yield out()

    found = ordered.transform(in_arrow, run, "v long, links long, other long").groupBy("v", "other").agg(F.sum("links").alias("links"))
    found, found_path = written(found, "found")
    comp = components(found.select(F.col("v").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("v").agg(F.sum("links").alias("linked"))
    member = (
        one.select(*key, "rep", "lowest", "mult")
        .join(counts.withColumnRenamed("v", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("v", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    smallest = member.groupBy("component").agg(F.min("lowest").alias("c"))
    per_rep = member.join(smallest, "component").select(*key, (F.col("mult") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), "c")
    out = rows.select("vec_id", *key).join(per_rep, key, "left").select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    drop_written(spark, described_path)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.c),
g AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, g.c AS component_id, vec_id = g.c AS kept
FROM embeddings JOIN g ON g.v = vec_id LEFT JOIN n ON n.a = vec_id
"""
