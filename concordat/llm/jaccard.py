"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. The hash space is cut into cells; a cell of
a sketch is the XOR of the hashes in it. A shingle that two sets don't share changes one cell, so
the count of unequal cells is a lower bound of the symmetric difference. Sets with a Jaccard
similarity of p/q or more differ in at most D = (q - p)(a + b) / (q + p) shingles, and a set of a
shingles in at most D(a) from any partner not smaller. Sketches of a size band have more than D cells;
documents are joined on (band, cell, word), then verified exactly on their hashed shingles.

A document gives keys for its first D(a) + 1 cells that aren't empty, no more. Take the shorter of the
stretches of cells that two similar sets go through: it has at least D + 1 non-empty cells of that
set, of which at most D differ (pigeonhole), so both agree in a cell there that isn't empty. A set that
has too few such cells gives all of them and those under a further hash seed, and so on; both sides of
a pair do, so no pair is lost. Documents also carry a bit sketch (one flipped bit per shingle) as a
cheap check.

Groups: identical sets are drawn together by digest, and of those in one task only one spreads its
keys. Keys that several documents have are found by partial aggregation, then joined. Every key then
links its documents to its smallest one; verified links make components. Only keys that still hold
several components are compared pair by pair, dealt by hash into blocks of about BLOCK documents whose
pairs are checked on bit sketches without being written out. So large groups of copies cost a link
per document and key, no task gets a whole hot key, and no link between components is lost.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`. A document with fewer words than SHINGLE is one
shingle; without words or text it is empty and linked with nothing. Rows with the same doc_id are
one vertex; rows with a null doc_id link with nothing (component null). Other columns are ignored.
Shingles and sets are compared by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import ASCII_LOWER, SPACED_WORD, byte_words, components, drop_table, drop_written, fresh_path, list_column, mix64, text_groups, written
from concordat.session import in_arrow, read_table

NAME = "op1_ngram_jaccard"
SHINGLE = 5
#: Least similarity p / q.
SIMILARITY = (80, 100)
#: Documents of a block of pairwise comparison.
BLOCK = 1024
SEEDS = 8
#: Sets that a task remembers as spread.
REMEMBERED = 1 << 20

_U = np.uint64


# --- sets and sketches ----------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    _, _, h, first = byte_words(data, offsets, SPACED_WORD, ASCII_LOWER)
    n = len(h)
    if n >= size:
        s = h[: n - size + 1].copy()
        for k in range(1, size):
            s = s * _U(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
        s = mix64(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = np.sort(s[a : b - size + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            v = np.array([b - a], _U)
            for w in h[a:b]:
                v = mix64(v * _U(0x9E3779B97F4A7C15) + w)
            out.append(v)
        else:
            out.append(np.zeros(0, _U))
    return out


def most_apart(a: int, b: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """The largest symmetric difference of similar sets of sizes a and b."""
    p, q = similarity
    return (q - p) * (a + b) // (q + p)


def bands(n: int, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int, int]]:
    """(upper size of the band, its cells, most differences of n to a partner found there). A
    pair meets in the band of its smaller set; sets so small that similar means equal have none."""
    p, q = similarity
    out = []
    high = 1 << (n - 1).bit_length() if n > 1 else 1
    while n and high * q >= p * n:
        most = most_apart(high, high * q // p, similarity)
        if most:
            apart = most_apart(n, n * q // p, similarity) if n <= high else most_apart(n, high, similarity)
            out.append((high, most + high // 32 + 2, apart))
        high >>= 1
        if not high:
            break
    return out


def cell_keys(u: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """Join keys of a set (sorted hashes), as signed words."""
    out = []
    for high, cells, apart in bands(len(u), similarity):
        for seed in range(SEEDS):
            v = u if not seed else np.sort(mix64(u + _U(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1)))
            cell = ((v >> _U(32)) * _U(cells)) >> _U(32)
            start = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
            word = np.bitwise_xor.reduceat(v, start)[: apart + 1]
            out.append(mix64(word ^ mix64(cell[start[: apart + 1]] + _U((high << 8 | seed) << 24))))
            if len(word) > apart:
                break
        else:  # cells that both leave empty count too
            blank = np.setdiff1d(np.arange(cells, dtype=np.uint64), cell[start])
            out.append(mix64(mix64(blank + _U((high << 8 | SEEDS) << 24))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bit_sketch(u: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of 2^k >= 2n bits, by their low hash bits; in words."""
    width = max(64, 1 << (2 * len(u) - 1).bit_length()) if len(u) else 64
    bits = np.bincount((u & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) folded to fewer words: halves are XORed."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def features(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Size, digest and join keys of each (doc_id, text). A set that a task has met before under
    some doc_id has no keys again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                d1 = np.array([np.bitwise_xor.reduce(mix64(u ^ _U(0xA5A5A5A5A5A5A5A5))) for u in sets], _U)
                d2 = np.array([mix64(u + _U(0x1234567)).sum(dtype=_U) for u in sets], _U)
                named = batch.column(0).slice(a, b - a).is_valid().to_pylist()
                keys = []
                for u, name, digest in zip(sets, named, zip(d1.tolist(), d2.tolist())):
                    if name and digest not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        keys.append(cell_keys(u, similarity))
                    else:
                        keys.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(u) for u in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), list_column(np.concatenate(keys), [len(k) for k in keys], pa.int64())],
                    names=["doc_id", "n", "d1", "d2", "keys"],
                )

    return docs.transform(in_arrow, run, "doc_id long, n long, d1 long, d2 long, keys array<long>")


def shingled(docs: DataFrame, wanted: DataFrame, size: int) -> tuple[DataFrame, str]:
    """(doc_id, n, sketch, s) of the wanted documents: bit sketch, and hashes of the set as bytes. A
    table in buckets by doc_id, as the texts are dealt anyway, so joins with it don't shuffle it; and
    its name."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                sketches = [bit_sketch(u) for u in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(u) for u in sets], pa.int64()), list_column(np.concatenate(sketches), [len(k) for k in sketches], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())],
                    names=["doc_id", "n", "sketch", "s"],
                )

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.repartition(buckets, "doc_id").join(wanted, "doc_id", "left_semi").select("doc_id", "text").distinct()
    sets = texts.transform(in_arrow, run, "doc_id long, n long, sketch array<long>, s binary").where("n > 0")
    name = f"concordat_{uuid.uuid4().hex}"
    sets.write.bucketBy(buckets, "doc_id").option("path", fresh_path(spark, "shingles")).saveAsTable(name)
    return spark.table(name), name


# --- verification ---------------------------------------------------------------------------


def near_enough(pairs: DataFrame, meta: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes and bit sketches allow the similarity. meta: doc_id, n, sketch."""
    p, q = similarity
    one = meta.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = meta.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = []
            for na, nb, sa, sb in zip(x["na"], x["nb"], x["sa"], x["sb"]):
                u, v = np.array(sa, np.int64), np.array(sb, np.int64)
                words = min(len(u), len(v))
                apart = int(np.bitwise_count((fold(u, words) ^ fold(v, words)).view(_U)).sum())
                keep.append(apart <= most_apart(na, nb, similarity))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").transform(in_arrow, run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are similar, decided on whole sets of shingle hashes."""
    p, q = similarity
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(q * both >= p * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "sa", "sb").transform(in_arrow, run, "a long, b long").distinct()


# --- pairs within keys ----------------------------------------------------------------------


def block_pairs(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components in blocks (key, lo, hi) that their sizes and bit
    sketches allow. rows: key, lo, hi, blk, doc_id, comp, n, sketch. A block has at most
    2 * BLOCK rows; its pairs are compared in arrays."""
    p, q = similarity
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "doc_id")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(group):
            by_width.setdefault(len(r[7]), []).append(i)
        doc = np.array([r[4] for r in group])
        comp = np.array([r[5] for r in group])
        size = np.array([r[6] for r in group])
        blk = np.array([r[3] for r in group])
        two = group[0][1] != group[0][2]
        widths = sorted(by_width)
        parts = {w: (np.array(i), np.array([group[k][7] for k in i], np.int64)) for w, i in by_width.items()}
        for x, w in enumerate(widths):
            i, s = parts[w]
            for v in widths[x:]:
                if v > 4 * w:
                    break
                j, t = parts[v]
                t = fold(t, w)
                step = max(1, (1 << 21) // (len(j) * w))
                for k in range(0, len(i), step):
                    ii = i[k : k + step, None]
                    ok = (comp[ii] != comp[j]) & (np.minimum(size[ii], size[j]) * q >= np.maximum(size[ii], size[j]) * p)
                    if two:
                        ok &= blk[ii] != blk[j]
                    if not ok.any():
                        continue
                    apart = np.bitwise_count((s[k : k + step, None, :] ^ t[None, :, :]).view(_U)).sum(-1, dtype=np.int64)
                    ok &= apart <= (q - p) * (size[ii] + size[j]) // (q + p)
                    for e, f in zip(*np.nonzero(ok)):
                        a, b = int(doc[i[k + e]]), int(doc[j[f]])
                        if w != v or a < b:
                            yield min(a, b), max(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, found = None, [], set()

        def out() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if group:
                        found.update(compare(group))
                    now, group = row[:3], []
                    if len(found) > 50_000:
                        yield out()
                group.append(row)
        if group:
            found.update(compare(group))
        yield out()

    return ordered.select("key", "lo", "hi", "blk", "doc_id", "comp", "n", "sketch").transform(in_arrow, run, "a long, b long").distinct()


def similar_components(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, and component_id, the smallest doc_id reachable by
    links of similar documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed, keyed_path = written(features(docs, size, similarity), "keys")
    base, _ = written(keyed.drop("keys"), "sets")
    known = base.where("doc_id is not null and n > 0")

    # identical sets: the smallest document stands for all
    first = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    rep = known.select("doc_id", "n", "d1", "d2").distinct().join(first, ["n", "d1", "d2"]).select("doc_id", "rep")
    rep, rep_path = written(rep, "identical")

    # keys that several documents share
    keyed = keyed.where("doc_id is not null").select(F.explode("keys").alias("key"), "doc_id")
    twice = keyed.groupBy("key").count().where("count > 1").select("key")
    held = keyed.join(twice, "key").join(rep, "doc_id").select("key", F.col("rep").alias("doc_id")).distinct()
    held, held_path = written(held, "held")
    lows = held.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("key", "low")
    shared, shared_path = written(held.join(lows, "key").select("key", "low", "doc_id"), "shared")
    drop_written(spark, keyed_path)
    drop_written(spark, held_path)
    sets, sets_name = shingled(docs, shared.select("doc_id").distinct(), size)
    meta = sets.select("doc_id", "n", "sketch")

    same = rep.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    star = shared.where("low <> doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    star, star_path = written(near_enough(star, meta, similarity), "pairs")
    links, links_path = written(verified(star, sets, similarity), "links")
    comp, comp_path = written(components(links), "components")

    # keys that still hold several components: all pairs but those within a component
    parts = shared.select("key", "doc_id").join(comp.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    open_keys = parts.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m")).where("c1 < c2 and m > 2")
    spread = (
        parts.join(open_keys.select("key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "key")
        .withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), "blocks"))
        .select("key", "doc_id", "comp", "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
        .select("key", "doc_id", "comp", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))
        .join(meta, "doc_id")
    )
    rest, rest_path = written(block_pairs(spread, similarity), "pairs")
    more, more_path = written(verified(rest, sets, similarity), "links")
    final = components(same.union(links).union(more))
    drop_table(spark, sets_name)
    for p in (rep_path, shared_path, star_path, links_path, comp_path, rest_path, more_path):
        drop_written(spark, p)
    return base.select("doc_id", "n").join(final, base["doc_id"] == final["v"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT r.v, l.b FROM r JOIN links l ON l.a = r.c WHERE l.b < r.v OR l.b <> r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.v = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
