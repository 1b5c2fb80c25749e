"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches and are worked on in groups of bounded size,
so that memory follows the largest single text and never a whole partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.session import drop_written, fresh_path, written

#: Bytes of text worked on at once.
GROUP_BYTES = 1 << 19


# --- written tables -------------------------------------------------------------------------


def drop_table(spark: SparkSession, name: str) -> None:
    """Drops a table of the catalog with a path of its own, and its files."""
    path = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {name}")
    drop_written(spark, path)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- texts as bytes -------------------------------------------------------------------------


def text_groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: (first row, end row, UTF-8 bytes, byte offsets from 0).
    Nulls count as empty. A slice has one row or at most `most` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offsets_buf, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words (wraps on overflow)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Slices are hashed as polynomials modulo this prime at a fixed point: two different slices of at
#: most n bytes agree with a chance of n / 2^61, however regular they are. (Modulo 2^64 some would
#: agree at every odd point.)
PRIME = (1 << 61) - 1
_POINT = 0x0F3C5A1D7B29E846
#: Bytes hashed at once; a longer slice is hashed by digest.
_SPAN = 1 << 20
_POWERS = [np.ones(1, np.uint64), np.zeros(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Low 32 and high 29 bits of at least n powers of the point."""
    have = len(_POWERS[0])
    if have < n:
        at, more = int(_POWERS[0][-1]) | int(_POWERS[1][-1]) << 32, []
        for _ in range(max(n, 1 << 10) - have):
            at = at * _POINT % PRIME
            more.append(at)
        new = np.array(more, np.uint64)
        _POWERS[0] = np.concatenate([_POWERS[0], new & np.uint64(0xFFFFFFFF)])
        _POWERS[1] = np.concatenate([_POWERS[1], new >> np.uint64(32)])
    return _POWERS


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the slices data[start:end] (not empty, in order, without overlaps), their
    bytes folded by a table over the 256 byte values."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, origin + _SPAN, side="right")))
        s, e = starts[at:stop] - origin, ends[at:stop] - origin
        part = data[origin : origin + int(e[-1])]
        if len(part) > _SPAN:
            part = part if fold is None else fold[part]
            out[at] = int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little")
            at = stop
            continue
        size = e - s
        room = np.diff(s, append=len(part))
        pos = np.arange(len(part)) - np.repeat(s, room)
        value = (part if fold is None else fold[part]).astype(np.uint64) + np.uint64(1)
        if (room != size).any():
            value[pos >= np.repeat(size, room)] = 0
        longest = int(size.max())
        np.minimum(pos, longest - 1, out=pos)
        low, high = _powers(longest)
        a, b = np.add.reduceat(value * low[pos], s), np.add.reduceat(value * high[pos], s)
        p, half = np.uint64(PRIME), np.uint64(29)
        # b * 2^32 modulo 2^61 - 1 is a rotation
        h = ((b & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (b >> half) + (a & p) + (a >> np.uint64(61))
        h = (h & p) + (h >> np.uint64(61))
        out[at:stop] = mix64(np.where(h >= p, h - p, h) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return out


def byte_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
    """Maximal runs of word bytes that don't cross rows.

    is_word and fold are tables over the 256 byte values. Returns starts, ends (byte positions),
    a 64-bit hash of each word's folded bytes, and the word index at which each row begins
    (one more entry than rows)."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    mask = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    inner = cuts[cuts > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    return starts, ends, slice_hashes(data, starts, ends, fold), first


def byte_table(chars: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED_WORD = ~byte_table([0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM_WORD = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the count of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


# --- connected components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges(a, b): the smallest vertex that is reachable.

    Alternating large-star and small-star passes. Each pass is one aggregation and one join over
    the edges; nothing is gathered per vertex and nothing but a count and a checksum comes to the driver, so a
    vertex with a third of all edges is split like any skewed join. Edges with a null end and
    loops are ignored. Every pass is written to the shared folder."""
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    e, path = written(e, "edges")
    state = None
    while True:
        big = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = big.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = big.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, mid = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        nxt, new_path = written(small, "edges")
        drop_written(spark, path)
        drop_written(spark, mid)
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e, path = nxt, new_path
        if state == seen:
            break
        state = seen
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(e.select("v", F.col("v").alias("component")).distinct())


# --- sorted groups in a stream --------------------------------------------------------------


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Groups of equal first `keys` columns (integers without nulls) from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if held and key != now:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)
