"""Substring dedup by content-defined chunks.

A gear hash rolls over the last HISTORY bytes; a chunk ends where it is least within REACH bytes on
both sides, so edges depend on nearby content alone, an insertion shifts none but those near it, and
a chunk has more than REACH bytes. Where no such place comes for MOST bytes (blanks, short periods)
chunks end every MOST bytes from the last one. Edges lie between code points.

Chunks are deduplicated by digest, in runs: at each chunk begins the run of chunks that first has
LEAST bytes, known by 96 bits of digest of its content; one more run takes in the end of the text. A run that another document, or another place
of the same one, holds too is a repeat. Every repeated stretch of LEAST bytes in whole chunks is thus
found along one source, and chunks that repeat here and there by chance make none. What a smaller
doc_id, or an earlier place, holds too is removed; the first place keeps its text. Of every chunk
that goes, an earlier place has the same chunk, so no content is lost. A passage keeps up to
HISTORY + REACH bytes and a part of a chunk on either side.

The hash is computed by doubling (sums over 1, 2, 4, ... bytes) on arrays, its local minima likewise.
Null texts have no chunks and stay null, empty texts stay empty, texts shorter than LEAST stay as
they are. Rows with the same doc_id are one document; rows with a null doc_id lose only what repeats
within themselves. Extra columns pass through, whatever they are called; columns named like the added
ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import mix64
from concordat.llm.repeats import dedup, masks
from concordat.session import read_table

NAME = "op9_substring_dedup"
#: Bytes that the rolling hash covers (a power of 2), bytes on either side of an edge within which
#: it is least, and the most bytes of a chunk.
HISTORY, REACH, MOST = 16, 15, 128
#: Least bytes of a repeated run.
LEAST = 120
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the HISTORY bytes up to each."""
    h = _GEAR[data]
    width = 1
    while width < HISTORY and width < len(data):
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
        width *= 2
    return h


def edges(data: np.ndarray) -> np.ndarray:
    """Byte positions at which chunks end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.full(n + 2 * REACH, np.iinfo(np.uint32).max, np.uint32)
    wide[REACH : REACH + n] = rolling(data)
    low, width = wide, 1  # the least of the last `width` hashes
    while width < REACH:
        step = min(width, REACH - width)
        before = low[:-step]
        low = low.copy()
        np.minimum(low[step:], before, out=low[step:])
        width += step
    here = wide[REACH : REACH + n]
    cut = np.flatnonzero((here < low[REACH - 1 : REACH - 1 + n]) & (here <= low[2 * REACH : 2 * REACH + n])) + 1
    cut = np.append(cut[cut < n], n)
    size = np.diff(cut, prepend=0)
    for k in np.flatnonzero(size > MOST)[::-1].tolist():
        begin = int(cut[k] - size[k])
        cut = np.insert(cut, k, np.arange(begin + MOST, int(cut[k]) - REACH, MOST))
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # of code points
    place = np.searchsorted(starts, cut)
    return np.unique(np.append(starts, n)[np.minimum(place, len(starts))])


def runs(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk edges, and the byte spans of the runs, one from each chunk that has `least` bytes after
    its start, and from the last of these one to the end."""
    end = edges(np.frombuffer(text, np.uint8))
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    last = np.searchsorted(end, start + least)
    whole = last < len(end)
    begin, stop = start[whole], end[last[whole]]
    if len(stop) and stop[-1] < end[-1]:
        begin, stop = np.append(begin, begin[-1]), np.append(stop, end[-1])
    return end, begin, stop


def digests(text: bytes, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of digest of each span, in two numbers."""
    raw = b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begin.tolist(), stop.tolist())])
    words = np.frombuffer(raw, ">i4").reshape(-1, 4)
    return words[:, 0].astype(np.int64) << 32 | words[:, 1].astype(np.uint32), words[:, 2].astype(np.int32)


def merged(begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in zip(begin.tolist(), stop.tolist()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dedup_substrings(df: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated runs gone from its text, and n_chunks; repeated: byte spans (start, end)
    of runs that occur elsewhere too; removed: those of runs taken out; sources: the documents
    that first hold what was taken out. All but the text are null for null texts."""

    def units(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        _, begin, stop = runs(raw, least)
        return digests(raw, begin, stop)

    def edit(raw: bytes, key: int | None, known: dict) -> tuple:
        end, begin, stop = runs(raw, least)
        keys = list(zip(*(h.tolist() for h in digests(raw, begin, stop))))
        earlier, elsewhere, source = masks(keys, key, known)
        gone = merged(begin[earlier], stop[earlier])
        new = None
        if gone:
            parts, at = [], 0
            for a, b in gone:
                parts.append(raw[at:a])
                at = b
            new = b"".join([*parts, raw[at:]]).decode()
        spans = lambda found: [{"start": a, "end": b} for a, b in found]
        return new, len(end), spans(merged(begin[elsewhere], stop[elsewhere])), spans(gone), sorted(set(source[earlier].tolist()) - {-1})

    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("n_chunks", T.LongType()), T.StructField("repeated", kind), T.StructField("removed", kind), T.StructField("sources", T.ArrayType(T.LongType()))]
    return dedup(df, doc_id, text, units, "int", edit, added, [pa.int64(), _SPANS, _SPANS, pa.list_(pa.int64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_chunks", total("repeated").alias("n_repeated"), total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "sources", F.sha2("text", 256).alias("text_sha256"))
