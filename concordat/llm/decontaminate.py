"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a group of whole texts of bounded size. Its words that occur in the benchmark become
symbols, all others separators (no window holds them), and runs too short for any window go too.
A suffix array by prefix doubling gives the Burrows-Wheeler transform, a wavelet matrix gives
ranks, and all windows of the benchmark are searched backwards at once. Occurrences are located
by walking to sampled suffix positions; their spans merge into removal spans.

Long runs are cut into overlapping pieces, so the number of doubling rounds is bounded whatever
repeats. The documents pass in one narrow stage without a shuffle, and a shard's index is built once
for all windows. Only windows all of whose words the shard holds are searched, BATCH at a time. The
benchmark's words are broadcast as 4 bytes each; beyond BLOCK_BYTES of benchmark text (one item may
be longer) it is dealt into blocks with a pass each, so what is broadcast stays bounded.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is WINDOW consecutive words
of an item; a shorter item is one window. Null or wordless texts have no words and are not
contaminated; null or wordless items have no windows. Items with a null id cause hits but are
not listed. Repeated rows are judged each; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import ALNUM_WORD, ASCII_LOWER, byte_words, drop_written, text_groups, written
from concordat.session import in_arrow, read_table

NAME = "op2_decontaminate"
WINDOW = 13
#: A document is contaminated from one hit word in so many on.
ONE_IN = 20
#: Words of a piece beside its overlap, and distance of sampled suffixes.
PIECE, SAMPLE = 256, 8
#: Benchmark text collected and broadcast at once, and windows searched at once.
BLOCK_BYTES, BATCH = 16 << 20, 1 << 16
#: Passes (blocks) chained in one stage, each with a Python worker of its own.
PASSES = 4


@dataclass
class Windows:
    """Windows of a block of items, as stretches of its words."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k + 1 is word k
    symbols: np.ndarray  # of all items, end to end
    start: np.ndarray  # of each window in symbols
    length: np.ndarray
    item: np.ndarray  # of each window, an index into item_ids
    item_ids: list[str | None]

    @property
    def levels(self) -> int:
        return max(1, int(len(self.vocabulary)).bit_length())

    def batches(self, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows all of whose symbols are held, and their symbols right-aligned (0 pads)."""
        lacking = np.concatenate([[0], np.cumsum(~held[self.symbols])])
        some = np.flatnonzero(lacking[self.start + self.length] == lacking[self.start])
        for k in range(0, len(some), BATCH):
            at = some[k : k + BATCH]
            longest = int(self.length[at].max())
            place = (self.start[at] + self.length[at] - longest)[:, None] + np.arange(longest)
            yield at, np.where(place >= self.start[at][:, None], self.symbols[np.maximum(place, 0)], 0)


def item_windows(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Windows:
    """Windows of (item_id, text) rows."""
    texts = pa.array([t for _, t in rows], pa.string())
    hashes, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in text_groups(texts):
        _, _, h, first = byte_words(data, offsets, ALNUM_WORD, ASCII_LOWER)
        hashes.append(h)
        size.append(np.diff(first))
    vocabulary, symbols = np.unique(np.concatenate(hashes), return_inverse=True)
    size = np.concatenate(size)
    count = np.where(size >= window, size - window + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    ids = [None if i is None else str(i) for i, _ in rows]
    return Windows(vocabulary, symbols.astype(np.int32) + 1, (np.cumsum(size) - size)[row] + nth, np.minimum(size, window)[row], row, ids)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of text, in which each 0 is a separator of its own, before all symbols."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        r = rank[order]
        fresh = np.empty(n, bool)
        fresh[0] = True
        fresh[1:] = r[1:] != r[:-1]
        if width > 1:
            second = np.where(order + width // 2 < n, previous[np.minimum(order + width // 2, n - 1)] + 1, 0)  # noqa: F821
            fresh[1:] |= second[1:] != second[:-1]
        previous = np.empty(n, np.int64)
        previous[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        rank = previous
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        # only suffixes that still tie are sorted again; they are neighbours in order
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        some = order[at]
        order = order.copy()
        order[at] = some[np.lexsort((after[some], rank[some]))]
        width *= 2


class FmIndex:
    """Backward search and location over a symbol sequence with separators (0)."""

    def __init__(self, text: np.ndarray, run_start: np.ndarray, levels: int):
        """run_start[i]: where the run of position i begins; positions at multiples of SAMPLE
        from there are sampled, so that no walk passes a separator."""
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]  # of suffix 0 it is the last symbol, a separator
        self.n, self.levels = n, levels
        self.first = np.zeros((1 << levels) + 1, np.int64)
        self.first[1:] = np.cumsum(np.bincount(text, minlength=1 << levels)[: 1 << levels])
        sampled = (sa - run_start[sa]) % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]
        self.ones = np.zeros((levels, n + 1), np.int32)
        self.zeros = np.zeros(levels, np.int64)
        left = bwt
        for k in range(levels):
            bit = (left >> (levels - 1 - k)) & 1
            np.cumsum(bit, out=self.ones[k, 1:])
            self.zeros[k] = n - self.ones[k, n]
            left = np.concatenate([left[bit == 0], left[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the transform before each position."""
        low, high = np.zeros_like(at), at
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k, low], self.ones[k, high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols of the transform."""
        symbol = np.zeros_like(at)
        for k in range(self.levels):
            a = self.ones[k, at]
            bit = self.ones[k, at + 1] - a
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + a, at - a)
        return symbol

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur; rows are right-aligned."""
        alive = np.arange(len(symbols))
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        done = []
        for k in range(symbols.shape[1] - 1, -1, -1):
            s = symbols[alive, k]
            low, high = self.first[s] + self.rank(s, low), self.first[s] + self.rank(s, high)
            hit = low < high
            alive, low, high = alive[hit], low[hit], high[hit]
            over = length[alive] == symbols.shape[1] - k
            done.append((alive[over], low[over], high[over]))
            alive, low, high = alive[~over], low[~over], high[~over]
            if not len(alive):
                break
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3)) if done else (alive, low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out = np.empty(len(at), np.int64)
        todo, steps = np.arange(len(at)), 0
        at = at.copy()
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            s = self.access(at)
            at = self.first[s] + self.rank(s, at)
            steps += 1
        return out


def occurrences(symbol: np.ndarray, row_first: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of all occurrences in words of several rows. symbol: per word, 0
    where the benchmark lacks it; row_first: the word at which each row begins."""
    none = np.zeros(0, np.int64)
    n = len(symbol)
    inside = symbol > 0
    if not inside.any():
        return none, none
    begins = inside.copy()
    begins[1:] = inside[1:] & ~inside[:-1]
    heads = row_first[:-1][row_first[:-1] < n]
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    run = np.cumsum(begins)[inside] - 1
    size = np.bincount(run, minlength=len(start))
    keep = size >= w.length.min()
    start, size = start[keep], size[keep]
    if not len(start):
        return none, none
    overlap = int(w.length.max()) - 1
    pieces = np.maximum(1, -(-(size - overlap) // PIECE))
    owner = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    p_start = start[owner] + nth * PIECE
    p_size = np.minimum(start[owner] + size[owner] - p_start, PIECE + overlap)
    lay = np.cumsum(p_size + 1)
    begin = lay - p_size - 1  # in the laid out text; a separator follows each piece
    text = np.zeros(int(lay[-1]), np.int64)
    where = np.repeat(begin, p_size) + np.arange(int(p_size.sum())) - np.repeat(np.cumsum(p_size) - p_size, p_size)
    word = where - np.repeat(begin, p_size) + np.repeat(p_start, p_size)
    text[where] = symbol[word]
    run_start = np.repeat(begin, p_size + 1)
    index = FmIndex(text, run_start, w.levels)
    held = np.diff(index.first) > 0
    found = [(at[p], low, high) for at, rows in w.batches(held) for p, low, high in [index.search(rows, w.length[at])]]
    pattern, low, high = (np.concatenate([none, *(f[k] for f in found)]) for k in range(3))
    if not len(pattern):
        return none, none
    count = high - low
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at = index.locate(rows)
    word_of = np.zeros(len(text), np.int64)
    word_of[where] = word
    return np.repeat(pattern, count), word_of[at]


def scan_group(data: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, set[str]]]]:
    """Word counts of the rows, and for rows with hits (row, byte starts and ends of removal
    spans as merged, with their words, item ids)."""
    starts, ends, h, first = byte_words(data, offsets, ALNUM_WORD, ASCII_LOWER)
    n_words = np.diff(first)
    if not len(w.start):
        return n_words, []
    place = np.minimum(np.searchsorted(w.vocabulary, h), len(w.vocabulary) - 1)
    window, at = occurrences(np.where(w.vocabulary[place] == h, place + 1, 0), first, w)
    out = []
    if len(at):
        row = np.searchsorted(first, at, side="right") - 1
        order = np.argsort(row, kind="stable")
        row, at, window = row[order], at[order], window[order]
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(row)]):
            r = int(row[a])
            items = {w.item_ids[i] for i in np.unique(w.item[window[a:b]]).tolist()}
            base, size = int(first[r]), int(n_words[r])
            mark = np.zeros(size + 1, np.int64)
            np.add.at(mark, at[a:b] - base, 1)
            np.add.at(mark, at[a:b] - base + w.length[window[a:b]], -1)
            hit = np.concatenate([[False], np.cumsum(mark)[:size] > 0, [False]])
            s, e = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
            out.append((r, np.stack([s, e, starts[base + s] - offsets[r], ends[base + e - 1] - offsets[r]]), items - {None}))
    return n_words, out


_SPAN = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("first_word", "end_word", "start", "end")]))


def _pass(df: DataFrame, w, text: str) -> DataFrame:
    """One pass: the columns n_words, spans and item_ids, joined to those of passes before."""
    before = "spans" in df.columns
    keep = [c for c in df.columns if c not in ("n_words", "spans", "item_ids")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("first_word", "end_word", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = w.value
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(keep.index(text))):
                n_words, found = scan_group(data, offsets, windows)
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                items: list[set] = [set() for _ in range(b - a)]
                for r, s, names in found:
                    spans[r] = [dict(zip(("first_word", "end_word", "start", "end"), x)) for x in s.T.tolist()]
                    items[r] = names
                if before:
                    for r in range(b - a):
                        spans[r] = merge_spans(batch.column(len(keep) + 1)[a + r].as_py() + spans[r])
                        items[r] |= set(batch.column(len(keep) + 2)[a + r].as_py())
                part = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "item_ids"])

    return df.select(*keep, *(("n_words", "spans", "item_ids") if before else ())).transform(in_arrow, run, schema)


def merge_spans(spans: list[dict]) -> list[dict]:
    """Union of word spans with their byte spans."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first_word"]):
        if out and s["first_word"] <= out[-1]["end_word"]:
            if s["end_word"] > out[-1]["end_word"]:
                out[-1] |= {"end_word": s["end_word"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words, spans (array of first_word, end_word and the byte span start, end),
    item_ids (sorted strings), n_hit, n_items and contaminated. Columns of df with these names are replaced."""
    spark = df.sparkSession
    added = ("n_words", "spans", "item_ids", "n_hit", "n_items", "contaminated")
    out = df.select(*[c for c in df.columns if c not in added])
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    if blocks > 1:
        items, dealt = written(items.withColumn("b", F.pmod(F.xxhash64("t", "i"), F.lit(blocks))), "items")
    before = None
    for k in range(blocks):
        rows = (items.where(F.col("b") == k) if blocks > 1 else items).collect()
        out = _pass(out, spark.sparkContext.broadcast(item_windows([(r["i"], r["t"]) for r in rows], window)), text)
        if k % PASSES == PASSES - 1 and k + 1 < blocks:
            out, path = written(out, "passes")
            if before:
                drop_written(spark, before)
            before = path
    if blocks > 1:
        drop_written(spark, dealt)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["first_word"])
    return out.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long")}).withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[k:k + least(13, len(ws)) - 1], ' ') AS w
       FROM i, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS u(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w
       FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS u(k) WHERE len(ws) >= n),
hits AS (SELECT DISTINCT rid, item_id, dw.n, k FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS u(p) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
