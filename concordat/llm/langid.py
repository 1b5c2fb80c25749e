"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
from left to right: the longest match with the sample is one phrase, then the next begins.
Phrases times the logarithm of the sample's length over the text's length estimate the cross
entropy (Ziv and Merhav); the language with the least wins.

The automaton's edges, three a symbol at most, lie in one table by row displacement, so its size
follows the sample and not the alphabet: every letter of every sample is a symbol of its own,
whatever its script. A parse is one table step per symbol; all segments of a group of texts
advance together, and are parsed again from the state in which the one before ended until they meet
what was found first, so a text has the phrases of one parse from left to right.

Sample: DOCUMENTS documents of each language, of each document SAMPLE_CHARS characters, in all
SYMBOLS symbols per language; chosen by a hash of doc_id over all training rows. These bounds
hold for training alone. All languages count; time and memory grow with their number.

Null texts and texts without a letter get `und` and score 0, as does everything if nothing is
labelled. Ties go to the first language by name. Rows are judged each; only text is read for a
prediction, other columns are ignored. Score is the margin to the second language, 0 to 1.
"""

from __future__ import annotations

import math
import random
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.llm.common import text_groups
from concordat.session import in_arrow, read_table

NAME = "op7_language_id"
DOCUMENTS, SAMPLE_CHARS, SYMBOLS = 64, 4000, 40_000
#: Symbols of texts parsed side by side, and how few segments are mended one by one.
SEGMENT, FEW = 256, 32
OTHER, GAP = 0, 1


@lru_cache(1)
def folded() -> np.ndarray:
    """Of each code point that is a letter the first one of its lower case, of others 0."""
    return np.array([ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(sys.maxunicode + 1)], np.int32)


def code_table(samples: dict[str, str]) -> np.ndarray:
    """Symbol of each code point: GAP for all but letters, OTHER for letters that no sample has in
    either case."""
    fold = folded()
    place = np.full(len(fold), OTHER, np.int32)
    for sample in samples.values():
        place[fold[np.frombuffer(sample.encode("utf-32-le"), np.uint32)]] = GAP
    known = np.flatnonzero(place[1:] == GAP) + 1
    place[known] = np.arange(len(known)) + 2
    place[0] = GAP
    return place[fold]


def symbols_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with gaps collapsed, a gap before each text, and where each begins."""
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    code = np.insert(table[points], first[:-1], GAP) if rows else table[points]
    first = first + np.arange(rows + 1)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != GAP) | (code[:-1] != GAP)
    keep[first[:-1]] = True
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def transitions(code: list[int]) -> list[dict[int, int]]:
    """Suffix automaton over code: of each state the next state by symbol. State 0 is the root."""
    rows: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in code:
        cur = len(rows)
        rows.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p >= 0:
            q = rows[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(rows)
                rows.append(rows[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return rows


def automaton(code: list[int], width: int) -> np.ndarray:
    """Parse table over code with all symbols below width, for small alphabets: at state * width +
    symbol, the next state times width, doubled, plus 1 where a phrase begins anew. The last
    symbol (width - 1) pads."""
    rows = transitions(code)
    step = np.full((len(rows), width), -1, np.int64)
    for state, row in enumerate(rows):
        step[state, list(row)] = list(row.values())
    root = np.where(step[0] < 0, 0, step[0])
    fresh = step < 0
    fresh[:, OTHER] = True
    step = np.where(fresh, root, step)
    out = step * width * 2 + fresh
    out[:, width - 1] = np.arange(len(rows)) * width * 2
    return out.astype(np.int32).ravel()


def packed(rows: list[dict[int, int]], width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of transitions() without the empty places: (root, owner, next, restart). A state
    is a place of the table; its edge by a symbol below width lies that many places on if the
    owner there is the state, else there is none. restart is the root's step by each symbol."""
    places = 2 * sum(map(len, rows)) + 64
    rng = random.Random(0)
    owner, to, base, used = [-1] * (places + width), [0] * (places + width), [0] * len(rows), set()
    for state in sorted(range(len(rows)), key=lambda k: -len(rows[k])):
        for _ in range(64):
            b = int(rng.random() * places)
            if b not in used and all(owner[b + c] < 0 for c in rows[state]):
                break
        else:
            b, places = len(owner), len(owner) + 1
            owner += [-1] * width
            to += [0] * width
        used.add(b)
        base[state] = b
        for c, q in rows[state].items():
            owner[b + c], to[b + c] = b, q
    restart = np.full(width, base[0], np.int32)
    for c, q in rows[0].items():
        restart[c] = base[q]
    return base[0], np.array(owner, np.int32), np.array(base, np.int32)[to], restart


@dataclass
class Segments:
    """Stretches of SEGMENT symbols of all texts, the longest first, and where those that still run
    are after each step."""

    begin: np.ndarray
    last: np.ndarray  # position of its last symbol
    before: np.ndarray  # the segment before it in its text, or -1
    end: np.ndarray  # of its text
    steps: list[np.ndarray]


def segments(first: np.ndarray) -> Segments:
    size = np.diff(first)
    count = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][row] + nth * SEGMENT
    length = np.minimum(SEGMENT, first[1:][row] - begin)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.where(nth > 0, np.concatenate([[-1], place[:-1]]), -1)[order] if len(order) else nth
    running = np.searchsorted(-length[order], -np.arange(SEGMENT), side="left").tolist()
    return Segments(begin[order], (begin + length - 1)[order], before, first[1:][row][order], [begin[order[:n]] + k for k, n in enumerate(running)])


def phrase_counts(code: np.ndarray, first: np.ndarray, cut: Segments, table: tuple) -> np.ndarray:
    """Phrases of each text. All segments are parsed together as if a text began at each; then those
    that begin in another state are parsed again until they meet what was found, and so on: the
    counts are those of a parse from left to right."""
    root, owner, to, restart = table
    trace, fresh = np.empty(len(code), np.int32), np.empty(len(code), np.uint8)
    n = len(cut.begin)
    state = np.full(n, root, np.int32)
    for at in cut.steps:
        symbols, now = code[at], state[: len(at)]
        to_root = owner[now + symbols] != now
        state = np.where(to_root, restart[symbols], to[now + symbols])
        trace[at], fresh[at] = state, to_root
    last = trace[cut.last]
    later = np.flatnonzero(cut.before >= 0)
    entered = np.full(n, root, np.int32)
    while True:
        wrong = later[entered[later] != last[cut.before[later]]]
        if len(wrong) <= FEW:
            break
        at_segment, state = wrong, last[cut.before[wrong]]
        entered[wrong] = state
        for at in cut.steps:
            runs = at_segment < len(at)
            at_segment, state = at_segment[runs], state[runs]
            if not len(at_segment):
                break
            here = at[at_segment]
            symbols = code[here]
            to_root = owner[state + symbols] != state
            state = np.where(to_root, restart[symbols], to[state + symbols])
            differs = trace[here] != state
            trace[here], fresh[here] = state, to_root
            at_segment, state = at_segment[differs], state[differs]
        last = trace[cut.last]
    if len(wrong):
        symbols, owners, nexts, restarts, traced, freshly = (memoryview(np.ascontiguousarray(x)) for x in (code, owner, to, restart, trace, fresh))
        for k in wrong[np.argsort(cut.begin[wrong], kind="stable")].tolist():
            p = int(cut.begin[k])
            s = traced[p - 1]
            for p in range(p, int(cut.end[k])):
                c = symbols[p]
                new = owners[s + c] != s
                s = restarts[c] if new else nexts[s + c]
                freshly[p] = new
                if traced[p] == s:
                    break
                traced[p] = s
    return 1 + np.add.reduceat(fresh, first[:-1], dtype=np.int64)


class Model:
    """Parse tables of the languages in order of name."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        texts = dict(samples)
        self.names = sorted(texts)
        self.table = code_table(texts)
        width = int(self.table.max()) + 1
        self.parse, self.weight = [], []
        for name in self.names:
            raw = np.frombuffer(texts[name].encode(), np.uint8)
            code, _ = symbols_of(raw, np.array([0, len(raw)]), self.table)
            code = code[:SYMBOLS]
            self.parse.append(packed(transitions(code.tolist()), width))
            self.weight.append(math.log2(2 + len(code)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        names, score = ["und"] * rows, np.zeros(rows)
        if not self.names or not rows:
            return names, score
        code, first = symbols_of(data, offsets, self.table)
        size = np.diff(first)
        lettered = np.add.reduceat((code != GAP).astype(np.int64), first[:-1]) > 0
        cut = segments(first)
        each = np.empty((len(self.names), rows))
        for k, table in enumerate(self.parse):
            each[k] = phrase_counts(code, first, cut, table) * self.weight[k] / size
        best = each.argmin(0)
        least = each[best, np.arange(rows)]
        if len(self.names) > 1:
            second = np.partition(each, 1, axis=0)[1]
            score = np.where(lettered, 1 - least / second, 0.0)
        else:
            score = lettered.astype(float)
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], score


@lru_cache(2)
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def training_samples(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """The bounded sample per language, brought to the driver. Keys are chosen over all rows
    without their texts; then the texts of the chosen few are read."""
    keyed = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), doc_id).alias("h")).where("lang is not null and text is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = keyed.select("lang", "h").withColumn("r", rank).where(F.col("r") <= DOCUMENTS).select("lang", "h").distinct()
    got = keyed.join(F.broadcast(few), ["lang", "h"], "left_semi").select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct()
    ranked = got.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= DOCUMENTS)
    out: dict[str, list[tuple]] = {}
    for r in ranked.collect():
        out.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return tuple((name, " ".join(t for _, t in sorted(out[name]))) for name in sorted(out))


def identify(df: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """df with lang_pred and score (columns of these names are replaced). A narrow stage."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(samples)
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value)
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(keep.index(text))):
                names, score = m.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return df.select(*keep).transform(in_arrow, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    samples = training_samples(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), samples).select("doc_id", "held_out", "lang_pred", "score")
