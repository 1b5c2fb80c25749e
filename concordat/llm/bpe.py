"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regex. Every code point gets a class from a table; a class, with what
follows it, is a function on the eight states of a small transducer. Composition of such
functions is associative, so states at all positions come from a prefix scan in blocks: compose
within blocks, scan the block functions by doubling, then replay the blocks from known states.
The transducer says where a slice starts. Each distinct slice of a group is merged once, through
a cache, and ids are laid out again by slice, with byte offsets kept for decoding.

Nulls and empty texts encode to no ids. Rows are independent: ties, repeated rows, null ids and
extra columns need no care. A long text is cut at starts of slices into parts of PART_BYTES, which
encode to the same ids; beside the text itself, memory follows its longest slice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concordat.llm.common import GROUP_BYTES, list_column, slice_hashes, text_groups
from concordat.session import in_arrow, read_table

NAME = "op6_byte_bpe"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices a worker remembers before it starts afresh.
CACHE_SLICES = 120_000
#: Bytes of a long text worked on at once.
PART_BYTES = 1 << 20

# Symbols: letter, number, other, apostrophe before one or two letters of a contraction, white
# space not before visible text, a space before it, other white space before it, padding.
LETTER, NUMBER, OTHER, CUT1, CUT2, WHITE, SPACE, LONE, PAD = range(9)
FIRST = 9  # added to the symbol of a text's first code point
# States: nothing open, a run of letters, numbers, others or white space, a space that joins
# what follows, a contraction that lacks one or two letters.
NONE, IN_L, IN_N, IN_O, IN_W, JOIN, NEED1, NEED2 = range(8)
STATES = 8


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice starts, by symbol * STATES + state."""
    nxt = np.zeros((2 * FIRST, STATES), np.uint8)
    starts = np.zeros((2 * FIRST, STATES), bool)
    for s in range(STATES):
        nxt[LETTER, s] = {NEED1: NONE, NEED2: NEED1}.get(s, IN_L)
        starts[LETTER, s] = s not in (IN_L, JOIN, NEED1, NEED2)
        nxt[NUMBER, s], starts[NUMBER, s] = IN_N, s not in (IN_N, JOIN)
        joined = s in (IN_O, JOIN)
        nxt[OTHER, s], starts[OTHER, s] = IN_O, not joined
        nxt[CUT1, s], starts[CUT1, s] = IN_O if joined else NEED1, not joined
        nxt[CUT2, s], starts[CUT2, s] = IN_O if joined else NEED2, not joined
        nxt[WHITE, s], starts[WHITE, s] = IN_W, s != IN_W
        nxt[SPACE, s], starts[SPACE, s] = JOIN, True
        nxt[LONE, s], starts[LONE, s] = NONE, True
        nxt[PAD, s], starts[PAD, s] = s, False
    for x in range(FIRST):
        nxt[FIRST + x], starts[FIRST + x] = nxt[x, NONE], starts[x, NONE]
    return nxt.ravel(), starts.ravel()


NEXT, STARTS = _transducer()


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return table


def prefix_states(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """The state before each symbol, starting from NONE, by an associative scan."""
    n = len(symbols)
    count = -(-n // block)
    padded = np.full(count * block, PAD, np.intp)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(count, block).T) * STATES
    f = np.tile(np.arange(STATES, dtype=np.uint8), (count, 1))
    for j in range(block):
        f = NEXT[columns[j][:, None] + f]
    step = 1
    while step < count:
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)
        step *= 2
    state = np.zeros(count, np.uint8)
    state[1:] = f[:-1, NONE]
    out = np.empty((block, count), np.uint8)
    for j in range(block):
        out[j] = state
        state = NEXT[columns[j] + state]
    return out.T.ravel()[:n]


def slice_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Code point positions at which slices start; firsts: positions at which texts start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = code_point_classes()[points]
    ends = np.zeros(n, bool)  # last of its text
    ends[-1] = True
    ends[firsts[firsts > 0] - 1] = True
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = symbols[1:] != WHITE
    visible_next &= ~ends
    white = (symbols == WHITE) & visible_next
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        one = np.where(ends[quote], 0, points[np.minimum(quote + 1, n - 1)])
        second = np.minimum(quote + 1, n - 1)
        two = np.where(ends[quote] | ends[second], 0, points[np.minimum(quote + 2, n - 1)])
        symbols[quote[np.isin(one, [ord(c) for c in "stmd"])]] = CUT1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[quote[pair]] = CUT2
    symbols[white] = np.where(points[white] == 0x20, SPACE, LONE)
    symbols[firsts] += FIRST
    return np.flatnonzero(STARTS[symbols.astype(np.intp) * STATES + prefix_states(symbols)])


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice of each content, and for every slice which of those it equals. Slices are told apart
    by hash, then each is compared with its like byte by byte; on a false match all go by content."""
    length = ends - starts
    _, where, inverse = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like = where[inverse]
    same = bool((length == length[like]).all()) and np.array_equal(data, data[np.arange(len(data)) + np.repeat(starts[like] - starts, length)])
    if not same:
        raw = data.tobytes()
        seen: dict[bytes, int] = {}
        inverse = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        _, where = np.unique(inverse, return_index=True)
    return where, inverse


def parts(data: np.ndarray, most: int) -> list[int]:
    """Byte positions that cut a long text into parts of about `most` bytes, at starts of slices: a
    slice never depends on what lies before it, its start on two code points after it at most, and
    only one of white space on whether the text goes on."""
    cuts, size = [0], most
    while len(data) - cuts[-1] > size:
        stop = cuts[-1] + size
        while data[stop] & 0xC0 == 0x80:
            stop -= 1
        part = data[cuts[-1] : stop]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = slice_starts(points, np.zeros(1, np.int64))
        starts = starts[(starts > 0) & (starts < len(points) - 2)]
        starts = starts[code_point_classes()[points[starts - 1]] != WHITE]
        if len(starts):
            cuts.append(cuts[-1] + int(np.flatnonzero((part & 0xC0) != 0x80)[starts[-1]]))
            size = most
        else:
            size *= 2
    return [*cuts, len(data)]


class Coder:
    """Pair merging over a rank file, with a cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.origin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.names = [str(i) for i in range(size)]
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of lowest rank is merged first, the leftmost on ties."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n > 96:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        none = 1 << 60
        pair = [ranks.get(piece[i : i + 2], none) for i in range(n - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            pair.pop(i)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for slices whose square would count."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a group, the id at which each text begins, and the byte offset
        (within the group) at which each id ends."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_of = np.flatnonzero((data & 0xC0) != 0x80)
        filled = offsets[:-1][np.diff(offsets) > 0]
        starts = byte_of[slice_starts(points, np.searchsorted(byte_of, filled))]
        ends = np.append(starts[1:], len(data))
        where, inverse = distinct_slices(data, starts, ends)
        raw, cache, ranks = data.tobytes(), self.cache, self.ranks
        if len(cache) > CACHE_SLICES:
            cache.clear()
        ids: list[int] = []
        count = np.empty(len(where), np.int64)
        for k, (a, b) in enumerate(zip(starts[where].tolist(), ends[where].tolist(), strict=True)):
            piece = raw[a:b]
            if (whole := ranks.get(piece)) is not None:
                ids.append(whole)
                count[k] = 1
                continue
            if (got := cache.get(piece)) is None:
                got = cache[piece] = tuple(self.merge(piece))
            ids += got
            count[k] = len(got)
        each = count[inverse]
        origin = np.concatenate([[0], np.cumsum(count)[:-1]])[inverse]
        upto = np.cumsum(each)
        flat = np.array(ids, np.int64)[np.repeat(origin - (upto - each), each) + np.arange(int(upto[-1]))]
        first = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return flat, first, np.cumsum(self.length[flat])

    def encode_long(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The ids of one text part by part: (ids, byte offset in the part at which each ends, where
        the part begins)."""
        cut = parts(data, PART_BYTES)
        for a, b in zip(cut, cut[1:]):
            flat, _, stop = self.encode_group(data[a:b], np.array([0, b - a], np.int64))
            yield flat, stop, a

    def decode_group(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, end to end."""
        if not len(ids):
            return b""
        length = self.length[ids]
        upto = np.cumsum(length)
        return self.bytes[np.repeat(self.origin[ids] - (upto - length), length) + np.arange(int(upto[-1]))].tobytes()


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", ends: str = "id_ends") -> DataFrame:
    """df with `ids` (array<int>) and `ends` (array<int>: the byte offset in the text at which
    each id ends). path: a rank file, present on every machine."""
    from pyspark.sql import types as T

    path = path or default_path()
    keep = [c for c in df.columns if c not in (ids, ends)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(ends, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(keep.index(text))):
                if len(data) > PART_BYTES:  # one long text
                    found = [(flat, stop + origin) for flat, stop, origin in c.encode_long(data)]
                    flat, stop = (np.concatenate([f[k] for f in found]) for k in range(2))
                    count = np.array([len(flat)])
                else:
                    flat, first, stop = c.encode_group(data, offsets)
                    count = np.diff(first)
                    stop = stop - np.repeat(offsets[:-1], count)
                part = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*part, list_column(flat, count, pa.int32()), list_column(stop, count, pa.int32())], names=[*keep, ids, ends])

    return df.select(*keep).transform(in_arrow, run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes (binary) of an id column; null ids give null. Ids outside the vocabulary raise."""
    from pyspark.sql import types as T

    path = path or default_path()
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            column = batch.column(keep.index(ids))
            got = [None if x is None else c.decode_group(np.asarray(x, np.int64)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*keep, out])

    return df.select(*keep).transform(in_arrow, run, schema)


def long_digests(c: Coder, doc_id: pa.Array, data: np.ndarray) -> pa.RecordBatch:
    """The row of digests() for one long text, part by part."""
    count, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
    for flat, _, _ in c.encode_long(data):
        ids_sha.update(((" " if count else "") + " ".join([c.names[i] for i in flat.tolist()])).encode())
        text_sha.update(c.decode_group(flat))
        count += len(flat)
    return pa.RecordBatch.from_arrays([doc_id, pa.array([count], pa.int64()), pa.array([ids_sha.hexdigest()]), pa.array([text_sha.hexdigest()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them.
    Encodes and decodes within a task, so that ids don't travel; one narrow stage, no shuffle."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1), GROUP_BYTES):
                if len(data) > PART_BYTES:  # one long text
                    yield long_digests(c, batch.column(0).slice(a, 1), data)
                    continue
                flat, first, stop = c.encode_group(data, offsets)
                decoded = c.decode_group(flat)
                names, listed = c.names, flat.tolist()
                at = np.concatenate([[0], stop])[first].tolist()
                cut = first.tolist()
                ids_sha = [hashlib.sha256(" ".join([names[i] for i in listed[x:y]]).encode()).hexdigest() for x, y in zip(cut, cut[1:])]
                text_sha = [hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").transform(in_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
