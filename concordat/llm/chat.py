"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. It is never looked into: successive prefixes
of a conversation are rendered, consecutive outputs compared, and what an output adds is the
span of its turn. If an output doesn't begin with the one before, the template rewrites history,
and the piece says so. Where the text of a turn lies in its span is found by rendering the turn
with two other texts: what both outputs share before and behind is the template's own.

Conversations of any length are cut into pieces of at most PIECE turns, so the quadratic cost of
prefixes is bounded. A later piece is rendered with the conversation's first and last previous
turns before it as context; the pieces' renderings are put together. Turns are dealt by range of
(conv_id, turn), so one conversation that holds a third of all rows is rendered in many tasks;
what a conversation's later ranges need of the earlier ones is one row a range.

Then every conversation of several pieces is rendered whole at growing lengths, each at least
twice the one before, and at its full length, and compared with its pieces up to there. Where they
differ, the pieces give way to one of the whole conversation, with the spans of all its prefixes
if it doesn't rewrite history. A conversation's output is thus always template(all its turns);
only rewriting that shows at none of these lengths, nor within a piece, goes unnoticed. This check
holds one conversation in memory.

Rows are ordered by turn, role, text. Null texts and roles are empty, null turns come first.
Repeated rows are turns of their own. Rows with a null conv_id form one conversation without id.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import written
from concordat.session import in_arrow, read_table

NAME = "op5_chat_format"
#: Turns of a piece.
PIECE = 32
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# --- the default template --------------------------------------------------------------------

#: Strings with a meaning to chat templates; inside a text they are broken by an escape sign.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.?)", re.DOTALL)


def escape(text: str) -> str:
    """Doubles the escape sign and puts one behind the first sign of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else m[1], text)


def escape_role(role: str) -> str:
    """escape(), with line ends as the escape sign and n: a role ends at the first line end."""
    return escape(role).replace("\n", ESCAPE + "n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: {ESCAPE: ESCAPE, "n": "\n"}.get(m[1], m[1]), role)


def marked_turns(turns: list[Turn]) -> str:
    """<|im_start|>role, a line end, the text, <|im_end|> and a line end for each turn."""
    return "".join(f"<|im_start|>{escape_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


# --- incremental rendering -------------------------------------------------------------------


class RewritesHistory(ValueError):
    """The output of a longer prefix doesn't begin with that of the shorter one."""


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def turn_spans(template: Template, turns: list[Turn], context: int = 0) -> tuple[str, list[tuple[int, int, int, int]]]:
    """What turns after the first `context` ones add to the output, and per turn (start, end,
    text start, text end) in it; the latter are -1 where what surrounds the text depends on the text,
    so that it can't be located. Raises RewritesHistory."""
    before = template(turns[:context])
    origin = len(before)
    spans = []
    for k in range(context, len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {k}")
        role = turns[k][0]
        one, two = template([*turns[:k], (role, "a")]), template([*turns[:k], (role, "b")])
        if not (one.startswith(before) and two.startswith(before)):
            raise RewritesHistory(f"turn {k}")
        head = shared_prefix(one, two)
        tail = shared_prefix(one[:head:-1], two[:head:-1])
        stop = len(now) - tail
        fits = head <= stop and now[:head] == one[:head] and now[stop:] == one[len(one) - tail :]
        spans.append((len(before) - origin, len(now) - origin, *((head - origin, stop - origin) if fits else (-1, -1))))
        before = now
    return before[origin:], spans


# --- pieces on Spark -------------------------------------------------------------------------

_PIECES = "conv_id long, part int, piece long, n_turns long, formatted string, rewritten boolean, roles array<string>, starts array<long>, ends array<long>, text_starts array<long>, text_ends array<long>"
_RAW = "conv_id long, part int, piece long, before long, alone boolean, first array<string>, previous array<string>, roles array<string>, texts array<string>"
_ROWS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _rows(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield from batch.slice(k, most).to_pylist()


def _batches(rows: Iterator[dict], columns: str, most: int = 256) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, _ROWS[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    done = []
    for row in rows:
        done.append(row)
        if len(done) == most:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns dealt by range and sorted, with the partition they are in."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartitionByRange(n, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")


def raw_pieces(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Unrendered pieces: the number within (conv_id, part), the turns before it there, whether it
    is the only one there, the first and the previous turn there, and its turns. Written."""
    ordered = ordered_turns(conversations).withColumn("part", F.spark_partition_id())

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        at, first, previous, held, number = object(), None, None, [], 0

        def taken(alone: bool) -> dict:
            conv, part = at
            return {"conv_id": conv, "part": part, "piece": number, "before": number * piece, "alone": alone, "first": first, "previous": previous, "roles": [r for r, _ in held], "texts": [t for _, t in held]}

        for row in rows:
            key, turn = (row["conv_id"], row["part"]), (row["role"], row["text"])
            if key != at:
                if held:
                    yield taken(number == 0)
                at, first, previous, held, number = key, None, None, [], 0
            elif len(held) == piece:
                yield taken(False)
                first, previous, held, number = first or held[0], held[-1], [], number + 1
            held.append(turn)
        if held:
            yield taken(number == 0)

    return written(ordered.transform(in_arrow, lambda batches: _batches(cut(_rows(batches)), _RAW), _RAW), "turns")[0]


def carried(raw: DataFrame) -> dict[tuple[int | None, int], tuple[int, Turn | None, Turn | None]]:
    """Of conversations that lie in several parts, per part how many turns come in earlier ones,
    the first and the last of them. At most one conversation crosses from a part to the next."""
    crossing = raw.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id").collect()
    ids = [r["conv_id"] for r in crossing]
    if not ids:
        return {}
    of = F.col("conv_id").isin([i for i in ids if i is not None])
    of = F.coalesce(of, F.lit(False)) | F.col("conv_id").isNull() if None in ids else of
    turn = lambda k: F.array(F.element_at("roles", k), F.element_at("texts", k))
    runs = raw.where(of).groupBy("conv_id", "part").agg(F.sum(F.size("roles")).alias("n"), F.min_by(turn(1), "piece").alias("first"), F.max_by(turn(-1), "piece").alias("last"))
    out: dict = {}
    state: dict = {}
    for r in sorted(runs.collect(), key=lambda r: r["part"]):
        before, first, last = state.get(r["conv_id"], (0, None, None))
        out[r["conv_id"], r["part"]] = before, first, last
        state[r["conv_id"]] = before + r["n"], first or tuple(r["first"]), tuple(r["last"])
    return out


def rendered(template: Template, turns: list[Turn], context: list[Turn]) -> dict:
    """Output, spans and whether history is rewritten, as columns of a piece."""
    rewritten = False
    try:
        text, spans = turn_spans(template, [*context, *turns], len(context))
    except RewritesHistory:
        text, spans, rewritten = template(turns), [], True
    columns = list(zip(*spans)) if spans else [()] * 4
    return {"n_turns": len(turns), "formatted": text, "rewritten": rewritten, "roles": [r for r, _ in turns], **{k: list(c) for k, c in zip(("starts", "ends", "text_starts", "text_ends"), columns)}}


def agrees(template: Template, turns: list[Turn], found: list[dict]) -> bool:
    """Whether the outputs of a conversation's pieces are those of its prefixes at growing lengths."""
    if any(r["rewritten"] for r in found):
        return False
    text, size, least = [], 0, 0
    for r in found:
        text.append(r["formatted"])
        size += r["n_turns"]
        if size >= least or r is found[-1]:
            text, least = ["".join(text)], 2 * size
            if template(turns[:size]) != text[0]:
                return False
    return True


def pieces(conversations: DataFrame, template: Template = marked_turns, piece: int = PIECE) -> DataFrame:
    """One row per piece: its number within (conv_id, part), its output, whether the template
    rewrote history there (the output is then that of the whole conversation, without spans), and
    of each turn the role, the span and the span of its text. Pieces of a conversation are in
    order of (part, piece). A conversation whose whole rendering differs from its pieces' is one
    piece."""
    raw = raw_pieces(conversations, piece)
    spark = conversations.sparkSession
    shared = spark.sparkContext.broadcast(carried(raw))

    def render(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            crossing = (r["conv_id"], r["part"]) in shared.value
            before, first, last = shared.value.get((r["conv_id"], r["part"]), (0, None, None))
            before, first, last = before + r["before"], first or r["first"], r["previous"] or last
            context = [tuple(t) for t in (first, last)[:before]]
            turns = list(zip(r["roles"], r["texts"]))
            yield {"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], **rendered(template, turns, context), "texts": None if r["alone"] and not crossing else r["texts"]}

    def check(rows: Iterator[dict]) -> Iterator[dict]:
        for _, group in groupby(rows, key=lambda r: r["conv_id"]):
            found = list(group)
            if len(found) > 1:
                turns = [t for r in found for t in zip(r["roles"], r["texts"])]
                if not agrees(template, turns, found):
                    found = [{**found[0], **rendered(template, turns, [])}]
            for r in found:
                yield {k: v for k, v in r.items() if k != "texts"}

    with_texts = _PIECES + ", texts array<string>"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = raw.transform(in_arrow, lambda batches: _batches(render(_rows(batches)), with_texts), with_texts)
    out = out.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return out.transform(in_arrow, lambda batches: _batches(check(_rows(batches)), _PIECES), _PIECES)


def read_back(formatted: str) -> list[Turn]:
    """Turns parsed from an output of marked_turns."""
    out = []
    for m in re.finditer(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", formatted, re.DOTALL):
        out.append((unescape_role(m[1]), unescape(m[2])))
    return out


def summaries(found: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from the pieces of marked_turns. Pieces
    stream in order through one running digest, so memory doesn't follow a conversation."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.select("conv_id", "part", "piece", "formatted", "roles", "text_starts", "text_ends").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, state = object(), None

        def flush() -> None:
            if state is not None:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    flush()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, body in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for role, a, b in zip(row["roles"], row["text_starts"], row["text_ends"]):
                    if role == "assistant":
                        body = unescape(text[a:b])
                        state[2] += len(body)
                        state[3].update(body.encode())
                state[4] += len(text)
            if len(done) >= 1024:
                yield batch_of()
                done.clear()
        flush()
        if done:
            yield batch_of()

    return ordered.transform(in_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return summaries(pieces(given.unionByName(extra)))


_ESC = r"regexp_replace(replace({0}, '\', '\\'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_ESC.format('text')}) + length({_ESC.format('role')}) + 24 AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
