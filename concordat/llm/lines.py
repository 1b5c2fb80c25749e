"""Line dedup over windows of three consecutive lines.

Every three consecutive lines of a text are one window, known by 128 bits of hashes. A window
that occurs earlier (in a document with a smaller doc_id, or further up in the same one) is a
repeat, and all lines that repeats cover go. Overlapping windows merge by their positions.

Lines end at a line feed. Texts of fewer than three lines have no window and stay as they are, as
do null and empty texts. Windows of three blank lines don't count. Rows with the same doc_id are
one document; a row with a null doc_id loses only repeats within itself and is never the first
place of a window. A text that loses nothing is returned unchanged; the rest keep the order of
their lines. Extra columns pass through, whatever they are called; `n_lines` and `n_removed` replace
columns of that name.
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

NAME = "op8_line_dedup"
WINDOW = 3

_U = np.uint64


def line_windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each window; those of blank windows are 0."""
    lines = text.split(b"\n")
    n = len(lines) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), ">u8").astype(_U).reshape(-1, 2)
    blank = np.array([not x.strip() for x in lines])
    out = []
    for k in range(2):
        h = np.zeros(n, _U)
        for j in range(WINDOW):
            h = mix64(h + wide[j : j + n, k])
        out.append(h)
    empty = np.logical_and.reduce([blank[j : j + n] for j in range(WINDOW)])
    for h in out:
        h[empty] = 0
    return out[0].view(np.int64), out[1].view(np.int64)


def keys(text: bytes) -> list[tuple[int, int] | None]:
    """The digests of each window; None for blank ones."""
    one, two = line_windows(text)
    return [None if not x else (x, y) for x, y in zip(one.tolist(), two.tolist())]


def real_windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    one, two = line_windows(text)
    keep = one != 0
    return one[keep], two[keep]


def removed_lines(text: bytes, doc_id: int | None, known: dict) -> np.ndarray:
    """Whether each line is covered by a repeated window."""
    windows = keys(text)
    gone = np.zeros(text.count(b"\n") + 1, bool)
    if windows:
        at = np.flatnonzero(masks(windows, doc_id, known)[0])
        for j in range(WINDOW):
            gone[at + j] = True
    return gone


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeated lines gone from its text, and n_lines and n_removed (null for null texts)."""

    def edit(raw: bytes, key: int | None, known: dict) -> tuple:
        gone = removed_lines(raw, key, known)
        new = b"\n".join([x for x, g in zip(raw.split(b"\n"), gone.tolist()) if not g]).decode() if gone.any() else None
        return new, len(gone), int(gone.sum())

    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    return dedup(df, doc_id, text, real_windows, "long", edit, added, [pa.int64(), pa.int64()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, k, ls[k] || chr(10) || ls[k + 1] || chr(10) || ls[k + 2] AS w FROM l, unnest(range(1, greatest(len(ls) - 1, 1))) AS u(k) WHERE len(ls) >= 3),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS first, min(k) OVER (PARTITION BY w, doc_id) AS top FROM w WHERE trim(replace(w, chr(10), ' ')) <> ''),
gone AS (SELECT DISTINCT doc_id, k + o AS p FROM r, (VALUES (0), (1), (2)) AS v(o) WHERE first < doc_id OR top < k),
rest AS (SELECT l.doc_id, string_agg(ls[p], chr(10) ORDER BY p) AS t, count(*) AS n
         FROM l, unnest(range(1, len(ls) + 1)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.p = u.p) GROUP BY l.doc_id)
SELECT l.doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM l LEFT JOIN rest ON rest.doc_id = l.doc_id
"""
