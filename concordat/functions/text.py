"""String policies, dictionary scans and hashes. All but NFKC are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.session import ship

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that is folded to single spaces, as a character class.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation (Arrow batches; Spark has no built-in for it)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def raw_source(c: Column | str) -> Column:
    return _col(c)


def source_nfkc(c: Column | str) -> Column:
    ship(SparkSession.active())
    return nfkc(_col(c))


def folded(c: Column | str) -> Column:
    """White space collapsed and trimmed; for text that is in NFKC."""
    return F.trim(F.regexp_replace(_col(c), WHITE, " "))


def diagnostic_text(c: Column | str) -> Column:
    return folded(source_nfkc(c))


def _ja(c: Column) -> Column:
    return F.translate(c, "、。", ",.")


def semantic_ja(c: Column | str) -> Column:
    return _ja(diagnostic_text(c))


def semantic_en(c: Column | str) -> Column:
    return ascii_lower(semantic_ja(c))


def ascii_lower(c: Column | str) -> Column:
    """A-Z alone; lower() would fold other scripts too."""
    return F.translate(_col(c), _UPPER, _LOWER)


def semantic_en_ascii(c: Column | str) -> Column:
    """semantic_en of text that NFKC leaves as it is (ASCII, for instance): no Python."""
    return ascii_lower(_ja(folded(c)))


def identifier_ascii(c: Column | str) -> Column:
    """The identifier, or null if it is not one or more of a-z 0-9 _ : . / -"""
    return F.when(_col(c).rlike(r"\A[a-z0-9_:./-]+\z"), _col(c))


def require(value: Column, what: str) -> Column:
    """value, or an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(what)))


def byte_length(c: Column | str) -> Column:
    return F.octet_length(_col(c))


def byte_slice(c: Column | str, start: Column | int, end: Column | int) -> Column:
    """Bytes start (from 0) to end of the UTF-8 text, as text."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.decode(F.substring(F.encode(_col(c), "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


# --- hashes ----------------------------------------------------------------------------------


def sha256(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(c), 256))


def set_hash(hashes: Column | str) -> Column:
    """Of an array: sorted, each once, one to a line."""
    return sha256(F.array_join(F.sort_array(F.array_distinct(_col(hashes))), "\n"))


def hex_text(c: Column | str) -> Column:
    return F.lower(F.hex(F.encode(_col(c), "UTF-8")))


def unhex_text(c: Column | str) -> Column:
    """Text of lower-case hex, or null for anything else."""
    c = _col(c)
    return F.when(c.rlike(r"\A([0-9a-f]{2})*\z"), F.decode(F.unhex(c), "UTF-8"))


# --- dictionary scans ------------------------------------------------------------------------


def alternation(surfaces: list[str]) -> str:
    """A pattern that takes the longest surface at each place, as literals."""
    ordered = sorted(set(surfaces), key=lambda s: (-len(s.encode()), s.encode()))
    return "(" + "|".join(re.escape(s) for s in ordered) + ")"


def scan(c: Column | str, surfaces: list[str]) -> Column:
    """Surfaces found from left to right, longest first, without overlaps; repeats are kept."""
    return F.regexp_extract_all(_col(c), F.lit(alternation(surfaces)), F.lit(1))


def contains_any(c: Column | str, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | _col(c).contains(m)
    return found


def close_spellings(words: DataFrame, lexicon: DataFrame, most: int = 1) -> DataFrame:
    """(word, surface, distance) of lexicon surfaces within an edit distance. Deletion variants
    are joined (within distance 1 two words share one), then distances are verified."""
    if most != 1:
        raise ValueError("distance 1 only")
    cut = lambda c: F.array_union(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))
    a = words.select("word", F.explode(cut(F.col("word"))).alias("key"))
    b = lexicon.select("surface", F.explode(cut(F.col("surface"))).alias("key"))
    return a.join(b, "key").select("word", "surface").distinct().withColumn("distance", F.levenshtein("word", "surface")).where(F.col("distance") <= most)
