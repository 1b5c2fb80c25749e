"""Units of text (line windows, runs of chunks) that occur in more than one place.

A unit is known by two digests. Within a document a unit is named once, so a unit that a third of
all documents hold has one row for each of them. Counting pre-aggregates before its shuffle; the
join back is a plain equi-join that Spark may split where keys are hot. The units are computed once
for the count and once for the join: writing them would take more disk than reading texts twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import list_column, text_groups, written
from concordat.session import in_arrow

#: Two digests of each of a text's units in order, signed.
Units = Callable[[bytes], tuple[np.ndarray, np.ndarray]]

#: Bytes of text after which a batch of results is handed on.
_FLUSH = 4 << 20


def distinct_units(docs: DataFrame, units: Units, second: str) -> DataFrame:
    """(doc_id, h1, h2) for each distinct unit of each document with an id; second: the type of h2."""
    kind = {"long": pa.int64(), "int": pa.int32()}[second]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1)):
                raw = data.tobytes()
                one, two, count = [], [], []
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    h1, h2 = units(raw[s:e])
                    order = np.lexsort((h2, h1))
                    h1, h2 = h1[order], h2[order]
                    fresh = np.ones(len(h1), bool)
                    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                    one.append(h1[fresh]), two.append(h2[fresh]), count.append(int(fresh.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_column(np.concatenate(one), count, pa.int64()), list_column(np.concatenate(two), count, kind)], names=["doc_id", "h1", "h2"])

    listed = docs.where("doc_id is not null").select("doc_id", "text").transform(in_arrow, run, f"doc_id long, h1 array<long>, h2 array<{second}>")
    return listed.select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")


def repeated_units(docs: DataFrame, units: Units, second: str) -> DataFrame:
    """Per document that holds repeated units: h1 and h2, their digests, and `first`, the smallest
    document with each. Written. docs: doc_id, text."""
    rows = distinct_units(docs, units, second)
    twice = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    found = rows.join(twice, ["h1", "h2"]).groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2", "first")).alias("u"))
    return written(found.select("doc_id", "u.h1", "u.h2", "u.first"), "repeats")[0]


def masks(units: list[Hashable | None], doc_id: int | None, known: dict[Hashable, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the units of a document in order (None: no unit): whether an earlier place holds the unit
    too, whether any other place does, and the document where it is first (-1: no id). known: the
    first documents of units that several hold."""
    n = len(units)
    own = -1 if doc_id is None else doc_id
    if not known and len(set(units)) == n and None not in units:
        return np.zeros(n, bool), np.zeros(n, bool), np.full(n, own, np.int64)
    earlier, elsewhere, source = [], [], []
    count, seen = Counter(units), set()
    for u in units:
        first = known.get(u, own)
        real = u is not None
        earlier.append(real and (u in seen or first != own))
        elsewhere.append(real and (u in known or count[u] > 1))
        source.append(first)
        seen.add(u)
    return np.array(earlier, bool), np.array(elsewhere, bool), np.array(source, np.int64)


def dedup(df: DataFrame, doc_id: str, text: str, units: Units, second: str, edit: Callable[[bytes, int | None, dict], tuple], added: list[T.StructField], kinds: list[pa.DataType]) -> DataFrame:
    """df with its text edited and the columns `added`, which replace columns of these names.
    edit(text, doc_id, known) gives the new text (None: as it is) and the added values; a null text
    stays null, with nulls. Columns go by position, so their names are free."""
    names = [f.name for f in added]
    keep = [c for c in df.columns if c not in names]
    at_text, at_id = keep.index(text), keep.index(doc_id)
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    given = kept.toDF(*[f"c{i}" for i in range(len(keep))]).withColumn("id", F.col(f"c{at_id}").cast("long"))
    found = repeated_units(given.select(F.col("id").alias("doc_id"), F.col(f"c{at_text}").alias("text")), units, second)
    joined = given.join(found.withColumnRenamed("doc_id", "id"), "id", "left").select("id", "h1", "h2", "first", *[f"c{i}" for i in range(len(keep))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            begin = size = 0

            def out(end: int) -> pa.RecordBatch:
                columns = [c.slice(begin, end - begin) for c in batch.columns[4:]]
                texts, *values = zip(*rows)
                columns[at_text] = pa.array(texts, columns[at_text].type)
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, k) for v, k in zip(values, kinds))], names=[*keep, *names])

            for k, (key, h1, h2, first, value) in enumerate(zip(*(batch.column(i) for i in range(4)), batch.column(4 + at_text))):
                value = value.as_py()
                if value is None:
                    rows.append((None, *[None] * len(names)))
                else:
                    known = dict(zip(zip(h1.as_py(), h2.as_py()), first.as_py())) if h1.is_valid else {}
                    new, *values = edit(value.encode(), key.as_py(), known)
                    rows.append((value if new is None else new, *values))
                    size += len(value)
                if size > _FLUSH:
                    yield out(k + 1)
                    rows, begin, size = [], k + 1, 0
            if rows:
                yield out(batch.num_rows)

    return joined.transform(in_arrow, run, T.StructType([*kept.schema, *added]))
