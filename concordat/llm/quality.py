"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence comes from two logistic regressions (low quality, toxic) over which
words and word beginnings it holds and over binned figures of its text. The chance that it is good is carried up by
grouped aggregation: the share of good documents of each host is drawn towards the global share,
that of each path of a host towards its host's. How strongly is fitted to the data (method of
moments on the variance between hosts, and between paths within hosts), so sparse sites lean on
what is above them. A document's log-odds are its own plus what its path's posterior differs from
the global share.

The regressions are fitted on at most MOST_LABELLED labelled rows (smallest hashes of doc_id) and
MOST_WORDS words; a labelled doc_id with several texts counts once, with the least of them. All counts
and posteriors cover all documents. One narrow pass over the texts, whose chances are written, and one
small aggregation; site tables are joined by size, so they are broadcast only when small.

Hosts and paths are columns of the caller's. The given documents have no addresses, so judged() takes
the source for the host and, for want of a path, the language for the path.

Null texts count as empty and are judged like other texts. Null hosts and paths form a group of
their own. Labels with a null are left out; without labels of both kinds a regression says
nothing (chance 0 of the fault). Repeated rows are judged each and count each in their site.
Columns named like the added ones are replaced, others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import ALNUM_WORD, ASCII_LOWER, byte_table, byte_words, list_column, mix64, text_groups, written
from concordat.session import in_arrow, read_table

NAME = "op10_quality"
MOST_LABELLED, MOST_WORDS, LEAST_ROWS, BINS = 8192, 6000, 5, 12
#: Standard errors by which a word's share must differ between labels to be a feature.
LEAST_LIFT = 4.0
FIGURES = 10
#: Bytes of word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6)
_SYMBOL = byte_table(map(ord, "!\"#$%&*+/<=>@[\\]^_`{|}~")).astype(np.int64)
_DIGIT = byte_table(range(0x30, 0x3A)).astype(np.int64)
_UPPER = byte_table(range(0x41, 0x5B)).astype(np.int64)


# --- evidence of a text ---------------------------------------------------------------------


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures (rows x FIGURES), and 32-bit hashes of words and of their beginnings with the row of
    each (words once for each row that holds them, beginnings as they come)."""
    rows = len(offsets) - 1
    starts, ends, h, first = byte_words(data, offsets, ALNUM_WORD, ASCII_LOWER)
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    fresh = np.ones(len(hs), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(fresh)
    distinct = np.bincount(rs[at], minlength=rows)
    run = np.diff(np.append(at, len(hs)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, rs[at], run)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    size = np.maximum(1, np.diff(offsets))
    words = np.maximum(1, count)
    raw = data.tobytes()
    lines = [raw[a:b].split(b"\n") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    figures = np.stack(
        [
            np.log2(1 + count),
            distinct / words,
            top / words,
            per_row(ends - starts, first) / words,
            per_row(_SYMBOL[data], offsets) / size,
            per_row(_DIGIT[data], offsets) / size,
            per_row(_UPPER[data], offsets) / size,
            np.array([len(set(x)) / len(x) for x in lines]) if rows else np.zeros(0),
            np.bincount(row[same], minlength=rows) / words,
            count / size,
        ],
        axis=1,
    )
    hashes, owners = [hs[at]], [rs[at]]
    lower = ASCII_LOWER[data].astype(np.uint64)
    begin = np.zeros(len(starts), np.uint64)
    for k in range(1, max(PREFIXES) + 1):
        long = ends - starts > k
        starts, ends, begin, row = starts[long], ends[long], begin[long], row[long]
        begin = mix64(begin + lower[starts + k - 1] + np.uint64(1))
        if k in PREFIXES:
            hashes.append(begin ^ np.uint64(k))
            owners.append(row)
    return figures, (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), np.concatenate(owners)


@dataclass
class Evidence:
    """Weights of the regressions: one column each for low quality and toxic."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    word_weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((FIGURES, BINS - 1)))
    bin_weight: np.ndarray = field(default_factory=lambda: np.zeros((FIGURES, BINS, 2)))
    bias: np.ndarray = field(default_factory=lambda: np.full(2, -40.0))

    def bins(self, figures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[k], figures[:, k], side="right") for k in range(FIGURES)], axis=1)

    def chances(self, figures: np.ndarray, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Chance of low quality and of toxicity per row."""
        score = np.tile(self.bias, (len(figures), 1))
        which = self.bins(figures)
        for k in range(FIGURES):
            score += self.bin_weight[k, which[:, k]]
        if len(self.words) and len(words):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[place] == words
            row, place = np.divmod(np.unique(row[hit] * len(self.words) + place[hit]), len(self.words))
            for k in range(2):
                score[:, k] += np.bincount(row, self.word_weight[place, k], minlength=len(score))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def regress(row: np.ndarray, column: np.ndarray, rows: int, columns: int, y: np.ndarray, steps: int = 250, rate: float = 0.15, shrink: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features given as (row, column), by Adam on all rows."""
    w, m, v = np.zeros(columns + 1), np.zeros(columns + 1), np.zeros(columns + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], minlength=rows) + w[-1], -40, 40)))
        error = (p - y) / rows
        g = np.append(np.bincount(column, error[row], minlength=columns) + shrink * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(figures: np.ndarray, words: list[np.ndarray], low: np.ndarray, toxic: np.ndarray) -> Evidence:
    """Evidence from described rows and their 0/1 labels."""
    e = Evidence()
    if not len(figures):
        return e
    e.cuts = np.stack([np.quantile(figures[:, k], np.arange(1, BINS) / BINS) for k in range(FIGURES)])
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    known, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    lift = np.zeros(len(known))
    for y in (low, toxic):
        if 0 < y.mean() < 1:
            held = np.bincount(column, y[row], minlength=len(known))
            rest = count - held
            a, b = held / max(1, y.sum()), rest / max(1, (1 - y).sum())
            lift = np.maximum(lift, np.abs(a - b) / np.sqrt((a + b + 1e-9) / 2 * (1 / max(1, y.sum()) + 1 / max(1, (1 - y).sum()))))
    keep = (count >= LEAST_ROWS) & (count < len(words)) & (lift >= LEAST_LIFT)
    lift[~keep] = -1
    chosen = np.sort(np.lexsort((known, -lift))[: min(MOST_WORDS, int(keep.sum()))])
    e.words = known[chosen]
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    hit = place[column] >= 0
    which = e.bins(figures)
    n = len(chosen)
    rows = np.concatenate([row[hit], np.repeat(np.arange(len(figures)), FIGURES)])
    columns = np.concatenate([place[column[hit]], (n + np.arange(FIGURES) * BINS + which).ravel()])
    e.word_weight, e.bin_weight, e.bias = np.zeros((n, 2)), np.zeros((FIGURES, BINS, 2)), np.full(2, -40.0)
    for k, y in enumerate((low, toxic)):
        if 0 < y.mean() < 1:
            w, bias = regress(rows, columns, len(figures), n + FIGURES * BINS, y)
            e.word_weight[:, k], e.bin_weight[:, :, k], e.bias[k] = w[:n], w[n:].reshape(FIGURES, BINS), bias
    return e


def frequent(column: pa.ChunkedArray, buckets: int = 1 << 20, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a list column whose bucket has LEAST_ROWS of them (a superset of those that
    do themselves), and where each row begins: most hashes are rare and needn't be sorted."""
    parts = [(c.flatten().to_numpy().view(np.uint32), c.value_lengths().to_numpy()) for c in column.chunks]
    mask = np.uint32(buckets - 1)
    total = np.zeros(buckets, np.int64)
    for values, _ in parts:
        for a in range(0, len(values), step):
            total += np.bincount((values[a : a + step] & mask).astype(np.int64), minlength=buckets)
    enough = total >= LEAST_ROWS
    kept, sizes = [], []
    for values, length in parts:
        hit = np.concatenate([enough[(values[a : a + step] & mask).astype(np.int64)] for a in range(0, max(1, len(values)), step)])
        kept.append(values[hit])
        sizes.append(per_row(hit, np.concatenate([[0], np.cumsum(length)])))
    return np.concatenate(kept), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Evidence:
    """Evidence from labels (doc_id, quality, toxic) of documents (doc_id, text). The labels used are
    at most `most` rows of three numbers, so they are broadcast."""
    few = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic").orderBy(F.xxhash64(F.lit("label"), "doc_id"), "doc_id", "quality", "toxic").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(0)):
                figures, words, row = describe(data, offsets)
                order = np.lexsort((words, row))
                words, row = words[order], row[order]
                fresh = np.ones(len(words), bool)
                fresh[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
                words, count = words[fresh], np.bincount(row[fresh], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [list_column(figures.ravel(), np.full(b - a, FIGURES), pa.float64()), list_column(words.view(np.int32), count, pa.int32()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)],
                    names=["figures", "words", "low", "toxic"],
                )

    found = docs.select("doc_id", "text").join(F.broadcast(few.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id")).groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    rows = found.select("text", (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    table = rows.transform(in_arrow, run, "figures array<double>, words array<int>, low int, toxic int").toArrow()
    if not table.num_rows:
        return Evidence()
    flat, cut = frequent(table.column("words"))
    figures = table.column("figures").combine_chunks().flatten().to_numpy().reshape(-1, FIGURES)
    # rows come in any order; the fit must not depend on it
    order = np.lexsort((*figures.T, cut[1:] - cut[:-1]))
    low, toxic = (table.column(c).to_numpy().astype(float) for c in ("low", "toxic"))
    return fit(figures[order], [flat[cut[i] : cut[i + 1]] for i in order], low[order], toxic[order])


def with_evidence(df: DataFrame, evidence: Evidence, text: str = "text", drop: bool = False) -> DataFrame:
    """df with p_low, p_toxic and p_doc, the chance that neither holds; drop: without its text."""
    added = ("p_low", "p_toxic", "p_doc")
    keep = [c for c in df.columns if c not in added]
    rest = [c for c in keep if not (drop and c == text)]
    shared = df.sparkSession.sparkContext.broadcast(evidence)
    at, where = keep.index(text), [keep.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(at)):
                p = e.chances(*describe(data, offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in where), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((1 - p[:, 0]) * (1 - p[:, 1]))], names=[*rest, *added])

    columns = lambda names: df.select(*[F.col(f"`{c}`") for c in names])
    return columns(keep).transform(in_arrow, run, columns(rest).schema.add("p_low", "double").add("p_toxic", "double").add("p_doc", "double"))


# --- sites ----------------------------------------------------------------------------------


def strength(share: float, between: float, sampling: float) -> float:
    """Pseudo-count of a prior: how many documents it weighs, from the variance between groups
    beyond that of sampling. Without any such variance groups lean on the prior alone."""
    beyond = between - sampling
    within = share * (1 - share)
    return 1e9 if beyond <= 1e-9 else max(1.0, within / beyond - 1)


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path", p: str = "p_doc") -> tuple[DataFrame, float]:
    """Per (host, path) the posterior shares p_host and p_path, and the global share. The two
    strengths and the share are the only figures that come to the driver."""
    paths, _ = written(scored.groupBy(host, path).agg(F.sum(p).alias("s"), F.count(F.lit(1)).alias("n")), "sites")
    hosts = paths.groupBy(host).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    g = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    if not g["n"]:
        return paths.select(host, path, F.lit(0.5).alias("p_host"), F.lit(0.5).alias("p_path")), 0.5
    share = min(max(g["s"] / g["n"], 1e-6), 1 - 1e-6)
    spread = F.pow(F.col("hs") / F.col("hn") - F.lit(share), 2)
    v = hosts.agg(F.avg(spread).alias("b"), F.avg(F.lit(share * (1 - share)) / F.col("hn")).alias("w")).first()
    k_host = strength(share, v["b"], v["w"])
    hosts = hosts.withColumn("p_host", (F.col("hs") + F.lit(k_host * share)) / (F.col("hn") + F.lit(k_host)))
    joined = paths.join(hosts.withColumnRenamed(host, "__of"), F.col(host).eqNullSafe(F.col("__of"))).drop("__of")
    inside = F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)
    v = joined.agg(F.avg(inside).alias("b"), F.avg(F.col("p_host") * (1 - F.col("p_host")) * (1 / F.col("n") - 1 / F.col("hn"))).alias("w")).first()
    k_path = strength(share, v["b"], v["w"])
    return joined.select(host, path, "p_host", ((F.col("s") + F.lit(k_path) * F.col("p_host")) / (F.col("n") + F.lit(k_path))).alias("p_path")), share


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def classify(df: DataFrame, evidence: Evidence, host: Column, path: Column, text: str = "text", least: float = 0.5, drop: bool = False) -> DataFrame:
    """df with p_low, p_toxic, p_doc (its own evidence), p_host, p_path (posterior shares of good
    documents of its site), p_good and keep (p_good >= least); drop: without its text."""
    added = ("p_low", "p_toxic", "p_doc", "p_host", "p_path", "p_good", "keep")
    names = [c for c in df.columns if c not in added]
    given = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], host.alias("host"), path.alias("path"))
    own = f"c{names.index(text)}"
    scored, _ = written(with_evidence(given, evidence, own, drop), "evidence")
    sites, share = site_posteriors(scored)
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    z = log_odds(F.col("p_doc")) + log_odds(F.coalesce("p_path", F.lit(share))) - F.lit(math.log(share / (1 - share)))
    out = out.withColumn("p_good", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("p_good") >= least)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if not (drop and f"c{i}" == own)], *added)


def judged(docs: DataFrame, spark: SparkSession, sf_dir: str, drop: bool = False) -> DataFrame:
    """Documents (doc_id, text, lang, source, ...) with the columns of classify(): hosts are
    sources, paths the languages within them."""
    evidence = learn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return classify(docs, evidence, F.col("source"), F.col("lang"), drop=drop)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, spark, sf_dir, drop=True).select("doc_id", "p_low", "p_toxic", "p_doc", "p_host", "p_path", "p_good", "keep")
