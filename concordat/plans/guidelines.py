"""The layered run: guideline HTML to findings, as one plan per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators import normalize, segment, trace, verdicts
from concordat.operators.graph import kept
from concordat.sources import html
from concordat.sources.registry import Lexicon


def run(docs: DataFrame, groups: DataFrame, lexicon: Lexicon, root: str | None = None) -> dict[str, DataFrame]:
    """All tables of a run over documents (document_id, html) and groups (group_id, document_id).

    Tables that several later ones read (the extracted rows, spans with folded text, rules) are
    written once to the shared folder; everything else stays lazy."""
    rows = kept(html.extract(docs, root))
    graph = html.tables(rows)
    spans = kept(segment.spans_with_text(graph["spans"]))
    segments, missed = segment.segments(graph["nodes"], spans, graph["regions"])
    segments = kept(segments)
    used = segments.where(F.col("kind").isin("recommendation", "exception"))
    seg_spans = normalize.segment_spans(used, graph["regions"], spans)
    bound = kept(normalize.bindings(seg_spans, lexicon))
    doubtful = bound.where("status = 'ambiguous'").select("document_id", F.lit("terminology_ambiguous").alias("code"), F.lit("ambiguity").alias("outcome"), F.concat_ws(" ", "surface", F.array_join("alternatives", ",")).alias("detail"), "region_ids")
    stmts, unread = normalize.statements(normalize.slots(segments, seg_spans, bound, lexicon))
    stmts = kept(stmts)
    exceptions, loose = normalize.attached_exceptions(segments, stmts, bound)
    exceptions = kept(exceptions)
    rules = kept(normalize.rules(stmts, exceptions, lexicon))
    found = kept(verdicts.compiled(rules, groups))
    results = kept(verdicts.results(found))
    lin = trace.lineage(found, results, rules, stmts)
    diagnostics = graph["diagnostics"].unionByName(missed).unionByName(doubtful).unionByName(unread).unionByName(loose)
    return {
        "nodes": graph["nodes"], "spans": spans, "regions": graph["regions"], "segments": segments, "bindings": bound, "statements": stmts, "exceptions": exceptions,
        "rules": rules.withColumn("payload", normalize.rule_json()), "pairs": found, "assertions": verdicts.assertion_map(found), "results": results,
        "findings": verdicts.findings(results, found, graph["regions"], spans), "lineage": lin, "edges": trace.edges(lin, graph["regions"]), "diagnostics": diagnostics,
    }
