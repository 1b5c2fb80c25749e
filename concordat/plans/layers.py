"""Queries that take the driver's tables through the layered run: HTML to findings.

Customers are guideline documents. Each of their orders becomes a paragraph (a recommendation, an
exception or plain text by its status), some with a heading above, a list, a table or a stray element
below. Everything after the HTML is the library's own operators; the SQL in layers_sql tells the
expected tables from the orders alone. Three documents make a group of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import canon, text
from concordat.operators import bundle, documents, metrics, normalize, segment, trace, verdicts
from concordat.operators.graph import kept
from concordat.plans import layers_sql
from concordat.session import read_table
from concordat.sources import html, registry

QUERIES: dict = {}

#: The lexicon of these guidelines, as a parsed file.
LEXICON = {
    "system": "table_lexicon",
    "concepts": [
        {"id": "drug.a", "surface": ["薬A", "drugA"]},
        {"id": "drug.b", "surface": ["薬B"]},
        {"id": "pop.adult", "surface": ["成人"], "interval": {"var": "q.age", "ge": 18}},
        {"id": "pop.child", "surface": ["小児"], "interval": {"var": "q.age", "lt": 18}},
        {"id": "cond.x", "surface": ["状態X"]},
        {"id": "cond.y", "surface": ["状態Y", "共通"]},
        {"id": "cond.z", "surface": ["共通"]},
    ],
    "actions": [{"id": "administer", "surface": ["投与"]}],
    "modality": [
        {"surface": "推奨する", "direction": "for", "strength": "strong"},
        {"surface": "推奨しない", "direction": "against", "strength": "strong"},
        {"surface": "禁忌", "direction": "contraindicate", "strength": "strong", "implies_action": "administer"},
    ],
    "certainty": [{"surface": "根拠A", "value": "high"}, {"surface": "根拠B", "value": "low"}],
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _lexicon() -> registry.Lexicon:
    return registry.lexicon(LEXICON)


def guideline_html(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, html) of every customer."""
    pieces = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr(layers_sql.PIECE).alias("piece"))
    per = pieces.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "piece"))), lambda x: x["piece"]), "").alias("pieces"))
    per = per.hint("merge")  # as in kept(): small files, large texts
    c = read_table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.concat(F.lit("doc."), "c_custkey").alias("document_id"), F.concat(F.lit("<h1>Guideline "), "c_custkey", F.lit("</h1>"), F.coalesce("pieces", F.lit(""))).alias("html"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(F.concat(F.lit("group.g"), F.floor(c / 3)).alias("group_id"), F.concat(F.lit("doc."), c).alias("document_id")).hint("merge")


def graph(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return html.tables(kept(html.extract(guideline_html(spark, sf))))


def layers(spark: SparkSession, sf: str, upto: str = "rules") -> dict[str, DataFrame]:
    """Tables of the run up to a layer: segments, bindings, statements, rules or pairs."""
    t = dict(graph(spark, sf))
    t["spans"] = kept(segment.spans_with_text(t["spans"]))
    t["segments"], t["missed"] = segment.segments(t["nodes"], t["spans"], t["regions"])
    if upto == "segments":
        return t
    t["segments"] = kept(t["segments"])
    used = t["segments"].where(F.col("kind").isin("recommendation", "exception"))
    seg_spans = normalize.segment_spans(used, t["regions"], t["spans"])
    t["bindings"] = normalize.bindings(seg_spans, _lexicon())
    if upto == "bindings":
        return t
    t["bindings"] = kept(t["bindings"])
    t["statements"], t["unread"] = normalize.statements(normalize.slots(t["segments"], seg_spans, t["bindings"], _lexicon()))
    if upto == "statements":
        return t
    t["statements"] = kept(t["statements"])
    t["exceptions"], t["loose"] = normalize.attached_exceptions(t["segments"], t["statements"], t["bindings"])
    if upto == "exceptions":
        return t
    t["exceptions"] = kept(t["exceptions"])
    t["rules"] = kept(normalize.rules(t["statements"], t["exceptions"], _lexicon()))
    if upto == "rules":
        return t
    t["pairs"] = kept(verdicts.compiled(t["rules"], groups(spark, sf)))
    t["results"] = verdicts.results(t["pairs"])
    return t


def joined(ids: str):
    return F.array_join(ids, ",")


# --- documents -------------------------------------------------------------------------------


@query
def html_graph(spark, sf):
    """Nodes with their spans: sections, lists, plain tables, empty cells and list items."""
    t = graph(spark, sf)
    nodes = t["nodes"].join(t["spans"].select("document_id", "node_id", "span_id", "raw_text", "reading_order"), ["document_id", "node_id"], "left")
    return nodes.select("document_id", "node_id", "kind", "parent_id", F.col("attrs")["row"].alias("row"), F.col("attrs")["col"].alias("col"), F.col("attrs")["header"].alias("header"), "span_id", "raw_text", "reading_order")


@query
def html_regions(spark, sf):
    r = graph(spark, sf)["regions"]
    return r.select("document_id", "region_id", joined("node_ids").alias("nodes"), joined("span_ids").alias("spans"))


@query
def html_residuals(spark, sf):
    d = graph(spark, sf)["diagnostics"]
    return d.groupBy("document_id", "code", "outcome", "detail", joined("region_ids").alias("regions")).agg(F.count("*").alias("n"))


@query
def span_texts(spark, sf):
    s = segment.spans_with_text(graph(spark, sf)["spans"])
    return s.select("document_id", "span_id", "start", "end", "search_text", "text_hash")


@query
def text_blocks(spark, sf):
    t = graph(spark, sf)
    return documents.text_blocks(t["nodes"], t["spans"])


@query
def table_cells(spark, sf):
    t = graph(spark, sf)
    return documents.table_cells(t["nodes"], t["spans"])[0]


@query
def graph_violations(spark, sf):
    """Defects put into the graphs, by document number, and found again."""
    t = graph(spark, sf)
    doc = F.regexp_extract("document_id", r"(\d+)\z", 1).cast("long")
    nodes = t["nodes"].withColumn("parent_id", F.when((doc % 10 == 1) & (F.col("node_id") == "n.1"), "n.99999").otherwise(F.col("parent_id")))
    spans = segment.spans_with_text(t["spans"])
    spans = spans.withColumn("text_hash", F.when((doc % 10 == 2) & (F.col("span_id") == "s.0"), "sha256:0").otherwise(F.col("text_hash")))
    spans = spans.withColumn("end", F.when((doc % 10 == 3) & (F.col("span_id") == "s.0"), F.col("end") + 1).otherwise(F.col("end")))
    spans = spans.withColumn("reading_order", F.when((doc % 10 == 4) & (F.col("span_id") == "s.1"), F.lit(0).cast("long")).otherwise(F.col("reading_order")))
    spans = spans.withColumn("node_id", F.when((doc % 10 == 5) & (F.col("span_id") == "s.0"), "n.88888").otherwise(F.col("node_id")))
    regions = t["regions"].withColumn("span_ids", F.when((doc % 10 == 6) & (F.col("region_id") == "r.0"), F.array(F.lit("s.77777"))).otherwise(F.col("span_ids")))
    regions = regions.unionByName(regions.where((doc % 10 == 7) & (F.col("region_id") == "r.0")))
    regions = regions.unionByName(regions.where((doc % 10 == 8) & (F.col("region_id") == "r.0")).withColumns({"region_id": F.lit("r.66666"), "node_ids": F.array().cast("array<string>"), "span_ids": F.array().cast("array<string>")}))
    extra = nodes.where((doc % 10 == 9) & (F.col("node_id") == "n.0")).withColumns({"node_id": F.lit("n.55555"), "pos": F.lit(1_000_000), "parent_id": F.lit("n.0")})
    return documents.violations(nodes.unionByName(extra), spans, regions)


# --- segments to rules -----------------------------------------------------------------------


@query
def guideline_segments(spark, sf):
    return layers(spark, sf, "segments")["segments"].select("document_id", "segment_id", "kind", joined("region_ids").alias("regions"))


@query
def unplaced_spans(spark, sf):
    return layers(spark, sf, "segments")["missed"].select("document_id", "code", "outcome", "detail", joined("region_ids").alias("regions"))


@query
def guideline_bindings(spark, sf):
    b = layers(spark, sf, "bindings")["bindings"]
    return b.select("document_id", "binding_id", "segment_id", "kind", "code", "status", joined("alternatives").alias("alternatives"), joined("region_ids").alias("regions"), "surface")


@query
def guideline_statements(spark, sf):
    s = layers(spark, sf, "statements")["statements"]
    return s.select("document_id", "statement_id", "segment_id", joined("population").alias("population"), joined("condition").alias("condition"), "action_key", "direction", "strength", "certainty")


@query
def withheld_statements(spark, sf):
    d = layers(spark, sf, "statements")["unread"]
    return d.select("document_id", "code", "outcome", "detail", joined("region_ids").alias("regions"))


@query
def guideline_exceptions(spark, sf):
    t = layers(spark, sf, "exceptions")
    kept_ones = t["exceptions"].select("document_id", F.col("exception_id").alias("what"), "statement_id", joined("codes").alias("codes"), joined("region_ids").alias("regions"))
    return kept_ones.unionByName(t["loose"].select("document_id", F.col("detail").alias("what"), F.lit("").alias("statement_id"), F.col("code").alias("codes"), joined("region_ids").alias("regions")))


@query
def guideline_rules(spark, sf):
    r = layers(spark, sf)["rules"]
    return r.select("document_id", "rule_id", normalize.rule_json().alias("payload"), joined("source_region_ids").alias("regions"))


# --- pairs to findings -----------------------------------------------------------------------


@query
def compiled_pairs(spark, sf):
    p = layers(spark, sf, "pairs")["pairs"]
    return p.select("group_id", "n", "pair_id", "action_key", "a_id", "b_id", "q1_id", "q2_id", "overlap", F.sha2("q1_body", 256).alias("q1_sha"), F.sha2("q2_body", 256).alias("q2_sha"))


@query
def assertion_map(spark, sf):
    return verdicts.assertion_map(layers(spark, sf, "pairs")["pairs"]).withColumn("region_ids", joined("region_ids"))


@query
def profile_gate(spark, sf):
    """Rules with an interval atom, under a profile without them."""
    return verdicts.outside_profile(layers(spark, sf)["rules"], ("concept", "concept_negated"))


@query
def query_results(spark, sf):
    r = layers(spark, sf, "pairs")["results"]
    return r.select("group_id", "n", "seq", "query_id", "role", "category", "verdict", joined("core").alias("core"))


@query
def guideline_findings(spark, sf):
    t = layers(spark, sf, "pairs")
    f = verdicts.findings(t["results"], t["pairs"], t["regions"], t["spans"])
    return f.select("finding_id", "group_id", "query_id", "part", "category", "verdict", "conflict_kind", joined("core").alias("core"), joined("rules").alias("rules"), F.array_join("quoted", " | ").alias("quoted"))


@query
def finding_lineage(spark, sf):
    t = layers(spark, sf, "pairs")
    return trace.lineage(t["pairs"], t["results"], t["rules"], t["statements"]).withColumn("region_ids", joined("region_ids"))


@query
def fresh_lineage(spark, sf):
    """Lineage where every fifth document's bundle was compiled in another state."""
    t = layers(spark, sf, "pairs")
    doc = F.regexp_extract("document_id", r"(\d+)\z", 1).cast("long")
    members = groups(spark, sf)
    bundles = members.select("document_id", F.concat("document_id", F.lit(".bundle")).alias("bundle_id"), text.sha256(F.concat("document_id", F.when(doc % 5 == 0, F.lit(" changed")).otherwise(F.lit("")))).alias("hash"))
    built = members.groupBy("group_id").agg(F.concat("group_id", F.lit(".compiled")).alias("artifact_id"), F.collect_list(text.sha256("document_id")).alias("input_hashes"))
    fresh = trace.consumed(built, members, bundles)
    lin = trace.lineage(t["pairs"], t["results"], t["rules"], t["statements"], fresh)
    return lin.groupBy("document_id").agg(F.count("*").alias("n")).join(fresh.select("document_id", "from_id", "to_id").hint("merge"), "document_id")


@query
def trace_edges(spark, sf):
    t = layers(spark, sf, "pairs")
    return trace.edges(kept(trace.lineage(t["pairs"], t["results"], t["rules"], t["statements"])), t["regions"])


@query
def group_scores(spark, sf):
    """Groups of number 0 modulo 3 are expected to be free of conflicts, others to have one, that of
    their first pair."""
    t = layers(spark, sf, "pairs")
    first = t["pairs"].where("n = 1").select("group_id", F.array(F.concat(F.lit("a."), "b_id"), F.concat(F.lit("a."), "a_id")).alias("expected_unsat_core"))
    number = F.regexp_extract("group_id", r"(\d+)\z", 1).cast("long")
    reference = groups(spark, sf).select("group_id").distinct().join(first, "group_id", "left").select("group_id", F.when(number % 3 == 0, "semantic_no_conflict").otherwise("semantic_contradiction").alias("expected_outcome"), "expected_unsat_core", (number % 2 == 0).alias("expected_no_conflict_result"))
    return verdicts.group_outcomes(t["results"], reference)


@query
def verdict_prints(spark, sf):
    t = layers(spark, sf, "pairs")
    return metrics.verdict_fingerprint(t["pairs"], t["results"]).select("group_id", text.sha256("print").alias("print_hash"))


@query
def layer_components(spark, sf):
    """The component index of all layers: uses of each, and the hashes that can be told from a
    component's name alone (actions and concepts)."""
    t = layers(spark, sf, "pairs")
    plan = t["pairs"].select(F.col("a_document_id").alias("document_id"), F.concat("group_id", F.lit("/"), "pair_id").alias("pair_id"), "action_key", F.concat(F.lit("fc."), "a_id").alias("constraint_a_id"), F.concat(F.lit("fc."), "b_id").alias("constraint_b_id"))
    found = bundle.components(t["bindings"], t["statements"], t["rules"], t["segments"], t["exceptions"], bundle.constraints(t["rules"]), plan)
    return found.select("kind", "component", F.size("uses").cast("long").alias("n_uses"), F.sha2(F.array_join("uses", "\n"), 256).alias("uses_sha"), F.when(F.col("kind").isin("action", "concept"), F.col("hash")).alias("name_hash"))


@query
def bundle_breaks(spark, sf):
    """Bundles are assembled, spoiled by document number, and checked: the first break of each."""
    t = layers(spark, sf)
    b = bundle.assemble(t)
    doc = F.regexp_extract("document_id", r"(\d+)\z", 1).cast("long")
    first = lambda column, value: (doc % 10 == value) & (F.col(column).rlike(r"(\A|\.)0\z"))
    b["segments"] = b["segments"].withColumn("region_ids", F.when(first("segment_id", 1), F.array(F.lit("r.99999"))).otherwise(F.col("region_ids")))
    b["statements"] = b["statements"].withColumn("action_key", F.when(first("statement_id", 2), F.lit("administer:other")).otherwise(F.col("action_key")))
    b["rules"] = b["rules"].withColumn("source_region_ids", F.when(first("rule_id", 3), F.array().cast("array<string>")).otherwise(F.col("source_region_ids")))
    b["constraints"] = b["constraints"].withColumn("strength", F.when(first("rule_id", 4), F.lit("weak")).otherwise(F.col("strength")))
    b["components"] = b["components"].withColumn("uses", F.when((doc % 10 == 5) & (F.col("kind") == "segment") & F.col("component").endswith("/seg.0"), F.array(F.lit("nobody"))).otherwise(F.col("uses")))
    b["hashes"] = b["hashes"].withColumn("hash", F.when((doc % 10 == 6) & (F.col("layer") == "norm"), F.lit("sha256:0")).otherwise(F.col("hash")))
    b["blocks"] = b["blocks"].withColumn("raw_text", F.when((doc % 10 == 7) & (F.col("span_id") == "s.0"), F.lit("other")).otherwise(F.col("raw_text")))
    b["bindings"] = b["bindings"].unionByName(b["bindings"].where((doc % 10 == 8) & (F.col("binding_id") == "bind.0")))
    return bundle.first_break(bundle.validate(b)).select("document_id", "kind")


@query
def run_hashes(spark, sf):
    """Replay: the rules of one run against those of a repetition in which every seventh document's
    strength differs, as row hashes with their sides."""
    from concordat.operators import sets

    r = layers(spark, sf)["rules"]
    doc = F.regexp_extract("document_id", r"(\d+)\z", 1).cast("long")
    again = r.withColumn("strength", F.when(doc % 7 == 0, F.lit("weak")).otherwise(F.col("strength")))
    row = lambda df: df.select(canon.content_hash(normalize.rule_json()).alias("hash"))
    return sets.difference(row(r), row(again))
