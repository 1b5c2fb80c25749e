"""Lineage from findings back to quoted text, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order; every edge of a trace climbs.
RANK = {"source": 0, "span": 1, "segment": 2, "statement": 3, "rule": 4, "query": 5, "verdict": 6, "finding": 7}


#: Artifacts of a run in order, each with the operation of the edges that lead to it.
ARTIFACTS = {"source": None, "source_document_graph": "extract", "segments": "segment", "normalization": "normalize", "ir_bundle": "assemble", "compiled": "compile", "verifier_results": "verify", "report": "report"}


def consumed(compiled: DataFrame, members: DataFrame, bundles: DataFrame) -> DataFrame:
    """(group_id, document_id, from_id, operation, to_id): edges from bundles to the compiled artifact
    of their group, only where the bundle's hash is among the artifact's input hashes. compiled:
    group_id, artifact_id, input_hashes; members: group_id, document_id; bundles: document_id,
    bundle_id, hash."""
    joined = members.join(bundles, "document_id").join(compiled, "group_id")
    return joined.where(F.expr("array_contains(input_hashes, hash)")).select("group_id", "document_id", F.col("bundle_id").alias("from_id"), F.lit("compile").alias("operation"), F.col("artifact_id").alias("to_id")).distinct()


def lineage(found: DataFrame, results: DataFrame, rules: DataFrame, statements: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """One row per finding and member document: rule and statement of the same number, segment and
    regions. With fresh (group_id, document_id), see consumed(), documents whose bundle the group
    didn't compile have no lineage there."""
    sides = found.select("group_id", "n", F.explode(F.array("a_id", "b_id")).alias("rule_id"))
    if fresh is not None:
        owner = rules.select("rule_id", "document_id").join(fresh.select("group_id", "document_id").distinct(), "document_id")
        sides = sides.join(owner.select("group_id", "rule_id"), ["group_id", "rule_id"], "left_semi")
    rule = rules.select("document_id", "rule_id", "k", "segment_id", "source_region_ids")
    stmt = statements.select("document_id", "k", "statement_id")
    return (
        results.select("group_id", "n", "seq", "query_id", "category").join(sides, ["group_id", "n"]).join(rule, "rule_id").join(stmt, ["document_id", "k"])
        .select(F.concat(F.lit("finding."), F.col("group_id"), F.lit("."), F.col("seq")).alias("finding_id"), "document_id", "query_id", "category", "rule_id", "statement_id", "segment_id", F.col("source_region_ids").alias("region_ids"))
    )


def edges(lin: DataFrame, regions: DataFrame) -> DataFrame:
    """(from_kind, from_id, to_kind, to_id) of the trace, each once, upward. The lineage is read twice."""
    doc = lambda c: F.concat_ws("/", "document_id", c)
    spans = lin.select("document_id", "segment_id", F.explode("region_ids").alias("region_id")).join(regions.select("document_id", "region_id", F.explode("span_ids").alias("span_id")), ["document_id", "region_id"])
    step = lambda a, a_id, b, b_id: F.struct(F.lit(a).alias("from_kind"), a_id.alias("from_id"), F.lit(b).alias("to_kind"), b_id.alias("to_id"))
    steps = lambda df, *some: df.select(F.explode(F.array(*some)).alias("e")).select("e.*")
    low = steps(spans, step("source", F.col("document_id"), "span", doc("span_id")), step("span", doc("span_id"), "segment", doc("segment_id")))
    high = steps(
        lin, step("segment", doc("segment_id"), "statement", doc("statement_id")), step("statement", doc("statement_id"), "rule", F.col("rule_id")),
        step("rule", F.col("rule_id"), "query", F.col("query_id")), step("query", F.col("query_id"), "finding", F.col("finding_id")),
    )
    return low.unionByName(high).distinct()


def chain(trace: DataFrame, finding_id: str) -> DataFrame:
    """All edges below a finding, with their height over it: one join per stage."""
    at = trace.where((F.col("to_kind") == "finding") & (F.col("to_id") == finding_id)).withColumn("up", F.lit(1))
    out, level = at, at
    for k in range(2, len(RANK) + 1):
        below = level.select(F.col("from_kind").alias("to_kind"), F.col("from_id").alias("to_id")).distinct()
        level = trace.join(below, ["to_kind", "to_id"], "left_semi").select(*trace.columns).withColumn("up", F.lit(k))
        out = out.unionByName(level)
    return out


def edge_violations(trace: DataFrame) -> DataFrame:
    """Edges that don't climb or lead nowhere: (kind, from_id, to_id)."""
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])
    flat = trace.where(~F.coalesce(F.try_element_at(rank, F.col("from_kind")) < F.try_element_at(rank, F.col("to_kind")), F.lit(False))).select(F.lit("EdgeRank").alias("kind"), "from_id", "to_id")
    heads = trace.select(F.col("to_kind").alias("k"), F.col("to_id").alias("i")).distinct()
    loose = trace.where("from_kind <> 'source'").join(heads, (F.col("from_kind") == F.col("k")) & (F.col("from_id") == F.col("i")), "left_anti").select(F.lit("EdgeUnresolved").alias("kind"), "from_id", "to_id")
    return flat.unionByName(loose)


def coherent(category: str = "category", verdict: str = "verdict") -> Column:
    """Whether a category may come with a verdict; failures come with none."""
    c, v = F.col(category), F.coalesce(verdict, F.lit("none"))
    return (
        F.when(c == "semantic_contradiction", v == "unsat").when(c == "semantic_no_conflict", v.isin("sat", "unsat")).when(c == "unknown", v.isin("unknown", "timeout"))
        .when(c.isin("schema_failure", "compiler_failure", "target_syntax_failure", "solver_execution_failure", "unsupported_fragment"), v == "none").otherwise(F.lit(False))
    )


def violations(nodes: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(kind, subject) of everything wrong with a trace of artifacts. nodes: node_id, kind, path,
    content_hash; edges: from_id, operation, to_id; claims: finding_id, group_id, query_id, pair_id,
    category, verdict, conflict_kind, assertion_ids, region_ids, rule_ids, report_ref."""
    found = []

    def add(df: DataFrame, kind: str, subject: Column | str) -> None:
        found.append(df.select(F.lit(kind).alias("kind"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject")))

    add(nodes.groupBy("node_id").count().where("count > 1"), "DuplicateNodeId", "node_id")
    add(nodes.where(~F.coalesce(F.col("kind").isin(*ARTIFACTS), F.lit(False))), "NodeKind", "node_id")
    add(nodes.where("coalesce(path, '') = ''"), "EmptyPath", "node_id")
    add(nodes.where("(content_hash is null) <> (kind = 'report')"), "HashPresence", "node_id")
    reports = nodes.where("kind = 'report'").select(F.col("node_id").alias("report_id"))
    add(reports.agg(F.count("*").alias("n"), F.max("report_id").alias("last")).where("n > 1"), "SecondReportNode", "last")
    link = F.concat_ws(" ", "from_id", "to_id")
    add(edges.groupBy("from_id", "operation", "to_id").count().where("count > 1"), "Duplicate", link)
    rank = F.create_map(*[x for i, k in enumerate(ARTIFACTS) for x in (F.lit(k), F.lit(i))])
    made = F.create_map(*[x for k, v in ARTIFACTS.items() if v for x in (F.lit(k), F.lit(v))])
    kinds = nodes.groupBy("node_id").agg(F.min("kind").alias("kind"))
    ends = edges.join(kinds.select(F.col("node_id").alias("from_id"), F.col("kind").alias("f")), "from_id", "left").join(kinds.select(F.col("node_id").alias("to_id"), F.col("kind").alias("t")), "to_id", "left")
    add(ends.where("f is null or t is null"), "EdgeUnresolved", link)
    both = ends.where("f is not null and t is not null")
    add(both.where(~F.coalesce(F.try_element_at(rank, F.col("f")) < F.try_element_at(rank, F.col("t")), F.lit(False))), "EdgeRank", link)
    add(both.where(~F.coalesce(F.try_element_at(made, F.col("t")) == F.col("operation"), F.lit(False))), "EdgeOperation", link)
    head = F.concat(F.lit("finding."), F.col("group_id"), F.lit("."))
    digits = F.expr("substring(finding_id, length(group_id) + 10)")
    numbered = claims.withColumn("number", F.when(F.startswith("finding_id", head) & digits.rlike(r"\A(0|[1-9][0-9]*)\z"), digits.try_cast("decimal(38,0)")))
    add(numbered.where("number is null"), "FindingIdForm", "finding_id")
    per = numbered.where("number is not null").groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("number").alias("d"), F.max("number").alias("last"))
    add(per.where("n <> d or last <> n - 1"), "FindingSequenceNumbers", "group_id")
    add(claims.where("not coalesce(startswith(query_id, pair_id || '.') and length(query_id) > length(pair_id) + 1, false)"), "QueryOutsidePair", "finding_id")
    add(claims.where(~coherent()), "CategoryVerdict", "finding_id")
    add(claims.where("(conflict_kind is not null) <> (category = 'semantic_contradiction')"), "ConflictKindPresence", "finding_id")
    for pool in ("assertion_ids", "region_ids", "rule_ids"):
        add(claims.where(F.coalesce(F.size(pool), F.lit(0)) <= 0), "EmptyEvidence", "finding_id")
        add(claims.where(F.col(pool) != F.sort_array(F.array_distinct(pool))), "SetOrder", "finding_id")
    add(claims.join(reports, F.col("report_ref") == F.col("report_id"), "left_anti"), "ReportRef", "finding_id")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
