"""The standing thread: two guidelines that contradict each other and a control."""

import pytest

from concordat.operators import metrics, trace, verdicts
from concordat.plans import guidelines, report
from concordat.sources import html, registry

# The three synthetic documents, the lexicon and the expected texts of the thread.
DOC_A = """<!DOCTYPE html>
<html lang="ja"><head><meta charset="utf-8"><title>敗血症診療ガイドライン(合成)</title></head>
<body>
<h1>敗血症診療ガイドライン(合成)</h1>
<h2>CQ1:成人の敗血症患者に対して抗菌薬Aを投与すべきか</h2>
<p>成人(18歳以上)の敗血症患者には抗菌薬Aを投与することを推奨する(強い推奨)。</p>
<p>ただし、重度腎機能障害のある患者を除く。</p>
<h3>用語の定義</h3>
<table>
<tr><th>用語</th><th>定義</th></tr>
<tr><td>成人</td><td>18歳以上の患者</td></tr>
<tr><td>小児</td><td>18歳未満の患者</td></tr>
<tr><td>重度腎機能障害</td><td>高度の腎機能低下を認める状態(合成定義)</td></tr>
</table>
<h3>エビデンス</h3>
<ul>
<li>ランダム化比較試験2件(エビデンスの確実性:中)</li>
<li>観察研究1件(エビデンスの確実性:低)</li>
</ul>
</body></html>"""
DOC_B = "<html><body><h1>抗菌薬A使用上の注意(合成)</h1><h2>注意事項</h2><p>成人の敗血症患者のうち、妊娠中の患者には抗菌薬Aを投与しないこと(禁忌)。</p></body></html>"
CONTROL = "<html><body><h1>小児敗血症診療の手引き(合成)</h1><h2>抗菌薬Aの使用</h2><p>小児(18歳未満)の敗血症患者には抗菌薬Aは禁忌である。</p></body></html>"
A, B, C = "test_source.m1_guideline_a", "test_source.m1_guideline_b", "test_source.m1_control"
LEXICON = {
    "system": "lex",
    "concepts": [
        {"id": "cond.sepsis", "surface": ["敗血症"]},
        {"id": "cond.renal_severe", "surface": ["重度腎機能障害"]},
        {"id": "cond.pregnancy", "surface": ["妊娠中"]},
        {"id": "drug.abx_a", "surface": ["抗菌薬A"]},
        {"id": "pop.adult", "surface": ["成人"], "interval": {"var": "q.age_years", "ge": 18}},
        {"id": "pop.child", "surface": ["小児"], "interval": {"var": "q.age_years", "lt": 18}},
    ],
    "actions": [{"id": "act.administer", "surface": ["投与する", "投与"]}],
    "modality": [
        {"surface": "推奨する", "direction": "for", "strength": "strong"},
        {"surface": "提案する", "direction": "for", "strength": "weak"},
        {"surface": "推奨しない", "direction": "against", "strength": "strong"},
        {"surface": "投与しないこと", "direction": "contraindicate", "strength": "strong"},
        {"surface": "禁忌", "direction": "contraindicate", "strength": "strong", "implies_action": "act.administer"},
    ],
    "certainty": [{"surface": "エビデンスの確実性:高", "value": "high"}, {"surface": "エビデンスの確実性:低", "value": "low"}],
}
RULE_A = (
    '{"action":{"key":"act.administer:drug.abx_a","kind":"act.administer","target":"drug.abx_a"},"context":{"any":[{"all":['
    '{"tag":"concept","value":"cond.sepsis"},{"tag":"concept_negated","value":"cond.renal_severe"},{"tag":"interval","value":{"ge":"18","var":"q.age_years"}}]}]},'
    '"direction":"for","exception_refs":["exc.0"],"rule_id":"test_source.m1_guideline_a.rule.0","source_region_ids":["r.2","r.3"],"strength":"strong"}'
)
OVERLAP = """(set-logic QF_LRA)
(set-option :print-success false)
(set-option :produce-models true)
(declare-const |cond.pregnancy| Bool)
(declare-const |cond.renal_severe| Bool)
(declare-const |cond.sepsis| Bool)
(declare-const |q.age_years| Real)
(assert (! (and |cond.sepsis| (not |cond.renal_severe|) (>= |q.age_years| 18)) :named |ctx.test_source.m1_guideline_a.rule.0|))
(assert (! (and |cond.pregnancy| |cond.sepsis| (>= |q.age_years| 18)) :named |ctx.test_source.m1_guideline_b.rule.0|))
(check-sat)
(get-model)
"""
DEONTIC = """(set-logic QF_UF)
(set-option :print-success false)
(set-option :produce-unsat-cores true)
(declare-const |pos:act.administer:drug.abx_a| Bool)
(assert (! |pos:act.administer:drug.abx_a| :named |a.test_source.m1_guideline_a.rule.0|))
(assert (! (not |pos:act.administer:drug.abx_a|) :named |a.test_source.m1_guideline_b.rule.0|))
(check-sat)
(get-unsat-core)
"""


@pytest.fixture(scope="module")
def thread(spark):
    docs = spark.createDataFrame([(A, DOC_A), (B, DOC_B), (C, CONTROL)], "document_id string, html string")
    groups = spark.createDataFrame([("group.m1_conflict", A), ("group.m1_conflict", B), ("group.m1_no_conflict", A), ("group.m1_no_conflict", C)], "group_id string, document_id string")
    return guidelines.run(docs, groups, registry.lexicon(LEXICON))


def test_segments(thread):
    got = [(r["segment_id"], r["kind"], r["region_ids"]) for r in thread["segments"].where(f"document_id = '{A}'").orderBy("ord").collect()]
    assert [k for _, k, _ in got] == ["metadata", "cq", "recommendation", "exception", "metadata", "table_row", "definition", "definition", "definition", "metadata", "evidence", "evidence"]
    assert got[2] == ("seg.2", "recommendation", ["r.2"]) and got[5][2] == ["r.5", "r.6"]
    assert thread["diagnostics"].count() == 0


def test_rule_payloads_and_texts(thread):
    rules = {r["rule_id"]: r for r in thread["rules"].collect()}
    assert len(rules) == 3 and rules[f"{A}.rule.0"]["payload"] == RULE_A
    assert rules[f"{C}.rule.0"]["action_key"] == "act.administer:drug.abx_a" and rules[f"{C}.rule.0"]["direction"] == "contraindicate"
    pair = thread["pairs"].where("group_id = 'group.m1_conflict'").collect()
    assert len(pair) == 1 and pair[0]["q1_id"] == "q.m1_conflict.pair1.overlap" and pair[0]["q1_body"] == OVERLAP and pair[0]["q2_body"] == DEONTIC


def test_bindings(thread):
    got = {(r["segment_id"], r["code"]): (r["binding_id"], r["status"]) for r in thread["bindings"].where(f"document_id = '{A}'").collect()}
    assert got == {("seg.2", "pop.adult"): ("bind.0", "exact"), ("seg.2", "cond.sepsis"): ("bind.1", "exact"), ("seg.2", "drug.abx_a"): ("bind.2", "exact"), ("seg.3", "cond.renal_severe"): ("bind.3", "exact")}


def test_findings_and_trace(thread, spark):
    got = {r["finding_id"]: r for r in thread["findings"].collect()}
    assert set(got) == {"finding.group.m1_conflict.1", "finding.group.m1_no_conflict.0"}
    hit = got["finding.group.m1_conflict.1"]
    assert hit["conflict_kind"] == "deontic_direction_conflict" and hit["core"] == [f"a.{A}.rule.0", f"a.{B}.rule.0"] and len(hit["quoted"]) == 3
    assert got["finding.group.m1_no_conflict.0"]["part"] == "no_conflict"
    reference = spark.createDataFrame([("group.m1_conflict", "semantic_contradiction", [f"a.{B}.rule.0", f"a.{A}.rule.0"], None), ("group.m1_no_conflict", "semantic_no_conflict", None, True), ("group.none", "semantic_no_conflict", None, None)], "group_id string, expected_outcome string, expected_unsat_core array<string>, expected_no_conflict_result boolean")
    matched = {r["group_id"]: r["matched"] for r in verdicts.group_outcomes(thread["results"], reference).collect()}
    assert matched == {"group.m1_conflict": True, "group.m1_no_conflict": True, "group.none": False}
    assert trace.edge_violations(thread["edges"]).count() == 0
    below = trace.chain(thread["edges"], "finding.group.m1_conflict.1").collect()
    assert {r["from_id"] for r in below if r["from_kind"] == "source"} == {A, B}
    assert thread["lineage"].where("finding_id = 'finding.group.m1_conflict.1'").count() == 2
    assert thread["assertions"].count() == 8


def test_stale_bundles_have_no_lineage(thread, spark):
    compiled = spark.createDataFrame([("group.m1_conflict", "c1", ["h1", "h2"]), ("group.m1_no_conflict", "c2", ["h1", "h3"])], "group_id string, artifact_id string, input_hashes array<string>")
    members = spark.createDataFrame([("group.m1_conflict", A), ("group.m1_conflict", B), ("group.m1_no_conflict", A), ("group.m1_no_conflict", C)], "group_id string, document_id string")
    bundles = spark.createDataFrame([(A, "b.a", "h1"), (B, "b.b", "stale"), (C, "b.c", "h3")], "document_id string, bundle_id string, hash string")
    edges = trace.consumed(compiled, members, bundles)
    assert {(r["from_id"], r["operation"], r["to_id"]) for r in edges.collect()} == {("b.a", "compile", "c1"), ("b.a", "compile", "c2"), ("b.c", "compile", "c2")}
    lin = trace.lineage(thread["pairs"], thread["results"], thread["rules"], thread["statements"], edges)
    assert {r["document_id"] for r in lin.where("finding_id = 'finding.group.m1_conflict.1'").collect()} == {A}


def test_trace_of_artifacts(spark):
    nodes = [("s", "source", "a.html", "h"), ("g", "source_document_graph", "g.json", "h"), ("r", "report", "report.json", None)]
    edges = [("s", "extract", "g"), ("g", "report", "r")]
    claim = ("finding.group.x.0", "group.x", "q.x.pair1.overlap", "q.x.pair1", "semantic_contradiction", "unsat", "deontic_direction_conflict", ["a"], ["b"], ["c"], "r")
    names = "finding_id group_id query_id pair_id category verdict conflict_kind assertion_ids region_ids rule_ids report_ref".split()
    other = lambda **x: tuple(x.get(n, v) for n, v in zip(names, claim))
    schema = ", ".join(f"{n} {'array<string>' if n.endswith('_ids') else 'string'}" for n in names)

    def kinds(n=nodes, e=edges, c=(claim,)):
        frames = spark.createDataFrame(list(n), "node_id string, kind string, path string, content_hash string"), spark.createDataFrame(list(e), "from_id string, operation string, to_id string"), spark.createDataFrame(list(c), schema)
        return {r["kind"] for r in trace.violations(*frames).collect()}

    assert kinds() == set()
    broken = [("s", "source", "", "h"), ("r2", "report", "x", "h")]
    assert kinds(n=[*nodes, *broken]) == {"DuplicateNodeId", "EmptyPath", "HashPresence", "SecondReportNode"}
    assert kinds(e=[*edges, edges[0], ("r", "extract", "g"), ("g", "verify", "r"), ("g", "report", "none")]) == {"Duplicate", "EdgeRank", "EdgeOperation", "EdgeUnresolved"}
    wrong = [other(finding_id="finding.group.x.02"), other(query_id="q.x.pair10"), other(finding_id="finding.group.x.3", verdict="sat"), other(finding_id="finding.group.x.1", conflict_kind=None, rule_ids=[], region_ids=["b", "a"], report_ref="g")]
    assert kinds(c=[claim, *wrong]) == {"FindingIdForm", "QueryOutsidePair", "FindingSequenceNumbers", "CategoryVerdict", "ConflictKindPresence", "EmptyEvidence", "SetOrder", "ReportRef"}


def test_report_rules():
    entry = {"finding_id": "f.0", "group_id": "g", "query_id": "q", "category": "semantic_contradiction", "verdict": "unsat", "conflict_kind": "k", "unsat_core": ["a"], "participating_rules": ["r"], "quoted": ["t"], "wording": "w"}
    value = {"findings": [entry], "no_conflict_results": [], "diagnostics": {}}
    rows = [{"metric": "a", "num": 1, "den": 1}, {"metric": "b", "num": 1, "den": 1}]
    table = {"baseline": "x", "routes": [{"route": "x", "rows": rows}, {"route": "y", "rows": rows}], "deltas": [{"route": "y", "rows": rows}]}
    wrong = lambda **changed: [v.split(" ")[0] for v in report.violations({**value, **changed})]
    assert wrong(metrics=table, failure_taxonomy={"x": {"c": 1}}) == []
    assert wrong(findings=[{**entry, "verdict": "sat", "participating_rules": []}]) == ["VerdictRule", "EmptyEvidence"]
    assert wrong(failure_taxonomy={}) == ["EmptyTaxonomy"] and wrong(failure_taxonomy={"x": {"c": 0}}) == ["TaxonomyZeroCount"]
    assert wrong(metrics={**table, "baseline": "z", "deltas": [{"route": "x", "rows": rows[::-1]}]}) == ["BaselineMissing", "DeltaTableMismatch", "MetricRowOrder"]
    assert wrong(metrics={**table, "routes": [*table["routes"], table["routes"][0]]}) == ["DuplicateRoute"]


def rows_of(text, root=None):
    return [(r["part"], r["id"], r.get("kind"), r.get("parent_id"), r.get("raw_text"), r.get("code")) for r in html.document_rows("d", text, root)]


def test_html_walk():
    got = rows_of("<p>a<b>b</b>&amp;<p>c<div>x<p>y</div>stray<ul><li>1<li>2<p>3</ul><table><tr><td>1<td rowspan=2>2</table><table><caption>k</caption><tr><th>h<th><tr><td><td>v</table>")
    assert [(p, k, t) for p, _, k, _, t, _ in got if p in ("node", "span")] == [
        ("node", "document", None), ("node", "paragraph", None), ("span", None, "ab&"), ("node", "paragraph", None), ("span", None, "c"), ("node", "list", None), ("node", "paragraph", None), ("span", None, "1"), ("node", "paragraph", None), ("span", None, "23"),
        ("node", "table", None), ("node", "table", None), ("node", "caption", None), ("span", None, "k"), ("node", "cell", None), ("span", None, "h"), ("node", "cell", None), ("span", None, "v"),
    ]
    assert [c for *_, c in got if c] == ["extraction_uncertain", "extraction_uncertain", "table_structure_uncertain"]
    regions = [r["id"] for r in html.document_rows("d", "<h1>t</h1><div/><p>x</p>") if r["part"] == "region"]
    assert regions == ["r.0", "r.1", "r.2"]  # a residual's region takes a number
    assert rows_of("") == [("node", "n.0", "document", None, None, None)]
    sections = [(k, p) for part, _, k, p, *_ in rows_of("<h1>a</h1><h3>b</h3><p>x</p><h2>c</h2><h1>d</h1>") if part == "node"]
    assert sections == [("document", None), ("section", "n.0"), ("section", "n.1"), ("paragraph", "n.2"), ("section", "n.1"), ("section", "n.0")]


def test_slot_problems(spark):
    body = "<h1>x</h1><p>抗菌薬Aを推奨する</p><p>ただし、妊娠中を除く</p><p>敗血症に投与を推奨する。推奨しない。</p><p>抗菌薬Aの投与を推奨する エビデンスの確実性:高 エビデンスの確実性:低</p><p>何もない</p>"
    groups = spark.createDataFrame([("g", "d")], "group_id string, document_id string")
    out = guidelines.run(spark.createDataFrame([("d", body)], "document_id string, html string"), groups, registry.lexicon(LEXICON))
    codes = sorted((r["code"], r["detail"].split(":")[0].split(" ")[0]) for r in out["diagnostics"].collect())
    assert codes == [("segmentation_boundary_error", "unclassified"), ("semantic_slot_missing", "exception"), ("semantic_slot_missing", "kinds"), ("terminology_ambiguous", "certainty"), ("terminology_ambiguous", "modality"), ("terminology_unmapped", "targets")]
    stmts = out["statements"].collect()
    assert len(stmts) == 1 and stmts[0]["certainty"] is None and stmts[0]["statement_id"] == "stmt.0"


def test_lexicon_refusals():
    bad = {"concepts": [{"id": "a.x", "surface": ["s", "ｓ"]}, {"id": "a.x", "surface": []}, {"id": "a.y", "surface": ["t"], "interval": {"var": "q", "ge": 2, "lt": 2}}], "odd": 1}
    with pytest.raises(registry.RegistryError) as e:
        registry.lexicon(bad)
    assert e.value.findings == ["lexicon: unknown field odd", "a.x: repeated surface", "a.x: repeated id", "a.x: empty surface", "a.y: incoherent interval"]


def test_registry_check(spark):
    stages = [{"id": "s1", "input_artifact_kinds": [], "output_artifact_kinds": ["a"]}, {"id": "s2", "input_artifact_kinds": ["a", "z"], "output_artifact_kinds": ["b"]}]
    pipes = [{"id": "p", "processing_stages": ["s1", "s2", "s9"]}]
    exp = [{"id": "e", "pipeline": "p", "test_source_groups": [{"group_id": "g", "test_sources": ["d", "q"]}]}]
    found = registry.check([{"id": "d", "path": "../x"}], pipes, stages, exp, [{"group_id": "h"}])
    assert found == ["unsafe path ../x", "chain break at s2 in p: z", "dangling stage s9 in p", "dangling corpus q in g", "no reference for g", "unknown reference group h"]
    df = spark.createDataFrame([("p", 0, [], ["a"]), ("p", 1, ["a", "b"], ["b"])], "pipeline string, ord int, inputs array<string>, outputs array<string>")
    assert [tuple(r) for r in registry.chain_breaks(df).collect()] == [("p", 1, "b")]


def test_severity(spark):
    from concordat import schema

    df = spark.createDataFrame([("a", "ok"), ("a", "ambiguity"), ("b", "residual")], "k string, outcome string")
    rank = {n: i for i, n in enumerate(schema.OUTCOMES)}
    got = df.groupBy("k").agg({"k": "count"}).join(df.groupBy("k").agg(__import__("pyspark.sql.functions", fromlist=["max"]).max(metrics.severity(rank, "outcome")).alias("r")), "k")
    assert {r["k"]: r["r"] for r in got.collect()} == {"a": 2, "b": 1}
