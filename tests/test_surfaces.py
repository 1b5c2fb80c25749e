"""Texts, canonical JSON, fractions, logs, streams, cassettes, document checks, reports."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat.functions import canon, model, rational, text
from concordat.operators import bundle, documents, metrics, smt
from concordat.plans import report
from concordat.sources import cassettes, jsonl, registry
from concordat.streaming import events


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_string_policies(spark):
    s = " ＣＱ１：ＡＢＣ　 \t é、İ。 "
    assert one(spark, s, text.source_nfkc("x")) == " CQ1:ABC  \t é、İ。 "
    assert one(spark, s, text.diagnostic_text("x")) == "CQ1:ABC é、İ。"
    assert one(spark, s, text.semantic_ja("x")) == "CQ1:ABC é,İ." == registry.fold_ja(s)
    assert one(spark, s, text.semantic_en("x")) == "cq1:abc é,İ."
    assert one(spark, "a.b:c/d-1_", text.identifier_ascii("x")) == "a.b:c/d-1_" and one(spark, "A", text.identifier_ascii("x")) is None
    assert one(spark, "é漢x", text.byte_slice("x", 2, 5)) == "漢" and one(spark, "é漢x", text.byte_length("x")) == 6
    assert one(spark, "é\n", text.unhex_text(text.hex_text("x"))) == "é\n" and one(spark, "zz", text.unhex_text("x")) is None
    assert one(spark, ["b", "a", "b"], text.set_hash("x"), "array<string>") == one(spark, "a\nb", text.sha256("x"))


@pytest.mark.parametrize("body,want", [("推奨する推奨しない", ["推奨する", "推奨しない"]), ("投与することを投与", ["投与する", "投与"]), ("aab", ["aa", "b"]), ("", []), ("a+b.", ["a", "+", "b", "."])])
def test_longest_first_scan(spark, body, want):
    assert one(spark, body, text.scan("x", ["投与", "投与する", "推奨する", "推奨しない", "a", "aa", "b", "+", "."])) == want


def test_close_spellings(spark):
    words, lex = spark.createDataFrame([("sepsi",), ("sepsis",), ("spesis",), ("x",)], "word string"), spark.createDataFrame([("sepsis",), ("pregnancy",)], "surface string")
    assert sorted((r["word"], r["distance"]) for r in text.close_spellings(words, lex).collect()) == [("sepsi", 1), ("sepsis", 0)]


def test_canonical_strings(spark):
    for s in ('a"b\\c', "tab\t nl\n \x00\x1f", "é漢/😀", ""):
        assert one(spark, s, canon.string("x")) == canon.emit(s) and json.loads(canon.emit(s)) == s
    assert canon.emit("\n") == '"\\u000a"'


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.text(st.characters(exclude_categories=["Cs"])) | st.booleans() | st.integers(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), x, max_size=4), max_leaves=12))
def test_canonical_round_trip(value):
    out = canon.emit(value)
    assert canon.emit(canon.read(out)) == out


@pytest.mark.parametrize("bad", ['{"b":"1","a":"2"}', '{"a":"1","a":"2"}', "1", "1.5", "null", '{"a": "1"}', '"\\n"', '["1",]', '"\\u00e9"', "NaN"])
def test_other_encodings_are_refused(bad):
    with pytest.raises(canon.CanonError):
        canon.read(bad)


def test_structural_hash_ignores_names(spark):
    a, b, c = (one(spark, v, canon.structural_hash("x"), "array<string>") for v in (["p", "q", "p"], ["z", "a", "z"], ["p", "q", "q"]))
    assert a == b != c


def test_fractions(spark):
    df = spark.createDataFrame([(6, 8), (0, 5), (3, 0), (-4, 6), (9007199254740993, 3)], "a long, b long")
    assert [None if r["f"] is None else tuple(r["f"]) for r in df.select(rational.ratio("a", "b").alias("f")).collect()] == [(3, 4), (0, 1), None, (-2, 3), (3002399751580331, 1)]
    two = spark.createDataFrame([((1, 2), (1, 3)), ((1, 3), (1, 2)), ((1, 2), None)], "a struct<num:long,den:long>, b struct<num:long,den:long>")
    assert [None if r["d"] is None else tuple(r["d"]) for r in two.select(rational.subtract("a", "b").alias("d")).collect()] == [(1, 6), (-1, 6), None]


def test_seeds(spark):
    want = [model.derive_seed(42, k) for k in range(3)]
    got = spark.createDataFrame([(42, k) for k in range(3)], "b long, a long").select(model.seed("b", "a").alias("s")).collect()
    assert [int(r["s"]) for r in got] == want and len(set(want)) == 3 and max(want) < 2**64


def test_solver_output(spark):
    assert one(spark, "sat\n(model)", smt.verdict_token("x")) == "sat" and one(spark, "satx\n", smt.verdict_token("x")) is None
    assert one(spark, "unsat\n(|a.d.rule.1| |a.d.rule.0| b)\n", smt.unsat_core("x")) == ["a.d.rule.0", "a.d.rule.1", "b"] and one(spark, "sat\n", smt.unsat_core("x")) is None
    assert one(spark, "Z3 version 4.13.0 - 64 bit", smt.solver_version("x")) == "4.13.0"
    assert one(spark, -3, smt.numeral("x"), "long") == "(- 3)" and one(spark, [], smt.conjunction("x"), "array<string>") == "true"


def test_logs_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r", "ok"), (2, "r", "ambiguity"), (3, "s", "ok")], "sequence long, run_id string, outcome string")
    line = canon.object_of({"sequence": canon.integer("sequence"), "run_id": canon.string("run_id"), "outcome": canon.string("outcome")})
    jsonl.write(rows.withColumn("line", line), f"{tmp_path}/log")
    kind = "sequence string, run_id string, outcome string"
    back = jsonl.read(spark, f"{tmp_path}/log", kind)
    assert back.count() == 3 and {tuple(r) for r in events.worst_outcomes(back).collect()} == {("r", "ambiguity", 2), ("s", "ok", 1)}
    q = events.worst_outcomes(jsonl.stream(spark, f"{tmp_path}/log", kind)).writeStream.outputMode("complete").format("memory").queryName("worst").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from worst").collect()} == {("r", "ambiguity", 2), ("s", "ok", 1)}
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.json").write_text('{"sequence":"1"}')
    with pytest.raises(jsonl.LogError):
        jsonl.read(spark, f"{tmp_path}/cut", kind)


def test_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.windowed_counts(e, "ts", "event_type", "1 hour").agg(F.sum("n")).first()[0] == e.count()
    assert events.sessions(e, "ts", "user_id").agg(F.sum("n")).first()[0] == e.count()


def test_cassettes(spark):
    tape = spark.createDataFrame([("r", "a", 1, "6869", "h"), ("r", "b", 1, "zz", "h"), ("r", "c", 1, "61", "old")], "route string, source string, seed long, output_hex string, constraint_hash string")
    asked = spark.createDataFrame([("r", s, 1, "h") for s in "abcd"], "route string, source string, seed long, constraint_hash string")
    assert {r["source"]: (r["output"], r["problem"]) for r in cassettes.replay(asked, tape).collect()} == {"a": ("hi", None), "b": (None, "invalid_hex"), "c": (None, "constraint_drift"), "d": (None, "missing")}
    assert cassettes.violations(tape).count() == 0 and cassettes.violations(tape.union(tape.limit(1))).count() == 1
    tries = spark.createDataFrame([("r", "a", 0, 0, "bad"), ("r", "a", 0, 1, "good"), ("r", "b", 0, 0, "stop"), ("r", "b", 0, 1, "good"), ("r", "c", 0, 0, "bad"), ("r", "c", 0, 1, "bad"), ("r", "c", 0, 2, "good")], "route string, source string, draw int, attempt int, output string")
    got = {r["source"]: (r["accepted"], r["repairs"], r["output"]) for r in cassettes.accepted(tries, 1, F.col("output") == "good", F.col("output") == "stop").collect()}
    assert got == {"a": (True, 1, "good"), "b": (False, 0, None), "c": (False, 1, None)}


GRAPH = "document_id string, node_id string, pos int, kind string, parent_id string, attrs map<string,string>"


def test_graph_checks(spark):
    nodes = spark.createDataFrame([("d", "n.0", 0, "document", None, {}), ("d", "n.1", 1, "table", "n.0", {}), ("d", "n.2", 2, "cell", "n.1", {"row": "0", "col": "0", "header": "true"}), ("d", "n.3", 3, "cell", "n.1", {"row": "0", "col": "1"}), ("d", "n.4", 4, "paragraph", "n.9", {})], GRAPH)
    spans = spark.createDataFrame([("d", "s.0", "n.2", "h", 0, 0), ("d", "s.1", "n.3", "v", 0, 1), ("d", "s.2", "n.7", "w", 0, 1)], "document_id string, span_id string, node_id string, raw_text string, start long, reading_order long")
    regions = spark.createDataFrame([("d", "r.0", 0, ["n.2"], ["s.0"]), ("d", "r.0", 1, ["n.3"], ["s.1"]), ("d", "r.2", 2, [], [])], "document_id string, region_id string, pos int, node_ids array<string>, span_ids array<string>")
    got = {(r["kind"], r["subject"]) for r in documents.violations(nodes, spans, regions).collect()}
    assert got == {("MissingParent", "n.4"), ("Duplicate", "r.0"), ("Dangling", "s.2"), ("ReadingOrder", "s.2"), ("EmptyRegion", "r.2"), ("UnspannedTextualNode", "n.4")}
    cells, broken = documents.table_cells(nodes, spans)
    assert [(r["row"], r["col"], r["header"], r["text"]) for r in cells.orderBy("col").collect()] == [(0, 0, True, "h"), (0, 1, False, "v")] and broken.count() == 0
    assert documents.table_cells(nodes.withColumn("attrs", F.create_map(F.lit("row"), F.lit("0"), F.lit("col"), F.lit("0"))), spans)[1].first()["kind"] == "CellCollision"
    assert documents.table_cells(nodes.withColumn("attrs", F.create_map(F.lit("row"), F.lit("01"), F.lit("col"), F.lit("0"))), spans)[1].first()["kind"] == "CellAttr"
    assert documents.text_blocks(nodes, spans).count() == 2


def test_samples(spark):
    prints = spark.createDataFrame([("g", 0, "x"), ("g", 1, "x"), ("g", 2, "y"), ("h", 0, "x")], "group string, sample int, print string")
    groups = spark.createDataFrame([("g",), ("h",), ("none",)], "group string")
    got = {r["group"]: (r["agreeing"], r["pairs"]) for r in metrics.agreeing_pairs(prints, groups, "group", 4).collect()}
    assert got == {"g": (1, 6), "h": (3, 6), "none": (6, 6)}
    assert tuple(metrics.convergence(metrics.agreeing_pairs(prints, groups, "group", 4)).first()) == (5, 9)


def test_route_metrics(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    routes = df([("m",), ("empty",)], "route string")
    fills = df([("m", 3, 1, 2, True), ("m", 1, 0, 0, False)], "route string, recorded_calls long, schema_violations long, repairs long, accepted boolean")
    plan = df([("m", "g", 2, "q.3", "q.4"), ("m", "g", 1, "q.1", "q.2")], "route string, group_id string, n int, q1_id string, q2_id string")
    core = ["a.r1", "a.r2"]
    results = df(
        [("m", "g", 2, "q.2", "deontic", "semantic_contradiction", "unsat", core), ("m", "g", 1, "q.1", "overlap", "semantic_no_conflict", "sat", None), ("m", "g", 3, "q.3", "overlap", "semantic_no_conflict", None, []), ("m", "h", 1, "q.9", "overlap", "target_syntax_failure", None, None)],
        "route string, group_id string, seq int, query_id string, role string, category string, verdict string, core array<string>",
    )
    prints = {r["group_id"]: r["print"] for r in metrics.verdict_fingerprint(plan, results, ("route", "group_id")).collect()}
    assert prints["g"].split("\n") == ["pair q.1 q.2", "pair q.3 q.4", "result q.1 semantic_no_conflict sat -", "result q.2 semantic_contradiction unsat a.r1,a.r2", "result q.3 semantic_no_conflict - "]
    samples = df([("m", "g", 0, "x"), ("m", "g", 1, "x"), ("m", "g", 2, "y"), ("m", "h", 0, "x")], "route string, group_id string, sample int, print string")
    schema = "group_id string, expected_outcome string, expected_unsat_core array<string>, expected_no_conflict_result boolean"
    reference = [("g", "semantic_contradiction", core, None), ("h", "semantic_no_conflict", None, None), ("none", "semantic_no_conflict", None, None)]
    draws = df([("m", 4)], "route string, k int")
    rows, lost = metrics.route_metrics(fills, results, samples, df(reference, schema), routes, draws)
    got = {(r["route"], r["metric"]): (r["num"], r["den"]) for r in rows.collect()}
    assert {m: v for (route, m), v in got.items() if route == "m"} == {
        "acceptance_rate": (1, 2), "conflict_verdict_accuracy": (1, 3), "k_sample_convergence": (1, 3), "recorded_call_count": (4, 1), "repair_count": (2, 1), "schema_valid_rate": (3, 4), "target_syntactic_validity": (3, 4),
    }
    assert {m: v for (route, m), v in got.items() if route == "empty"} == {
        "acceptance_rate": (0, 0), "conflict_verdict_accuracy": (0, 1), "k_sample_convergence": (0, 0), "recorded_call_count": (0, 1), "repair_count": (0, 1), "schema_valid_rate": (0, 0), "target_syntactic_validity": (0, 0),
    }
    assert lost.count() == 0
    rows, lost = metrics.route_metrics(fills, results, samples, df([*reference, ("z", "odd", None, None)], schema), routes, draws)
    assert rows.count() == 12 and {r["detail"] for r in lost.collect()} == {"unrecognized expected_outcome(s): z=odd"}
    with pytest.raises(ValueError):
        metrics.route_metrics(df([("m", 0, 1, 0, False)], fills.schema), results, samples, df(reference, schema), routes, draws)


def test_reports(spark):
    from test_guidelines import A, B, C, CONTROL, DOC_A, DOC_B, LEXICON

    from concordat.plans import guidelines

    docs = spark.createDataFrame([(A, DOC_A), (B, DOC_B), (C, CONTROL)], "document_id string, html string")
    groups = spark.createDataFrame([("group.x", A), ("group.x", B), ("group.y", A), ("group.y", C)], "group_id string, document_id string")
    tables = guidelines.run(docs, groups, registry.lexicon(LEXICON))
    value = report.assemble(tables)
    assert report.violations(value) == [] and len(value["findings"]) == len(value["no_conflict_results"]) == 1
    assert canon.read(canon.emit(value)) and report.content_hash(value) == report.content_hash(report.assemble(tables))
    en, ja = report.markdown(value), report.markdown(value, "ja")
    assert "finding.group.x.1" in en and "妊娠中" in ja and ja.startswith("# 矛盾")
    broken = {**value, "findings": [{**value["findings"][0], "unsat_core": [], "quoted": ["a\nb"]}], "diagnostics": {"x": 0}}
    assert [v.split(" ")[0] for v in report.violations(broken)] == ["CorePresence", "QuotedTextLineBreak", "ZeroCount"]
    hashes = report.artifact_hashes(tables)
    m = report.manifest("run", "exp", hashes, 42, {"ms": 1})
    assert len(m["artifact_hashes"]) == 6
    assert report.replay(hashes, report.artifact_hashes(guidelines.run(docs.repartition(2), groups, registry.lexicon(LEXICON)))).count() == 0
    assert bundle.violations(tables["segments"], tables["statements"], tables["rules"], tables["regions"]).count() == 0
    uses = {(r["kind"], r["component"]): r["uses"] for r in bundle.components(tables["bindings"], tables["statements"], tables["rules"]).collect()}
    assert len(uses[("action", "act.administer:drug.abx_a")]) == 6 and f"{A}/bind.1" in uses[("concept", "cond.sepsis")]
    bad = tables["rules"].withColumn("action_key", F.lit("x:y"))
    assert {r["kind"] for r in bundle.first_break(bundle.violations(tables["segments"], tables["statements"], bad, tables["regions"])).collect()} == {"KeyMismatch"}


def test_stored_bundles(spark):
    from test_guidelines import A, B, DOC_A, DOC_B, LEXICON

    from concordat.operators.graph import kept
    from concordat.plans import guidelines

    docs = spark.createDataFrame([(A, DOC_A), (B, DOC_B)], "document_id string, html string")
    groups = spark.createDataFrame([("group.x", A), ("group.x", B)], "group_id string, document_id string")
    whole = {k: kept(v) for k, v in bundle.assemble(guidelines.run(docs, groups, registry.lexicon(LEXICON))).items()}
    kinds = lambda **changed: {r["kind"] for r in bundle.validate({**whole, **changed}).collect()}
    assert kinds() == set()
    index = whole["components"]
    assert {r["kind"] for r in index.collect()} == {"segment", "binding", "statement", "rule", "constraint", "action", "concept"}
    stronger = whole["rules"].withColumn("strength", F.lit("other"))
    assert kinds(rules=stronger) == {"ConstraintMismatch", "ComponentsMismatch", "HashMismatch"}
    was = {r["component"]: r["hash"] for r in index.where("kind = 'rule'").collect()}
    now = {r["component"]: r["hash"] for r in bundle.components(whole["bindings"], whole["statements"], stronger).where("kind = 'rule'").collect()}
    assert was.keys() == now.keys() and all(was[k] != now[k] for k in was)
    assert kinds(hashes=whole["hashes"].withColumn("hash", F.lit("sha256:0"))) == {"HashMismatch"}
    assert kinds(components=index.where("kind <> 'concept'")) == {"ComponentsMismatch"}
    assert kinds(blocks=whole["blocks"].withColumn("raw_text", F.lit("x"))) == {"DocLayerMismatch", "HashMismatch"}
    c = whole["constraints"].first()
    pair = spark.createDataFrame([(c["document_id"], "pair1", c["action_key"], c["constraint_id"], c["constraint_id"])], whole["plan"].schema)
    planned = {**whole, "plan": pair}
    planned["components"], planned["hashes"] = bundle._index(planned), bundle._hashes(planned)
    assert kinds(**planned) == {"PairInvalid"}
    assert {r["kind"] for r in bundle.first_break(bundle.validate({**whole, "rules": stronger})).collect()} == {"ConstraintMismatch"}
