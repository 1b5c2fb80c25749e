"""Knowledge bases: violations, conflicts, derivability, fact lines, interval batteries."""

from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from concordat.operators import intervals, kb, pairs, sets

A, B, C = "test_source.m1_guideline_a", "test_source.m1_guideline_b", "test_source.m1_control"
KEY = "act.administer:drug.abx_a"


def concept(i, s, c):
    return (i, s, "concept", c, None, None, None, None)


def interval(i, s, q, v, o, d):
    return (i, s, "interval", None, q, None if v is None else Decimal(v), o, d)


def doc(name, direction, conditions, exceptions=(), extra=None):
    facts = {"rule": [(f"{name}.rule.0", f"{name}.stmt.0")], "direction": [(f"{name}.rule.0", direction)], "strength": [(f"{name}.rule.0", "strong")], "population": [(f"{name}.stmt.0", "pop.patient")], "action": [(f"{name}.stmt.0", KEY)]}
    facts["condition"] = [x(f"{name}.bind.{k}", f"{name}.stmt.0") for k, x in enumerate(conditions)]
    facts["exception"] = [x(f"{name}.exc.{k}", f"{name}.stmt.0") for k, x in enumerate(exceptions)]
    facts["source"] = [(f"{name}.rule.0", name, [0], "basis")]
    for k, v in (extra or {}).items():
        facts[k] = facts.get(k, []) + v
    return facts


def merged(*docs):
    return {k: [r for d in docs for r in d.get(k, [])] for k in {k for d in docs for k in d}}


has = lambda c: lambda i, s: concept(i, s, c)
age = lambda v, o, d: lambda i, s: interval(i, s, "q.age_years", v, o, d)
DOC_A = doc(A, "for", [has("cond.sepsis"), age(18, "closed", "lower")], [has("cond.renal_severe")])
DOC_B = doc(B, "contraindicate", [has("cond.sepsis"), age(18, "closed", "lower"), has("cond.pregnancy")])
CONTROL = doc(C, "contraindicate", [has("cond.sepsis"), age(18, "open", "upper")])


def kinds(spark, facts):
    return sorted(r["kind"] for r in kb.violations(kb.knowledge_base(spark, facts)).collect())


def test_thread_documents_are_valid(spark):
    assert kinds(spark, merged(DOC_A, DOC_B, CONTROL)) == []


D = doc("d", "for", [])


def without(name):
    return {k: v for k, v in D.items() if k != name}


def replaced(name, rows):
    return {**D, name: rows}


def plus(name, *rows):
    return {**D, name: D[name] + list(rows)}


DEFECTS = {
    "unknown_concept": plus("condition", concept("d.bind.0", "d.stmt.0", "cond.bogus")),
    "unknown_quantity": plus("condition", interval("d.bind.0", "d.stmt.0", "q.bogus", 18, "closed", "lower")),
    "bad_interval_openness": plus("condition", interval("d.bind.0", "d.stmt.0", "q.age_years", 18, "ajar", "lower")),
    "bad_interval_dir": plus("exception", interval("d.exc.0", "d.stmt.0", "q.age_years", 18, "open", "sideways")),
    "bad_interval_bound": plus("condition", interval("d.bind.0", "d.stmt.0", "q.age_years", None, "open", "lower")),
    "malformed_atom": plus("condition", ("d.bind.0", "d.stmt.0", "frob", "x", None, None, None, None)),
    "malformed_action_key": replaced("action", [("d.stmt.0", "act.administer")]),
    "unknown_action_kind": replaced("action", [("d.stmt.0", "act.bogus:drug.abx_a")]),
    "unknown_action_target": replaced("action", [("d.stmt.0", "act.administer:drug.bogus")]),
    "unknown_direction": replaced("direction", [("d.rule.0", "sideways")]),
    "unknown_strength": replaced("strength", [("d.rule.0", "medium")]),
    "unknown_certainty": {**D, "certainty": [("d.rule.0", "sometimes")]},
    "unknown_population": replaced("population", [("d.stmt.0", "pop.bogus")]),
    "malformed_id": plus("condition", concept("d.bind.01", "d.stmt.0", "cond.sepsis")),
    "missing_population": without("population"),
    "missing_action": without("action"),
    "missing_direction": without("direction"),
    "missing_strength": without("strength"),
    "duplicate_action": plus("action", ("d.stmt.0", KEY)),
    "duplicate_population": plus("population", ("d.stmt.0", "pop.patient")),
    "duplicate_direction": plus("direction", ("d.rule.0", "against")),
    "duplicate_strength": plus("strength", ("d.rule.0", "weak")),
    "duplicate_certainty": {**D, "certainty": [("d.rule.0", "high"), ("d.rule.0", "low")]},
    "duplicate_bind": plus("condition", concept("d.bind.0", "d.stmt.0", "cond.sepsis"), concept("d.bind.0", "d.stmt.0", "cond.pregnancy")),
    "duplicate_exception": plus("exception", concept("d.exc.0", "d.stmt.0", "cond.sepsis"), concept("d.exc.0", "d.stmt.0", "cond.pregnancy")),
    "duplicate_rule": plus("rule", ("d.rule.0", "d.stmt.0")),
    "multi_owned_stmt": merged(D, {"rule": [("d.rule.1", "d.stmt.0")], "direction": [("d.rule.1", "against")], "strength": [("d.rule.1", "strong")]}),
    "dangling_stmt_ref": plus("condition", concept("d.bind.1", "d.stmt.5", "cond.sepsis")),
    "dangling_rule_ref": plus("direction", ("d.rule.9", "against")),
    "dangling_source_ref": plus("source", ("d.exc.7", "d", [0], None)),
    "malformed_source": replaced("source", [("d.rule.0", "d", [1, 0], None)]),
    "nonground_fact": plus("condition", concept("d.bind.0", "d.stmt.0", None)),
}


def test_each_defect_alone(spark):
    """Each defect is one knowledge base; all are judged in one pass by giving documents of their own."""
    def renamed(facts, name):
        fix = lambda x: x if not isinstance(x, str) else name + x[1:] if x.startswith("d.") else name if x == "d" else x
        return {k: [tuple(fix(v) for v in r) for r in rows] for k, rows in facts.items()}

    every = merged(*[renamed(f, f"x{i}") for i, f in enumerate(DEFECTS.values())])
    got = {}
    for r in kb.violations(kb.knowledge_base(spark, every)).collect():
        got.setdefault(int(r["subject"].split(".")[0][1:]), set()).add(r["kind"])
    assert {k: got.get(i) for i, k in enumerate(DEFECTS)} == {k: {k} for k in DEFECTS}
    assert kinds(spark, replaced("source", [("d.rule.0", "d", [], None)])) == kinds(spark, replaced("source", [("d.rule.0", "e", [0], None)])) == ["malformed_source"]


def conflicts(spark, *docs):
    return [(r["rule_a"], r["rule_b"]) for r in kb.conflict_pairs(kb.knowledge_base(spark, merged(*docs))).collect()]


def test_conflicts(spark):
    assert conflicts(spark, DOC_A, DOC_B, CONTROL) == [(f"{A}.rule.0", f"{B}.rule.0")]
    x = lambda d, c, e=(): doc("x", d, c, e)
    y = lambda d, c, e=(): doc("y", d, c, e)
    pair = [("x.rule.0", "y.rule.0")]
    assert conflicts(spark, x("for", []), y("avoid", [])) == pair
    assert conflicts(spark, x("for", []), y("permit", [])) == [] == conflicts(spark, x("against", []), y("contraindicate", []))
    assert conflicts(spark, x("for", [has("cond.sepsis")]), y("against", [], [has("cond.sepsis")])) == []
    assert conflicts(spark, x("for", [has("cond.sepsis")]), y("against", [], [has("cond.pregnancy")])) == pair
    assert conflicts(spark, x("for", [age(18, "closed", "lower")]), y("against", [age(18, "closed", "upper")])) == pair
    assert conflicts(spark, x("for", [age(18, "open", "lower")]), y("against", [age(18, "closed", "upper")])) == []
    assert conflicts(spark, x("for", [age(18, "open", "lower")]), y("against", [age(19, "open", "upper")])) == pair  # dense order
    assert conflicts(spark, x("for", [age(20, "open", "lower"), age(19, "open", "upper")]), y("against", [])) == []  # empty on its own side
    assert conflicts(spark, x("for", [age(1, "open", "lower"), age(5, "closed", "lower")]), y("against", [age(5, "closed", "upper")])) == pair


def test_several_statements_witness_one_pair(spark):
    two = merged(doc("x", "for", []), {"rule": [("x.rule.0", "x.stmt.1")], "population": [("x.stmt.1", "pop.patient")], "action": [("x.stmt.1", KEY)]})
    base = kb.knowledge_base(spark, merged(two, doc("y", "against", [])))
    assert kb.conflict_witnesses(base).count() == 2 and kb.conflict_pairs(base).count() == 1


def test_derivable(spark):
    base = kb.knowledge_base(spark, merged(DOC_A, DOC_B, doc("free", "for", [])))
    contexts = spark.createDataFrame([(i,) for i in "abcde"], "ctx_id string")
    concepts = spark.createDataFrame([("a", "cond.sepsis"), ("b", "cond.sepsis"), ("b", "cond.renal_severe"), ("c", "cond.sepsis"), ("c", "cond.pregnancy"), ("d", "cond.sepsis")], "ctx_id string, concept string")
    quantities = spark.createDataFrame([(i, "q.age_years", Decimal(v)) for i, v in zip("abcd", (18, 30, 20, 17))], "ctx_id string, quantity string, value decimal(38,18)")
    got = sorted((r["ctx_id"], r["stmt_id"].split(".")[-3]) for r in kb.derivable(base, contexts, concepts, quantities).collect())
    a, b = A.split(".")[1], B.split(".")[1]
    assert got == sorted([(i, "free") for i in "abcde"] + [("a", a), ("c", a), ("c", b)])


def test_fact_lines(spark):
    got = [r["line"] for r in kb.fact_lines(kb.knowledge_base(spark, merged(DOC_A, DOC_A))).collect()]
    assert got == sorted(set(got)) and f"condition('{A}.bind.1','{A}.stmt.0',interval('q.age_years',18,closed,lower))." in got
    assert f"direction('{A}.rule.0',for)." in got and f"source('{A}.rule.0','{A}',[0],\"basis\")." in got and len(got) == 9


def test_single_bound_battery(spark):
    """Every subset of the eight (value, marker) bounds: just the singletons obey the law."""
    eight = [(v, o, d) for v in (0, 18) for o in ("open", "closed") for d in ("lower", "upper")]
    rows = [(k, [b for i, b in enumerate(eight) if k >> i & 1]) for k in range(256)]
    df = spark.createDataFrame([(k, [(Decimal(v), o, d) for v, o, d in b]) for k, b in rows], "k int, bounds array<struct<value:decimal(38,18),openness:string,side:string>>")
    got = df.select("k", intervals.single_bound_law("bounds").alias("ok")).collect()
    assert sum(r["ok"] for r in got) == 8 and all(r["ok"] == (bin(r["k"]).count("1") == 1) for r in got)
    odd = [(Decimal(v) if v is not None else None, o, d) for v, o, d in product((None, -1, 5), ("open", "closed", "ajar"), ("lower", "upper", "up"))]
    df = spark.createDataFrame([([x],) for x in odd], "bounds array<struct<value:decimal(38,18),openness:string,side:string>>")
    assert df.where(intervals.single_bound_law("bounds")).count() == 4


def test_ranges_against_brute_force(spark):
    """All pairs of one-quantity ranges over small ends, on a grid of half steps."""
    ends = [None, *((v, f) for v in (0, 1, 2) for f in (0, 1))]
    grid = [x / 4 for x in range(-4, 14)]
    inside = lambda lo, hi, x: (lo is None or x > lo[0] or (x == lo[0] and not lo[1])) and (hi is None or x < hi[0] or (x == hi[0] and hi[1]))
    ranges = list(product(ends, ends))
    pack = lambda e: None if e is None else e[0] * 200 + e[1]
    rows = [(i, j, [("q", pack(a), pack(b))], [("q", pack(c), pack(d))]) for i, (a, b) in enumerate(ranges) for j, (c, d) in enumerate(ranges)]
    df = spark.createDataFrame(rows, "i int, j int, a array<struct<quantity:string,lo:bigint,hi:bigint>>, b array<struct<quantity:string,lo:bigint,hi:bigint>>")
    for r in df.select("i", "j", intervals.ranges_conflict_free("a", "b").alias("ok")).collect():
        (a, b), (c, d) = ranges[r["i"]], ranges[r["j"]]
        assert r["ok"] == any(inside(a, b, x) and inside(c, d, x) for x in grid), (a, b, c, d)


def test_intersect_keeps_one_sided_groups(spark):
    kind = "q string, lo struct<v:decimal(38,18),f:int>, hi struct<v:decimal(38,18),f:int>"
    one = spark.createDataFrame([("p", (Decimal(1), 0), None), ("q", (Decimal(2), 1), (Decimal(5), 1))], kind)
    two = spark.createDataFrame([("q", (Decimal(2), 0), (Decimal(4), 0)), ("r", None, None)], kind)
    got = {r["q"]: (r["lo"], r["hi"]) for r in intervals.intersect(one, two, ["q"]).collect()}
    assert got["q"] == ((Decimal(2), 1), (Decimal(4), 0)) and got["p"][1] is None and got["r"] == (None, None)


def test_pair_numbers_survive_drops(spark):
    rules = spark.createDataFrame([("group.g", "k", x, x in "ac") for x in "abcd"], "group_id string, action_key string, id string, positive boolean")
    got = pairs.query_ids(pairs.numbered(pairs.eligible_pairs(rules))).orderBy("n").collect()
    assert [(r["a_id"], r["b_id"], r["n"]) for r in got] == [("a", "b", 1), ("a", "d", 2), ("b", "c", 3), ("c", "d", 4)] and got[2]["q1_id"] == "q.g.pair3.overlap"


def test_attach_and_division(spark):
    rows = spark.createDataFrame([("d", 1, "s"), ("d", 2, "x"), ("d", 3, "s"), ("d", 4, "x"), ("e", 1, "x")], "doc string, o int, kind string")
    got = sets.attach_preceding(rows, "doc", ["o"], F.col("kind") == "s", F.col("o"), "at").where("kind = 'x'").orderBy("doc", "o").collect()
    assert [r["at"] for r in got] == [1, 3, None]
    owners, items = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, True), (1, False), (2, True), (2, None)], "k int, ok boolean")
    assert [r["k"] for r in sets.all_hold(owners, items, "k", F.col("ok")).collect()] == [3]
    assert sets.dense_from_zero(spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 0)], "p string, n int"), "p", "n").orderBy("p").collect() == [("b",), ("c",)]


@pytest.mark.parametrize("text,ok", [("d.rule.0", True), ("a.b.rule.10", True), (".rule.0", False), ("a..rule.0", False), ("d.rule.00", False), ("d.rul.0", False), ("d.rule.-1", False), ("d.rule.0\n", False)])
def test_ids(spark, text, ok):
    assert spark.createDataFrame([(text,)], "i string").select(kb.valid_id("i")).first()[0] is ok
