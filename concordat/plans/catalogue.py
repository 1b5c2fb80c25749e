"""Queries that apply the operators to the driver's tables, each over whole tables.

The tables hold no clinical data; every query binds an operator to columns that exercise it. Each
function takes (spark, sf_dir); SQL of the same name, for DuckDB, is in catalogue_sql.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat import schema
from concordat.functions import canon, rational, text
from concordat.operators import exceptions, graph, intervals, kb, metrics, pairs, sets, smt
from concordat.session import read_table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- rules, ranges and conflicts -------------------------------------------------------------


def order_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rules: customers are groups, priorities actions, status the direction."""
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("action_key"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").isin("O", "P").alias("positive"))


def line_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as bounds on one of three quantities: open lines from below, filled ones from above."""
    lines = read_table(spark, sf, "lineitem")
    lower = F.col("l_linestatus") == "O"
    return lines.select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_suppkey") % 3).alias("quantity"),
        (F.col("l_quantity") + F.when(lower, 0).otherwise(10)).cast("decimal(18,2)").alias("value"),
        F.when(lower, "lower").otherwise("upper").alias("side"),
        F.when(lower, F.col("l_returnflag") == "R").otherwise(F.col("l_returnflag") == "A").alias("is_open"),
    )


@query
def eligible_pairs(spark, sf):
    return pairs.numbered(pairs.eligible_pairs(order_rules(spark, sf))).withColumn("n", F.col("n").cast("long"))


@query
def interval_fold(spark, sf):
    folded = intervals.fold_packed(line_bounds(spark, sf), ["id", "quantity"])
    return folded.select("id", "quantity", *[F.coalesce(c, F.lit(-1)).alias(n) for c, n in ((intervals.end_value("lo").cast("double"), "lo_value"), (F.col("lo") % 2, "lo_open"), (intervals.end_value("hi").cast("double"), "hi_value"), (F.col("hi") % 2, "hi_closed"))], intervals.packed_empty("lo", "hi").alias("is_empty"))


@query
def interval_overlap(spark, sf):
    """Orders of one customer that bound the same quantity: have the ranges a common value?"""
    folded = intervals.fold_packed(line_bounds(spark, sf), ["id", "quantity"])
    owned = folded.join(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")
    side = lambda p: owned.select("o_custkey", "quantity", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "lo", "hi")])
    both = side("a").join(side("b"), ["o_custkey", "quantity"]).where("a_id < b_id")
    return both.select("a_id", "b_id", "quantity", (~intervals.packed_empty(F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi"))).alias("overlap"))


@query
def interval_coherent(spark, sf):
    part = read_table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    given = part.select("p_partkey", F.when(k % 4 < 2, size).alias("ge"), F.when((k % 4).isin(1, 2), size).alias("gt"), F.when(k % 5 < 2, F.lit(25)).alias("le"), F.when((k % 5).isin(1, 2), F.lit(25)).alias("lt"))
    return given.select("p_partkey", intervals.coherent("ge", "gt", "le", "lt").alias("coherent"))


@query
def bound_satisfaction(spark, sf):
    """Account balances against one bound per nation, of all four kinds."""
    c, n = read_table(spark, sf, "customer"), read_table(spark, sf, "nation")
    bounds = n.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 300).cast("double").alias("bound"), F.when(F.col("n_nationkey") % 2 == 0, "open").otherwise("closed").alias("openness"), F.when(F.col("n_nationkey") % 4 < 2, "lower").otherwise("upper").alias("side"))
    return c.join(bounds, "c_nationkey").select("c_custkey", intervals.satisfies("c_acctbal", "bound", "openness", "side").alias("satisfied"))


@query
def conflict_pairs(spark, sf):
    """Eligible pairs of orders whose ranges all have common values. Bounds are dealt by order
    once, which serves both folds; the pair test runs inside the join, on arrays of ranges."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = intervals.fold_packed(line_bounds(spark, sf).repartition(n, "id"), ["id", "quantity"])
    ranges = folded.groupBy("id").agg(F.collect_list(F.struct("quantity", "lo", "hi")).alias("ranges"))
    rules = order_rules(spark, sf).join(ranges, "id", "left")
    none = F.array().cast(ranges.schema["ranges"].dataType)
    rules = rules.withColumn("ranges", F.coalesce("ranges", none))
    found = pairs.eligible_pairs(rules, keep=("ranges",)).where(intervals.ranges_conflict_free("a_ranges", "b_ranges"))
    return found.select("group_id", "action_key", "a_id", "b_id")


@query
def unsatisfiable_rules(spark, sf):
    """Orders that contradict themselves: some quantity has no value left."""
    folded = intervals.fold_packed(line_bounds(spark, sf), ["id", "quantity"])
    return folded.where(intervals.packed_empty("lo", "hi")).groupBy("id").agg(F.count("*").alias("n_empty"))


def table_kb(spark: SparkSession, sf: str) -> kb.Kb:
    """A knowledge base with defects, from customers, orders and lines."""
    c, o, ln, n = (read_table(spark, sf, t) for t in ("customer", "orders", "lineitem", "nation"))
    rule, stmt = F.concat(F.lit("d.rule."), F.col("c_custkey")), F.concat(F.lit("d.stmt."), F.col("o_orderkey"))
    seg, status = F.col("c_mktsegment"), F.col("o_orderstatus")
    high_low = F.explode(F.array(F.lit("high"), F.lit("low")))
    sepsis = F.when(F.col("l_returnflag") == "A", "cond.sepsis").when(F.col("l_returnflag") == "R", "cond.bogus")
    is_range = ~F.col("l_returnflag").isin("A", "R")
    return {
        "rule": o.select(F.concat(F.lit("d.rule."), F.col("o_custkey")).alias("rule_id"), stmt.alias("stmt_id")),
        "direction": c.select(rule.alias("rule_id"), F.when(seg == "BUILDING", "for").when(seg == "MACHINERY", "sideways").otherwise("against").alias("direction")),
        "strength": c.where("c_acctbal >= 0").select(rule.alias("rule_id"), F.lit("strong").alias("strength")),
        "certainty": c.where("c_nationkey < 5").select(rule.alias("rule_id"), high_low.alias("certainty")),
        "population": o.where(status.isin("O", "F")).select(stmt.alias("stmt_id"), F.lit("pop.patient").alias("population")),
        "action": o.select(stmt.alias("stmt_id"), F.when(status == "O", "act.administer:drug.abx_a").when(status == "F", "act.administer").otherwise("act.bogus:drug.abx_a").alias("action_key")),
        "condition": ln.select(
            F.concat(F.lit("d.bind."), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bind_id"), F.concat(F.lit("d.stmt."), F.col("l_orderkey")).alias("stmt_id"), F.when(is_range, "interval").otherwise("concept").alias("tag"), sepsis.alias("concept"),
            F.when(is_range, "q.age_years").alias("quantity"), F.when(is_range, F.col("l_quantity")).cast("decimal(38,18)").alias("bound"), F.when(is_range, F.when(F.col("l_linestatus") == "O", "open").otherwise("ajar")).alias("openness"), F.when(is_range, "lower").alias("side"),
        ),
        "exception": ln.where("l_quantity > 40").select(
            F.concat(F.lit("d.exc."), F.col("l_orderkey")).alias("exc_id"), F.concat(F.lit("d.stmt."), F.col("l_orderkey") + F.when(F.col("l_tax") > 0.07, 10_000_000).otherwise(0)).alias("stmt_id"), F.when(F.col("l_discount") > 0.08, "other").otherwise("concept").alias("tag"), F.lit("cond.sepsis").alias("concept"),
            *[F.lit(None).cast(t).alias(c) for c, t in (("quantity", "string"), ("bound", "decimal(38,18)"), ("openness", "string"), ("side", "string"))],
        ),
        "source": n.select(F.concat(F.lit("d.rule."), F.col("n_nationkey")).alias("id"), F.lit("d").alias("doc_id"), F.array(F.lit(0), F.col("n_regionkey")).alias("regions"), F.lit(None).cast("string").alias("basis")),
    }


@query
def kb_violations(spark, sf):
    return kb.violations(table_kb(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query
def kb_fact_lines(spark, sf):
    """The fact lines of the rule-level relations, hashed line by line."""
    base = table_kb(spark, sf)
    some = {k: base[k] for k in ("direction", "strength", "certainty")}
    return kb.fact_lines(some).select("line", F.sha2("line", 256).alias("line_sha"))


@query
def derivable(spark, sf):
    """Nations as statements with a segment, and for some a least balance, as conditions and
    another segment as exception; customers as contexts."""
    n, c, o = (read_table(spark, sf, t) for t in ("nation", "customer", "orders"))
    k = F.col("n_nationkey")
    stmt = F.concat(F.lit("d.stmt."), k)
    segs = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    pick = lambda i: F.element_at(segs, (i % 5 + 1).cast("int"))
    blank = {"quantity": F.lit(None).cast("string"), "bound": F.lit(None).cast("decimal(38,18)"), "openness": F.lit(None).cast("string"), "side": F.lit(None).cast("string")}
    seg = n.where(k % 4 != 3).select(F.concat(F.lit("d.bind."), k).alias("bind_id"), stmt.alias("stmt_id"), F.lit("concept").alias("tag"), pick(k).alias("concept")).withColumns(blank)
    least = n.where(k % 3 == 0).select(F.concat(F.lit("d.bind.1"), k).alias("bind_id"), stmt.alias("stmt_id"), F.lit("interval").alias("tag"), F.lit(None).cast("string").alias("concept"), F.lit("balance").alias("quantity"), (k * 200).cast("decimal(38,18)").alias("bound"), F.when(k % 2 == 0, "closed").otherwise("open").alias("openness"), F.lit("lower").alias("side"))
    bar = n.where(k % 4 != 1).select(F.concat(F.lit("d.exc."), k).alias("exc_id"), stmt.alias("stmt_id"), F.lit("concept").alias("tag"), F.concat(F.lit("priority "), (k % 5 + 1).cast("string")).alias("concept")).withColumns(blank)
    base = {"rule": n.select(F.concat(F.lit("d.rule."), k).alias("rule_id"), stmt.alias("stmt_id")), "condition": seg.unionByName(least), "exception": bar}
    contexts = c.select(F.col("c_custkey").alias("ctx_id"))
    concepts = c.select(F.col("c_custkey").alias("ctx_id"), F.col("c_mktsegment").alias("concept")).union(o.select("o_custkey", F.concat(F.lit("priority "), F.substring("o_orderpriority", 1, 1)))).distinct()
    quantities = c.select(F.col("c_custkey").alias("ctx_id"), F.lit("balance").alias("quantity"), F.col("c_acctbal").cast("decimal(38,18)").alias("value"))
    return kb.derivable(base, contexts, concepts, quantities).select("ctx_id", "stmt_id")


@query
def relational_division(spark, sf):
    """Customers all of whose orders cost over 20000, those without orders among them."""
    c, o = read_table(spark, sf, "customer").select("c_custkey"), read_table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return sets.all_hold(c, o, "c_custkey", F.col("o_totalprice") > 20000)


@query
def exception_expansion(spark, sf):
    """Per customer, an exception for each of its priorities, cloned to each of its orders and
    numbered through its nation."""
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    stmts = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("doc"), F.col("o_custkey").alias("rule"), F.col("o_orderkey").alias("stmt"))
    excs = stmts.join(o.select(F.col("o_orderkey").alias("stmt"), F.col("o_orderpriority").alias("exc")), "stmt").select("doc", "rule", "exc").distinct()
    return exceptions.clone_exceptions(stmts, excs, "doc", "rule", ["rule", "stmt"], ["exc"]).withColumn("exc_no", F.col("exc_no").cast("long"))


@query
def exception_atoms(spark, sf):
    """Sorted atoms of each order with the flags of filled lines negated."""
    lines = read_table(spark, sf, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")))).alias("e"))
    return per.select("l_orderkey", F.array_join(exceptions.expand("a", "e"), "|").alias("atoms"))


@query
def smt_bodies(spark, sf):
    """The deontic query of each eligible pair of orders."""
    p = pairs.query_ids(pairs.numbered(pairs.eligible_pairs(order_rules(spark, sf).withColumn("p", F.col("positive")), keep=("p",))))
    body = smt.deontic_body(F.col("a_id").cast("string"), "a_p", F.col("b_id").cast("string"), "b_p", "action_key")
    return p.select("q1_id", "q2_id", body.alias("body"), smt.surface_markers(body).alias("looks_right"))


@query
def smt_guards(spark, sf):
    """Guard terms of the ranges of each order."""
    folded = intervals.fold_packed(line_bounds(spark, sf), ["id", "quantity"])
    whole = lambda end: F.shiftright(end, 1).cast("long") / 100
    lo, hi = whole("lo").cast("long"), whole("hi").cast("long")
    is_open, closed = F.col("lo") % 2 == 1, F.col("hi") % 2 == 1
    atom = F.struct(F.lit("interval").alias("tag"), F.lit(None).cast("string").alias("concept"), F.concat(F.lit("q."), F.col("quantity")).alias("var"), F.when(~is_open, lo).alias("ge"), F.when(is_open, lo).alias("gt"), F.when(closed, hi).alias("le"), F.when(~closed, hi).alias("lt"))
    per = folded.groupBy("id").agg(F.sort_array(F.collect_list(atom)).alias("atoms"))
    return per.select("id", smt.guard(F.array("atoms")).alias("guard"), F.array_join(smt.declarations([F.array("atoms")]), "\n").alias("declared"))


# --- documents -------------------------------------------------------------------------------

SURFACES = ["the", "and", "that", "tion", "password", "secret", "Licensed under", "de la", "de"]


@query
def dictionary_scan(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.explode(text.scan("text", SURFACES)).alias("surface"))
    return docs.groupBy("doc_id", "surface").agg(F.count("*").alias("n"))


@query
def string_policies(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(text.semantic_en_ascii("text"), 256).alias("folded_sha"), text.identifier_ascii("source").alias("source_id"), text.byte_length("text").cast("long").alias("n_bytes"))


@query
def text_spans(spark, sf):
    """Every line of every text as a span by byte offsets, cut again from the whole text's bytes."""
    docs = read_table(spark, sf, "documents")
    ends = F.transform("lines", lambda line, i: F.aggregate(F.slice("lines", F.lit(1), i + 1), F.lit(-1).cast("long"), lambda n, x: n + F.octet_length(x) + 1))
    lines = docs.select("doc_id", "text", F.split("text", "\n").alias("lines"))
    spans = lines.select("doc_id", "text", F.posexplode(F.arrays_zip("lines", ends.alias("ends"))).alias("line", "s"))
    start, end = F.col("s.ends") - F.octet_length("s.lines"), F.col("s.ends")
    return spans.select("doc_id", F.col("line").cast("long").alias("line"), start.alias("start"), end.alias("end"), text.sha256(text.byte_slice("text", start, end)).alias("text_hash"))


@query
def nearest_preceding(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    got = sets.attach_preceding(turns, "conv_id", ["turn"], F.col("role") == "user", F.col("turn"), "user_turn")
    return got.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("user_turn", F.lit(-1).cast("long")).alias("user_turn"))


@query
def trace_closure(spark, sf):
    """First turn above each turn, and how far up."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    edges = turns.withColumn("up", F.col("turn") - 1)
    return graph.roots(edges, ["conv_id", "turn"], ["conv_id", "up"]).select("conv_id", "turn", F.col("r1").alias("root"), "depth")


# --- groups ----------------------------------------------------------------------------------


@query
def slot_resolution(spark, sf):
    events = read_table(spark, sf, "events")
    kinds = events.groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("event_type").isin("purchase", "error") & (F.col("value") > 50), F.col("event_type")))).alias("kinds"))
    status, value = sets.slot(F.col("kinds"))
    return kinds.select("user_id", F.size("kinds").cast("long").alias("n"), status.alias("status"), value.alias("value"), F.array_min("kinds").alias("lowest"))


@query
def counter_ids(spark, sf):
    lines = read_table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    got = sets.counted(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "k")
    return got.select("l_orderkey", "l_linenumber", F.concat_ws(".", F.col("l_orderkey"), F.lit("seg"), F.col("k")).alias("seg_id"))


@query
def content_hash(spark, sf):
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    row = canon.object_of({"name": canon.string("n_name"), "region": canon.tagged("region", canon.string("r_name")), "key": canon.integer("n_nationkey"), "note": F.when(F.col("n_nationkey") > 12, canon.string("n_name"))})
    return both.select("n_nationkey", row.alias("payload"), canon.content_hash(row).alias("hash"))


@query
def set_hash(spark, sf):
    return read_table(spark, sf, "part").groupBy("p_size").agg(F.collect_set("p_brand").alias("b")).select("p_size", text.set_hash("b").alias("hash"))


@query
def structural_hash(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    ids = F.transform("x", lambda s: s["l_partkey"])
    return per.select("l_orderkey", F.array_join(canon.local_names(ids), " ").alias("names"), canon.structural_hash(ids).alias("hash"))


@query
def replay_diff(spark, sf):
    o = read_table(spark, sf, "orders").select(F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("hash"), "o_totalprice", "o_orderpriority")
    return sets.difference(o.where("o_totalprice > 10000").select("hash"), o.where("o_orderpriority <> '1-URGENT'").select("hash"))


@query
def severity_fold(spark, sf):
    rank = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 5}
    events = read_table(spark, sf, "events")
    per = events.groupBy("user_id").agg(F.max(metrics.severity(rank, "event_type")).alias("rank"))
    return per.select("user_id", F.col("rank").cast("long").alias("rank"), metrics.outcome_of("rank", schema.OUTCOMES).alias("outcome"))


def day_prints(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = read_table(spark, sf, "events")
    prints = events.groupBy("user_id", F.weekday("ts").alias("sample")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), "\n").alias("print"))
    return prints, events.select("user_id").distinct()


@query
def sample_agreement(spark, sf):
    prints, users = day_prints(spark, sf)
    return metrics.agreeing_pairs(prints, users, "user_id", 7)


@query
def k_sample_convergence(spark, sf):
    prints, users = day_prints(spark, sf)
    return metrics.convergence(metrics.agreeing_pairs(prints, users, "user_id", 7))


@query
def failure_taxonomy(spark, sf):
    events = read_table(spark, sf, "events")
    bad = events.where("event_type = 'error'").withColumn("code", F.when(F.col("value") > 50, "high").otherwise("low"))
    per = metrics.histogram(bad, "user_id", "code", events.select("user_id").distinct())
    return per.select("user_id", F.array_join(F.transform("taxonomy", lambda x: F.concat_ws(":", x["code"], x["n"])), ",").alias("taxonomy"))


@query
def key_coherence(spark, sf):
    """Tables' keys that repeat, aren't dense or point nowhere."""
    o, c, n = (read_table(spark, sf, t) for t in ("orders", "customer", "nation"))
    dup = kb.repeated(read_table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).withColumn("what", F.lit("repeated line"))
    idle = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").agg(F.count("*").alias("n")).withColumn("what", F.lit("customer without order"))
    lost = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_anti").agg(F.count("*").alias("n")).withColumn("what", F.lit("customer without nation"))
    return dup.unionByName(idle).unionByName(lost).select("what", "n")
