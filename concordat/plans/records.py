"""Queries over the library's sources, readers, validators and metrics, on whole driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import canon, model, text
from concordat.operators import intervals, kb, metrics, sets, smt, trace, verdicts
from concordat.operators.graph import kept
from concordat.plans import records_sql
from concordat.session import read_table, shared_dir
from concordat.sources import cassettes, cnl, jsonl, registry, terms

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- controlled language ---------------------------------------------------------------------


def controlled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, text): customers as documents, orders as rule and exception blocks."""
    blocks = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr(records_sql.BLOCKS).alias("b"))
    per = blocks.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "b"))), lambda x: x["b"]), "").alias("body")).hint("merge")  # small files, large texts
    c = read_table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    ident = F.concat(F.lit("d"), "c_custkey")
    return c.select(ident.alias("document_id"), F.concat(F.lit("document "), ident, F.coalesce("body", F.lit("")), F.when(F.col("c_custkey") % 10 == 3, F.lit("\n\nrule 999999999 recommend")).otherwise(F.lit(""))).alias("text"))


@query
def cnl_facts(spark, sf):
    """All facts of the documents that parse, and the rejects of those that don't."""
    got = cnl.parse(controlled_documents(spark, sf))
    rest = F.concat_ws("|", "tag", "concept", "quantity", "bound", "openness", "side", F.array_join("regions", ","), "basis", F.col("reject_index").cast("string"))
    return got.select("document_id", "relation", "a", "b", rest.alias("rest"))


@query
def cnl_fact_violations(spark, sf):
    """A knowledge base of parsed documents is whole; some of its relations are thinned out."""
    base = cnl.relations(kept(cnl.parse(controlled_documents(spark, sf))))  # else parsed anew for every use of a relation
    doc = lambda c: F.regexp_extract(c, r"\Ad(\d+)\.", 1).cast("long")
    base["population"] = base["population"].where(doc("stmt_id") % 7 != 0)
    base["strength"] = base["strength"].unionByName(base["strength"].where(doc("rule_id") % 9 == 1))
    base["rule"] = base["rule"].where(doc("rule_id") % 11 != 2)
    return kb.violations(base).groupBy("kind").agg(F.count("*").alias("n"))


@query
def kb_conflicts(spark, sf):
    """Orders as rules of one statement; customers are actions, lines conditions and exceptions."""
    o, ln = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    rule, stmt, bind = F.concat(F.lit("d.rule."), "o_orderkey"), F.concat(F.lit("d.stmt."), "o_orderkey"), F.concat_ws(".", F.lit("d.bind"), "l_orderkey", "l_linenumber")
    of, none, lower = F.concat(F.lit("d.stmt."), "l_orderkey"), F.lit(None).cast("string"), F.col("l_linestatus") == "O"
    value = (F.col("l_quantity") + F.when(lower, 0).otherwise(10)).cast("decimal(38,18)")
    is_open = F.when(lower, F.col("l_returnflag") == "R").otherwise(F.col("l_returnflag") == "A")
    ranges = ln.select(bind.alias("bind_id"), of.alias("stmt_id"), F.lit("interval").alias("tag"), none.alias("concept"), F.concat(F.lit("q."), F.col("l_suppkey") % 3).alias("quantity"), value.alias("bound"), F.when(is_open, "open").otherwise("closed").alias("openness"), F.when(lower, "lower").otherwise("upper").alias("side"))
    named = lambda rows, key: rows.select(bind.alias(key), of.alias("stmt_id"), F.lit("concept").alias("tag"), F.col("l_returnflag").alias("concept"), none.alias("quantity"), F.lit(None).cast("decimal(38,18)").alias("bound"), none.alias("openness"), none.alias("side"))
    base = {
        "rule": o.select(rule.alias("rule_id"), stmt.alias("stmt_id")),
        "direction": o.select(rule.alias("rule_id"), F.when(F.col("o_orderstatus") == "O", "for").when(F.col("o_orderstatus") == "P", "permit").otherwise("contraindicate").alias("direction")),
        "action": o.select(stmt.alias("stmt_id"), F.concat(F.lit("a:"), "o_custkey").alias("action_key")),
        "condition": ranges.unionByName(named(ln.where("l_linenumber = 1"), "bind_id")),
        "exception": named(ln.where("l_linenumber = 2"), "exc_id"),
    }
    return kb.conflict_pairs(base)


# --- recorded calls --------------------------------------------------------------------------


@query
def cassette_replay(spark, sf):
    """Recorded outputs by route, source and seed: found, missing, of another constraint, or no hex."""
    b = read_table(spark, sf, "benchmark")
    tape = b.select(F.lit("route.a").alias("route"), F.col("item_id").alias("source"), (F.col("item_id") % 3).alias("seed"), F.when(F.col("item_id") % 5 == 0, F.upper(text.hex_text("text"))).otherwise(text.hex_text("text")).alias("output_hex"), F.concat(F.lit("c"), F.col("item_id") % 7).alias("constraint_hash"))
    asked = b.select(F.lit("route.a").alias("route"), F.col("item_id").alias("source"), (F.col("item_id") % 4).alias("seed"), F.when(F.col("item_id") % 6 == 0, "other").otherwise(F.concat(F.lit("c"), F.col("item_id") % 7)).alias("constraint_hash"))
    return cassettes.replay(asked, tape).select("source", "seed", "problem", F.sha2("output", 256).alias("output_sha"))


@query
def accepted_fills(spark, sf):
    """Orders of a customer as attempts in turn: the first finished one is accepted unless an urgent
    pending one comes before it."""
    o = sets.counted(read_table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "attempt")
    attempts = o.select(F.lit("r").alias("route"), F.col("o_custkey").alias("source"), F.lit(0).alias("draw"), "attempt", F.concat(F.lit("out "), "o_orderkey").alias("output"), "o_orderstatus", "o_orderpriority")
    got = cassettes.accepted(attempts, 3, F.col("o_orderstatus") == "F", (F.col("o_orderstatus") == "P") & F.startswith("o_orderpriority", F.lit("1")))
    return got.select("source", "accepted", F.col("repairs").cast("long").alias("repairs"), "output")


@query
def absent_grounding(spark, sf):
    """Parts of lines where parts of even keys are grounded; suppliers in the black as a vocabulary."""
    ln, p, s = (read_table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    used = ln.select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_partkey").cast("string").alias("region_id"))
    known = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("region_id"))
    owned = used.join(known, "region_id").select("document_id", "region_id").distinct()
    lost = cassettes.ungrounded(used, owned).select("document_id", F.col("region_id").alias("id"), F.lit("region").alias("what"))
    words = ln.select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_suppkey").cast("string").alias("id"))
    alien = cassettes.off_vocabulary(words, s.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id")))
    return lost.unionByName(alien.select("document_id", "id", F.lit("word").alias("what")))


# --- logs, registries, lexica ----------------------------------------------------------------


@query
def log_round_trip(spark, sf):
    """Events as canonical lines of a log, in order over several files, written and read back."""
    e = read_table(spark, sf, "events")
    line = canon.object_of({"event": canon.string("event_type"), "run_id": canon.string(F.concat(F.lit("u"), "user_id")), "sequence": F.col("event_id").cast("string")})
    path = f"{shared_dir(spark)}/concordat-{spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    jsonl.write(e.select(F.col("event_id").alias("sequence"), line.alias("line")), path, files=4)
    return jsonl.read(spark, path, jsonl.EVENTS).select("sequence", "run_id", "event")


@query
def stage_chains(spark, sf):
    """Conversations as pipelines of turns: a turn needs its role and a tool, and makes what may follow."""
    t = read_table(spark, sf, "conversations")
    stages = t.select(F.col("conv_id").alias("pipeline"), F.col("turn").alias("ord"), F.when(F.col("turn") > 0, F.array(F.col("role"), F.lit("tool"))).otherwise(F.array().cast("array<string>")).alias("inputs"), F.when(F.col("role") == "user", F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("tool"))).alias("outputs"))
    return registry.chain_breaks(stages)


@query
def safe_paths(spark, sf):
    u, k = F.regexp_replace("url", r"\Ahttps?://", ""), F.col("page_id") % 6
    path = F.when(k == 0, u).when(k == 1, F.concat(F.lit("/"), u)).when(k == 2, F.concat(u, F.lit("/../x"))).when(k == 3, F.lit("")).when(k == 4, F.concat(F.lit("./"), u)).otherwise(F.concat(u, F.lit("//x")))
    return read_table(spark, sf, "pages").select("page_id", registry.is_safe_path(path).alias("safe"))


@query
def lexicon_candidates(spark, sf):
    """Nations as surfaces of their regions' concepts, loaded as a lexicon: the concepts of a surface."""
    rows = read_table(spark, sf, "nation").collect()
    concepts = [{"id": f"reg.{k}", "surface": [f"{r['n_name']}　w{r['n_nationkey'] % 4}" if r["n_nationkey"] % 2 else f"w{r['n_nationkey'] % 10}" for r in rows if r["n_regionkey"] == k]} for k in sorted({r["n_regionkey"] for r in rows})]
    concepts = [c | {"surface": list(dict.fromkeys(c["surface"]))} for c in concepts]
    lex = registry.lexicon({"system": "nations", "concepts": concepts})
    return spark.createDataFrame([(s, ",".join(ids)) for s, ids in lex.candidates().items()], "surface string, concepts string")


@query
def term_entries(spark, sf):
    """Part names as terms, rendered as lexicon entries and read back."""
    p = read_table(spark, sf, "part")
    table = p.select(F.when(F.col("p_size") % 2 == 0, "drug").otherwise("concept").alias("kind"), F.concat(F.lit("p."), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("surface"))
    lines = terms.entry_lines(terms.word_forms(table))
    return terms.read_lines(lines.unionByName(spark.createDataFrame([("% a comment",), ("",), ("no entry",)], "line string")))


@query
def term_integrity(spark, sf):
    own = terms.surfaces(spark)
    n = read_table(spark, sf, "nation").select(F.lit("concept").alias("kind"), F.concat(F.lit("cond.n"), "n_nationkey").alias("id"), F.concat(F.lit("word"), F.col("n_nationkey") % 15).alias("surface"))
    return terms.integrity(own.where("surface <> 'sepsis'").unionByName(n))


# --- readers and validators ------------------------------------------------------------------

#: The type of a payload: members by name, optional ones with a question mark.
PAYLOAD = {"k": "integer", "note?": "folded", "share?": "rational", "tags": ("set", "name")}


@query
def canonical_reads(spark, sf):
    """Payloads in a canonical form and in eleven others, read as their type: what is wrong first."""
    e = read_table(spark, sf, "events").select("event_id", F.expr(records_sql.PAYLOADS).alias("payload"))
    return canon.read_errors(e, "payload", PAYLOAD).select("event_id", "error")


@query
def solver_outputs(spark, sf):
    """Outputs of a solver by kind of event: verdict, core, version, and what a report makes of them."""
    e = read_table(spark, sf, "events")
    k = F.col("event_id") % 7
    out = F.when(k == 0, "sat\n(model)").when(k == 1, F.concat(F.lit("unsat\n(|a.d.rule."), F.col("user_id"), F.lit("| a.x |a.x|)\n"))).when(k == 2, "unknown").when(k == 3, "timeout").when(k == 4, "(error \"line 1\")\nsat").when(k == 5, " sat").otherwise("unsat\n()")
    role = F.when(F.col("event_id") % 2 == 0, "overlap").otherwise("deontic")
    token = smt.verdict_token("out")
    seen = F.coalesce(token, F.when(F.col("out") == "timeout", "timeout").when(F.startswith("out", F.lit("(error")), "error"))
    rows = e.select("event_id", out.alias("out"), role.alias("role"), F.concat_ws(" ", F.lit("Z version"), F.concat(F.lit("4."), F.col("user_id")), F.lit("- 64 bit")).alias("banner"))
    rows = rows.select("event_id", "role", token.alias("verdict"), F.array_join(smt.unsat_core("out"), ",").alias("core"), smt.solver_version("banner").alias("version"), verdicts.category("role", seen).alias("category"))
    return rows.withColumn("part", verdicts.partition("category", "role", "verdict"))


@query
def result_checks(spark, sf):
    """Verifier results with models, cores and categories that may contradict the verdict."""
    e = read_table(spark, sf, "events")
    k, m = F.col("event_id") % 6, F.col("user_id") % 5
    core = F.when(m == 0, F.array(F.lit("a.x"), F.lit("a.y"))).when(m == 1, F.array(F.lit("b"), F.lit("a"))).when(m == 2, F.array(F.lit("a"), F.lit("a"))).when(m == 3, F.array().cast("array<string>"))
    rows = e.select(
        F.concat(F.lit("q."), "event_id").alias("query_id"), F.when(k < 2, "sat").when(k < 4, "unsat").when(k == 4, "unknown").alias("verdict"), F.when(F.col("event_type") == "view", "m").when(F.col("event_type") == "click", " ").alias("model"), core.alias("core"),
        F.when(F.col("event_id") % 4 == 0, "semantic_contradiction").when(F.col("event_id") % 4 == 1, "semantic_no_conflict").when(F.col("event_id") % 4 == 2, "unknown").otherwise("solver_execution_failure").alias("category"),
    )
    return verdicts.result_violations(rows)


@query
def artifact_checks(spark, sf):
    """Customers as compiled artifacts, orders as their pairs, with defects by order."""
    o = sets.counted(read_table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "at").withColumns({"n": F.col("at") + 1, "k": F.col("o_orderkey"), "artifact": F.col("o_custkey").cast("string")})
    q = lambda end: F.concat(F.lit("q."), "k", F.lit(end))
    plan = o.select("artifact", "n", F.concat(F.lit("pair"), F.when(F.col("k") % 31 == 0, F.lit(1)).otherwise(F.col("n"))).alias("pair_id"), F.when(F.col("k") % 13 == 0, "z").otherwise("a").alias("constraint_a_id"), F.lit("b").alias("constraint_b_id"), F.lit("x").alias("action_a"), F.when(F.col("k") % 17 == 0, "y").otherwise("x").alias("action_b"), F.lit(True).alias("positive_a"), (F.col("k") % 19 == 0).alias("positive_b"), q(".o").alias("q1_id"), q(".d").alias("q2_id"))
    one = o.select("artifact", (2 * F.col("at")).alias("place"), F.when(F.col("k") % 23 == 0, "q.other").otherwise(q(".o")).alias("query_id"), F.when(F.col("k") % 29 == 0, "").otherwise("(check-sat)").alias("body"))
    two = o.where("k % 37 <> 0").select("artifact", (2 * F.col("at") + 1).alias("place"), q(".d").alias("query_id"), F.lit("(check-sat)").alias("body"))
    rules = F.when(F.col("k") % 7 == 0, F.array(F.lit("r2"), F.lit("r1"))).when(F.col("k") % 7 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), "k")))
    named = o.select("artifact", F.concat(F.when(F.col("k") % 5 == 0, "x.").when(F.col("k") % 5 == 1, "ctx.").otherwise("a."), F.when(F.col("k") % 7 == 0, "r1").otherwise(F.concat(F.lit("r"), "k"))).alias("assertion"), rules.alias("rule_ids"), F.array(F.lit("r.0")).alias("region_ids"))
    # orders may share a name; each name counts once, but every order's own lists are checked
    found = verdicts.artifact_violations(plan, one.unionByName(two), named.dropDuplicates(["artifact", "assertion"])).union(verdicts.assertion_violations(named)).distinct()
    return found.groupBy("artifact", "kind").agg(F.count("*").alias("n"))


@query
def trace_checks(spark, sf):
    """Customers' orders as findings of their groups, with defects by order."""
    o = sets.counted(read_table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "at").withColumns({"k": F.col("o_orderkey"), "group_id": F.concat(F.lit("g"), "o_custkey")})
    k = F.col("k")
    ident = F.concat(F.lit("finding."), "group_id", F.lit("."), F.when(k % 41 == 0, F.concat(F.lit("0"), "at")).when(k % 43 == 0, (F.col("at") + 100).cast("string")).otherwise(F.col("at").cast("string")))
    pools = F.when(k % 11 == 0, F.array(F.lit("b"), F.lit("a"))).when(k % 11 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    claims = o.select(
        ident.alias("finding_id"), "group_id", F.concat(F.lit("p"), "k", F.when(k % 13 == 0, F.lit(".")).otherwise(F.lit(".overlap"))).alias("query_id"), F.concat(F.lit("p"), "k").alias("pair_id"),
        F.when(k % 2 == 0, "semantic_contradiction").otherwise("semantic_no_conflict").alias("category"), F.when(k % 17 == 0, "sat").otherwise("unsat").alias("verdict"), F.when((k % 2 == 0) != (k % 19 == 0), "deontic_direction_conflict").alias("conflict_kind"),
        pools.alias("assertion_ids"), F.array(F.lit("r")).alias("region_ids"), F.array(F.lit("x")).alias("rule_ids"), F.when(k % 23 == 0, "nowhere").otherwise("report").alias("report_ref"),
    )
    nodes = spark.createDataFrame([("doc", "source", "a", "h"), ("report", "report", "r", None), ("doc", "source", "a", "h"), ("odd", "elsewhere", "", "h")], "node_id string, kind string, path string, content_hash string")
    edges = spark.createDataFrame([("doc", "report", "report"), ("report", "extract", "doc"), ("doc", "report", "lost")], "from_id string, operation string, to_id string")
    return trace.violations(nodes, edges, claims)


# --- scalars ---------------------------------------------------------------------------------


@query
def attempt_seeds(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", model.seed(F.col("o_orderkey") * 1_000_003, F.col("o_custkey") % 5).cast("string").alias("seed"))


@query
def close_words(spark, sf):
    """Words of part names against brands' words misspelt by a letter."""
    p = read_table(spark, sf, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    lexicon = words.select(F.explode(F.array(F.concat(F.col("word"), F.lit("x")), F.expr("substr(word, 2)"), F.concat(F.lit("q"), F.expr("substr(word, 2)")), F.reverse("word"))).alias("surface")).distinct()
    return text.close_spellings(words, lexicon).withColumn("distance", F.col("distance").cast("long"))


@query
def compatibility_policies(spark, sf):
    """The string policies on texts that end in compatibility characters."""
    t = F.concat("text", F.lit(" ﬁｎ①　Ａ、B。  "))
    d = read_table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(text.raw_source(t), 256).alias("raw"), F.sha2(text.source_nfkc(t), 256).alias("nfkc"), F.sha2(text.diagnostic_text(t), 256).alias("folded"), F.sha2(text.semantic_ja(t), 256).alias("ja"), F.sha2(text.semantic_en(t), 256).alias("en"))


@query
def range_intersections(spark, sf):
    """Ranges of odd and of even lines of an order, and their common part; bounds that break the rules."""
    ln = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 3).alias("quantity"), F.col("l_quantity").cast("decimal(38,18)").alias("bound"), F.when(F.col("l_returnflag") == "R", "open").when(F.col("l_returnflag") == "A", "closed").otherwise(F.when(F.col("l_tax") > 0.07, "ajar").otherwise("closed")).alias("openness"), F.when(F.col("l_linestatus") == "O", "lower").otherwise("upper").alias("side"), "l_linenumber")
    fold = lambda odd: intervals.fold_structs(ln.where(F.col("l_linenumber") % 2 == odd), ["id", "quantity"])
    both = intervals.intersect(fold(1), fold(0), ["id", "quantity"])
    end = lambda e: F.coalesce(F.col(f"{e}.v").cast("double"), F.lit(-1.0))
    return both.select("id", "quantity", end("lo").alias("lo"), end("hi").alias("hi"), F.coalesce("lo.f", F.lit(-1)).cast("long").alias("lo_open"), F.coalesce("hi.f", F.lit(-1)).cast("long").alias("hi_closed"), intervals.struct_empty("lo", "hi").alias("empty"))


@query
def single_bounds(spark, sf):
    """Orders whose lines of one quantity are one valid bound of at least 3."""
    ln = read_table(spark, sf, "lineitem")
    bound = F.struct((F.col("l_quantity") - 3).alias("value"), F.when(F.col("l_tax") > 0.07, "ajar").otherwise("open").alias("openness"), F.lit("lower").alias("side"))
    per = ln.groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("quantity")).agg(F.collect_list(bound).alias("bounds"))
    return per.select("l_orderkey", "quantity", intervals.single_bound_law("bounds").alias("lawful"))


@query
def sparse_numbers(spark, sf):
    """Orders whose lines aren't numbered 1 to n without gaps or repeats."""
    ln = read_table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"))
    return sets.dense_from_zero(ln, "l_orderkey", "n")


@query
def route_table(spark, sf):
    """The seven route metrics, and their deltas to one route: priorities are routes, customers groups."""
    o = read_table(spark, sf, "orders").withColumnsRenamed({"o_orderpriority": "route", "o_custkey": "group_id", "o_orderkey": "k"})
    fills = o.select("route", F.lit(3).alias("recorded_calls"), (F.col("k") % 3).alias("schema_violations"), (F.col("k") % 2).alias("repairs"), (F.col("o_orderstatus") == "O").alias("accepted"))
    st = F.col("o_orderstatus")
    results = o.select("route", "group_id", F.when(st == "O", "deontic").otherwise("overlap").alias("role"), F.when(st == "O", "semantic_contradiction").when(st == "F", "semantic_no_conflict").otherwise("target_syntax_failure").alias("category"), F.when(st != "P", "unsat").alias("verdict"), F.when(st == "O", F.array(F.concat(F.lit("a."), F.col("group_id") % 2))).alias("core"))
    samples = o.groupBy("route", "group_id", (F.col("k") % 3).alias("sample")).agg(F.max("o_orderstatus").alias("print"))
    reference = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), F.when(F.col("c_custkey") % 4 < 2, "semantic_contradiction").otherwise("semantic_no_conflict").alias("expected_outcome"), F.array(F.lit("a.0")).alias("expected_unsat_core"), F.lit(True).alias("expected_no_conflict_result"))
    routes = o.select("route").distinct()
    rows, _ = metrics.route_metrics(fills, results, samples, reference, routes, routes.withColumn("k", F.lit(3)))
    base = rows.where("den <> 0")
    d = metrics.deltas(base, "route", "1-URGENT").na.fill(0, ["num", "den"])
    return rows.withColumn("what", F.lit("value")).unionByName(d.withColumn("what", F.lit("delta")))
