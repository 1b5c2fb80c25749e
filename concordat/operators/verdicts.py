"""Verdicts of query pairs, decided symbolically, and what a report makes of them.

An eligible pair's second query asserts p and not p, so it is unsat whenever it runs; it runs only
if the first finds a common context. A contradiction is thus an eligible pair with overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators import pairs, smt


def _names(context: str, tag: str) -> Column:
    return F.transform(F.filter(F.flatten(context), lambda a: a["tag"] == tag), lambda a: a["concept"])


def _ends(context: str) -> Column:
    """Packed ends of each interval atom."""
    atoms = F.filter(F.flatten(context), lambda a: a["tag"] == "interval")
    lower = lambda a: F.greatest(a["ge"] * 2, a["gt"] * 2 + 1)
    upper = lambda a: F.least(a["le"] * 2 + 1, a["lt"] * 2)
    return F.transform(atoms, lambda a: F.struct(a["var"].alias("quantity"), lower(a).alias("lo"), upper(a).alias("hi")))


def contexts_overlap(a: str, b: str) -> Column:
    """May two contexts of one conjunction each hold at once? All interval atoms of a quantity, of
    either side, must share a value; over a dense order pairwise overlap of ranges is enough."""
    from concordat.operators.intervals import packed_empty

    need, bar = F.array_union(_names(a, "concept"), _names(b, "concept")), F.array_union(_names(a, "concept_negated"), _names(b, "concept_negated"))
    every = F.concat(_ends(a), _ends(b))
    clash = F.exists(every, lambda x: F.exists(every, lambda y: (x["quantity"] == y["quantity"]) & packed_empty(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"]))))
    return ~F.arrays_overlap(need, bar) & ~clash


def compiled(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Numbered query pairs of each group with both texts and the overlap. rules: document_id, rule_id,
    context, direction, action_key; groups: group_id, document_id."""
    members = rules.join(groups, "document_id").select("group_id", "action_key", F.col("rule_id").alias("id"), pairs.is_positive("direction").alias("positive"), "context", "direction", "document_id", F.col("source_region_ids").alias("regions"), pairs.is_positive("direction").alias("pos"))
    found = pairs.query_ids(pairs.numbered(pairs.eligible_pairs(members, keep=("context", "direction", "document_id", "regions", "pos"))))
    return found.withColumns(
        {
            "q1_body": smt.overlap_body("a_id", "a_context", "b_id", "b_context"),
            "q2_body": smt.deontic_body("a_id", "a_pos", "b_id", "b_pos", "action_key"),
            "overlap": contexts_overlap("a_context", "b_context"),
        }
    )


def outside_profile(rules: DataFrame, tags: tuple[str, ...] = ("concept", "concept_negated", "interval")) -> DataFrame:
    """Rules with an atom that the query language lacks; their pairs are dropped after numbering."""
    return rules.where(~F.forall(F.flatten("context"), lambda a: a["tag"].isin(*tags))).select("document_id", "rule_id")


def assertion_map(found: DataFrame) -> DataFrame:
    """(query_id, assertion, rule_id, region_ids) of every named assertion."""
    rows = [(q, p, side) for q, p in (("q1_id", "ctx."), ("q2_id", "a.")) for side in ("a", "b")]
    each = F.explode(F.array(*[F.struct(F.col(q).alias("query_id"), F.concat(F.lit(p), F.col(f"{s}_id")).alias("assertion"), F.col(f"{s}_id").alias("rule_id"), F.col(f"{s}_regions").alias("region_ids")) for q, p, s in rows]))
    return found.select("group_id", each.alias("m")).select("group_id", "m.*")


def results(found: DataFrame) -> DataFrame:
    """Results in order of pair and query: the second query only where contexts overlap."""
    q1 = F.struct(F.col("q1_id").alias("query_id"), F.lit("overlap").alias("role"), F.lit("semantic_no_conflict").alias("category"), F.when(F.col("overlap"), "sat").otherwise("unsat").alias("verdict"), F.when(~F.col("overlap"), F.sort_array(F.array(F.concat(F.lit("ctx."), F.col("a_id")), F.concat(F.lit("ctx."), F.col("b_id"))))).alias("core"))
    core = F.sort_array(F.array(F.concat(F.lit("a."), F.col("a_id")), F.concat(F.lit("a."), F.col("b_id"))))
    q2 = F.when(F.col("overlap"), F.struct(F.col("q2_id").alias("query_id"), F.lit("deontic").alias("role"), F.lit("semantic_contradiction").alias("category"), F.lit("unsat").alias("verdict"), core.alias("core")))
    rows = found.select("group_id", "n", F.posexplode(F.array_compact(F.array(q1, q2))).alias("place", "r"))
    from concordat.operators.sets import counted

    return counted(rows.select("group_id", "n", "place", "r.*"), ["group_id"], ["n", "place"], "seq").drop("place")


def category(role: Column | str, outcome: Column | str) -> Column:
    """Category of an outcome of a run: sat, unsat, unknown, timeout, error or none."""
    role, outcome = (F.col(x) if isinstance(x, str) else x for x in (role, outcome))
    return (
        F.when(outcome.isin("unknown", "timeout"), "unknown").when(outcome == "error", "target_syntax_failure").when(outcome.isNull() | (outcome == "none"), "solver_execution_failure")
        .when((role == "deontic") & (outcome == "unsat"), "semantic_contradiction").otherwise("semantic_no_conflict")
    )


def partition(category: Column | str, role: Column | str, verdict: Column | str) -> Column:
    """finding, no_conflict, or null for what a report leaves out (a satisfiable overlap is a step)."""
    category, role, verdict = (F.col(x) if isinstance(x, str) else x for x in (category, role, verdict))
    return F.when(category == "semantic_contradiction", "finding").when((category == "semantic_no_conflict") & ~((role == "overlap") & (verdict == "sat")), "no_conflict")


def findings(results: DataFrame, found: DataFrame, regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings and documented no-conflict results with the rules and quoted source texts of both
    sides, each text once and in order."""
    of = found.select("group_id", "n", F.explode(F.array(F.struct(F.col("a_document_id").alias("document_id"), F.col("a_id").alias("rule_id"), F.col("a_regions").alias("r")), F.struct(F.col("b_document_id").alias("document_id"), F.col("b_id").alias("rule_id"), F.col("b_regions").alias("r")))).alias("s")).select("group_id", "n", "s.document_id", "s.rule_id", F.explode("s.r").alias("region_id"))
    named = of.join(regions.select("document_id", "region_id", F.explode("span_ids").alias("span_id")), ["document_id", "region_id"]).join(spans.select("document_id", "span_id", "raw_text", "reading_order"), ["document_id", "span_id"])
    quotes = named.groupBy("group_id", "n").agg(F.sort_array(F.collect_set(F.struct("document_id", "reading_order", "raw_text"))).alias("q"), F.sort_array(F.collect_set("rule_id")).alias("rules"))
    kept = results.withColumn("part", partition("category", "role", "verdict")).where("part is not null")
    return kept.join(quotes, ["group_id", "n"], "left").select(
        F.concat(F.lit("finding."), F.col("group_id"), F.lit("."), F.col("seq")).alias("finding_id"), "group_id", "query_id", "part", "category", "verdict",
        F.when(F.col("part") == "finding", "deontic_direction_conflict").alias("conflict_kind"), "core", "rules", F.transform("q", lambda x: x["raw_text"]).alias("quoted"),
    )


def group_outcomes(results: DataFrame, reference: DataFrame) -> DataFrame:
    """(group_id, expected_outcome, matched) of reference groups (group_id, expected_outcome,
    expected_unsat_core, expected_no_conflict_result); a group without results is a miss."""
    return matched(results, reference, ("group_id",))


def matched(results: DataFrame, reference: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """group_outcomes with groups told apart by key."""
    contra = F.col("category") == "semantic_contradiction"
    per = results.groupBy(*key).agg(
        F.count_if(contra).alias("n_contra"), F.count("*").alias("n"), F.count_if(F.col("category") == "semantic_no_conflict").alias("n_none"), F.count_if(contra & (F.col("role") == "deontic")).alias("n_deontic"),
        F.max(F.when(contra, F.col("core"))).alias("core"), F.count_if((F.col("role") == "overlap") & (F.col("verdict") == "unsat")).alias("closed"),
    )
    j = reference.join(per, list(key), "left")
    hit = F.when(F.col("expected_outcome") == "semantic_contradiction", (F.col("n_contra") == 1) & (F.col("n_deontic") == 1) & (F.col("core") == F.sort_array(F.array_distinct("expected_unsat_core")))).when(
        F.col("expected_outcome") == "semantic_no_conflict", (F.col("n") > 0) & (F.col("n") == F.col("n_none")) & (~F.coalesce("expected_no_conflict_result", F.lit(False)) | (F.col("closed") >= 1))
    )
    return j.select(*key, "expected_outcome", F.coalesce(hit, F.lit(False)).alias("matched"))


# --- checks ----------------------------------------------------------------------------------


def artifact_violations(plan: DataFrame, bodies: DataFrame, assertions: DataFrame) -> DataFrame:
    """(artifact, kind, subject) of everything wrong with compiled artifacts. plan: artifact, n, pair_id,
    constraint_a_id, constraint_b_id, action_a, action_b, positive_a, positive_b, q1_id, q2_id; bodies:
    artifact, place (from 0), query_id, body; assertions: artifact, assertion, rule_ids, region_ids."""
    a, found = "artifact", []

    def add(df: DataFrame, kind: str, subject: Column | str) -> None:
        found.append(df.select(a, F.lit(kind).alias("kind"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject")))

    slots = plan.select(a, F.explode(F.array(F.struct((2 * F.col("n") - 2).cast("long").alias("place"), F.col("q1_id").alias("wanted")), F.struct((2 * F.col("n") - 1).cast("long").alias("place"), F.col("q2_id").alias("wanted")))).alias("s")).select(a, "s.*")
    counts = plan.groupBy(a).agg((2 * F.count("*")).alias("expected")).join(bodies.groupBy(a).agg(F.count("*").alias("held")), a, "full")
    add(counts.where(F.coalesce("expected", F.lit(0)) != F.coalesce("held", F.lit(0))), "QueryCount", F.concat_ws(" ", F.coalesce("expected", F.lit(0)).cast("string"), F.coalesce("held", F.lit(0)).cast("string")))
    add(slots.join(bodies, [a, "place"]).where("wanted <> query_id"), "QuerySlotMismatch", "place")
    add(bodies.where("coalesce(body, '') = ''"), "EmptyBody", "query_id")
    add(plan.where("constraint_a_id >= constraint_b_id or action_a <> action_b or positive_a = positive_b"), "PairInvalid", "pair_id")
    for df, key in ((plan, "pair_id"), (bodies, "query_id"), (assertions, "assertion")):
        add(df.groupBy(a, key).count().where("count > 1"), "Duplicate", key)
    out = assertion_violations(assertions)
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def assertion_violations(assertions: DataFrame) -> DataFrame:
    """The part of artifact_violations that single assertions tell, distinct."""
    named = F.exists("rule_ids", lambda r: F.col("assertion").isin(F.concat(F.lit("a."), r), F.concat(F.lit("ctx."), r)))
    tests = [F.when(F.col(pool) != F.sort_array(F.array_distinct(pool)), "Unsorted") for pool in ("rule_ids", "region_ids")]
    tests += [F.when(F.size(pool) == 0, "EmptyAssertionRefs") for pool in ("rule_ids", "region_ids")]
    tests.append(F.when((F.size("rule_ids") > 0) & ~named, "AssertionForm"))
    return assertions.select("artifact", F.explode(F.array_compact(F.array(*tests))).alias("kind"), F.col("assertion").alias("subject")).distinct()


def result_violations(results: DataFrame) -> DataFrame:
    """(query_id, kind) of results (query_id, category, verdict, model, core) that contradict themselves."""
    from concordat.operators.trace import coherent

    core, verdict = F.col("core"), F.coalesce("verdict", F.lit("none"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("model").isNotNull() & (verdict != "sat"), F.lit("ModelWithoutSat")),
            F.when(core.isNotNull() & (verdict != "unsat"), F.lit("CoreWithoutUnsat")),
            F.when(F.trim("model") == "", F.lit("EmptyModel")),
            F.when(F.size(core) == 0, F.lit("EmptyCore")),
            F.when(F.size(F.array_distinct(core)) < F.size(core), F.lit("Duplicate")),
            F.when(core != F.sort_array(core), F.lit("Unsorted")),
            F.when(~coherent(), F.lit("CategoryVerdict")),
        )
    )
    return results.select("query_id", F.explode(kinds).alias("kind")).distinct()
