"""From segments to bindings, statements, exceptions and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions import canon, text
from concordat.operators import sets
from concordat.sources.registry import Lexicon


def _none() -> Column:
    return F.array().cast("array<string>")



def mapped(surfaces: Column, table: dict[str, str | None]) -> Column:
    """Distinct values of surfaces in order of first appearance; surfaces without one drop out."""
    pairs = [x for k, v in table.items() if v is not None for x in (F.lit(k), F.lit(v))]
    if not pairs:
        return _none()
    m = F.create_map(*pairs)
    return F.array_distinct(F.array_compact(F.transform(surfaces, lambda s: F.try_element_at(m, s))))


def segment_spans(segments: DataFrame, regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of each segment through its regions: each once, with all regions that name it."""
    named = segments.select("document_id", "segment_id", "ord", "kind", F.explode("region_ids").alias("region_id")).join(regions.select("document_id", "region_id", F.explode("span_ids").alias("span_id")), ["document_id", "region_id"])
    per = named.groupBy("document_id", "segment_id", "ord", "kind", "span_id").agg(F.sort_array(F.collect_set("region_id")).alias("region_ids"))
    return per.join(spans.select("document_id", "span_id", "search_text", "reading_order"), ["document_id", "span_id"])


def bindings(seg_spans: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One binding per segment and set of candidate concepts, numbered through the document in
    order of first match: code (lowest candidate), status, alternatives, regions."""
    spark = seg_spans.sparkSession
    candidates = lexicon.candidates()
    rows = [(s, ids, any(lexicon.concepts[i][0] == s for i in ids)) for s, ids in sorted(candidates.items())]
    table = spark.createDataFrame(rows, "surface string, candidates array<string>, is_first boolean")
    found = seg_spans.select("document_id", "segment_id", "ord", "kind", "reading_order", "region_ids", F.posexplode(text.scan("search_text", list(candidates))).alias("pos", "surface"))
    per = (
        found.join(table, "surface")
        .groupBy("document_id", "segment_id", "ord", "kind", "candidates")
        .agg(F.min(F.struct("reading_order", "pos", "surface", "is_first")).alias("first"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("region_ids")))).alias("region_ids"))
    )
    one = F.size("candidates") == 1
    per = per.withColumns(
        {
            "code": F.col("candidates")[0],
            "status": F.when(one & F.col("first.is_first"), "exact").when(one, "synonym").otherwise("ambiguous"),
            "alternatives": F.when(one, _none()).otherwise(F.col("candidates")),
            "place": F.struct("first.reading_order", "first.pos"),
            "surface": F.col("first.surface"),
        }
    )
    numbered = sets.counted(per, ["document_id"], ["ord", "place"], "k")
    return numbered.select("document_id", F.concat(F.lit("bind."), F.col("k")).alias("binding_id"), "segment_id", "ord", "kind", F.lit(lexicon.system).alias("system"), "code", "status", "alternatives", "region_ids", "surface")


def slots(segments: DataFrame, seg_spans: DataFrame, bound: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Readings of each recommendation: modalities, kinds, targets, populations, conditions, certainties."""
    surfaces = lambda table: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", text.scan("search_text", list(table)).alias("found")))), lambda x: x["found"])) if table else _none()
    words = seg_spans.where("kind = 'recommendation'").groupBy("document_id", "segment_id").agg(surfaces(lexicon.modality).alias("modal"), surfaces(lexicon.actions).alias("verbs"), surfaces(lexicon.certainty).alias("certain"))
    codes = bound.where("kind = 'recommendation' and status in ('exact', 'synonym')").groupBy("document_id", "segment_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    base = segments.where("kind = 'recommendation'").join(words, ["document_id", "segment_id"], "left").join(codes, ["document_id", "segment_id"], "left")
    c = F.coalesce("codes", _none())
    modal = F.coalesce("modal", _none())
    kinds = mapped(F.coalesce("verbs", _none()), lexicon.actions)
    implied = mapped(modal, {s: m.implies_action for s, m in lexicon.modality.items()})
    return base.select(
        "document_id", "segment_id", "ord", "region_ids",
        mapped(modal, {s: f"{m.direction} {m.strength}" for s, m in lexicon.modality.items()}).alias("modality"),
        F.when(F.size(kinds) > 0, kinds).otherwise(implied).alias("kinds"),
        F.filter(c, lambda x: x.startswith("drug.")).alias("targets"),
        F.filter(c, lambda x: x.startswith("pop.")).alias("population"),
        F.filter(c, lambda x: ~x.startswith("drug.") & ~x.startswith("pop.")).alias("condition"),
        mapped(F.coalesce("certain", _none()), lexicon.certainty).alias("certainty"),
    )


def statements(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, diagnostics). A segment makes a statement if modality, kind and target each have
    one reading; every slot that hasn't is reported, a doubtful certainty without withholding."""
    problems = F.array_compact(
        F.array(
            *[
                F.when(F.size(slot) == 0, F.struct(F.lit(none).alias("code"), F.lit(out).alias("outcome"), F.lit(slot).alias("detail"))).when(
                    F.size(slot) > 1, F.struct(F.lit("terminology_ambiguous").alias("code"), F.lit("ambiguity").alias("outcome"), F.concat_ws(" ", F.lit(slot), F.array_join(slot, ",")).alias("detail"))
                )
                for slot, none, out in (("modality", "semantic_slot_missing", "residual"), ("kinds", "semantic_slot_missing", "residual"), ("targets", "terminology_unmapped", "residual"))
            ],
            F.when(F.size("certainty") > 1, F.struct(F.lit("terminology_ambiguous").alias("code"), F.lit("ambiguity").alias("outcome"), F.concat_ws(" ", F.lit("certainty"), F.array_join("certainty", ",")).alias("detail"))),
        )
    )
    diagnostics = read.select("document_id", F.explode(problems).alias("p"), "region_ids").select("document_id", "p.code", "p.outcome", "p.detail", "region_ids")
    kept = sets.counted(read.where("size(modality) = 1 and size(kinds) = 1 and size(targets) = 1"), ["document_id"], ["ord"], "k")
    parts = F.split(F.col("modality")[0], " ")
    out = kept.select(
        "document_id", F.concat(F.lit("stmt."), F.col("k")).alias("statement_id"), "k", "ord", "segment_id", "region_ids", "population", "condition",
        F.col("kinds")[0].alias("action_kind"), F.col("targets")[0].alias("action_target"), F.concat_ws(":", F.col("kinds")[0], F.col("targets")[0]).alias("action_key"),
        parts[0].alias("direction"), parts[1].alias("strength"), F.when(F.size("certainty") == 1, F.col("certainty")[0]).alias("certainty"),
    )
    return out, diagnostics


def attached_exceptions(segments: DataFrame, stmts: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exceptions, diagnostics): each exception segment goes to the last statement kept before it
    in its document; one without a statement or a usable concept is reported."""
    codes = bound.where("kind = 'exception' and status in ('exact', 'synonym')").groupBy("document_id", "segment_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    exc = segments.where("kind = 'exception'").join(codes, ["document_id", "segment_id"], "left")
    rows = exc.select("document_id", "ord", F.lit(None).cast("string").alias("statement_id"), "segment_id", "region_ids", F.coalesce("codes", _none()).alias("codes"), F.lit(True).alias("is_exception")).unionByName(
        stmts.select("document_id", "ord", "statement_id", "segment_id", "region_ids", _none().alias("codes"), F.lit(False).alias("is_exception"))
    )
    w = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    got = rows.withColumn("owner", F.last("statement_id", ignorenulls=True).over(w)).where("is_exception")
    why = F.when(F.col("owner").isNull(), "exception without statement").when(F.size("codes") == 0, "exception without concept")
    lost = got.where(why.isNotNull()).select("document_id", F.lit("semantic_slot_missing").alias("code"), F.lit("residual").alias("outcome"), why.alias("detail"), "region_ids")
    kept = sets.counted(got.where(why.isNull()), ["document_id"], ["ord"], "k")
    return kept.select("document_id", F.concat(F.lit("exc."), F.col("k")).alias("exception_id"), "k", F.col("owner").alias("statement_id"), "codes", "region_ids"), lost


ATOM = "struct<tag:string,concept:string,var:string,ge:bigint,gt:bigint,le:bigint,lt:bigint>"


def concept_atom(code: Column, negated: bool = False) -> Column:
    n = F.lit(None).cast("bigint")
    return F.struct(F.lit("concept_negated" if negated else "concept").alias("tag"), code.alias("concept"), F.lit(None).cast("string").alias("var"), n.alias("ge"), n.alias("gt"), n.alias("le"), n.alias("lt"))


def lowered(code: Column, lexicon: Lexicon) -> Column:
    """The interval that a concept stands for, or the concept itself."""
    out = concept_atom(code)
    for ident, i in sorted(lexicon.intervals.items()):
        ends = [F.lit(x).cast("bigint").alias(n) for n, x in (("ge", i.ge), ("gt", i.gt), ("le", i.le), ("lt", i.lt))]
        out = F.when(code == ident, F.struct(F.lit("interval").alias("tag"), F.lit(None).cast("string").alias("concept"), F.lit(i.var).alias("var"), *ends)).otherwise(out)
    return out


def atom_json(a: Column) -> Column:
    interval = canon.object_of({"var": canon.string(a["var"]), **{k: canon.integer(a[k]) for k in ("ge", "gt", "le", "lt")}})
    value = F.when(a["tag"] == "interval", interval).otherwise(canon.string(a["concept"]))
    return F.concat(F.lit('{"tag":"'), a["tag"], F.lit('","value":'), value, F.lit("}"))


def rules(stmts: DataFrame, exc: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rule k of statement k: one conjunction of its atoms, exceptions negated (and never lowered),
    in canonical order, each once."""
    own = exc.groupBy("document_id", "statement_id").agg(F.sort_array(F.collect_list("exception_id")).alias("exception_refs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("barred"), F.flatten(F.collect_list("region_ids")).alias("more"))
    s = stmts.join(own, ["document_id", "statement_id"], "left")
    atoms = F.concat(F.transform(F.concat("population", "condition"), lambda x: lowered(x, lexicon)), F.transform(F.coalesce("barred", _none()), lambda x: concept_atom(x, True)))
    ordered = F.transform(F.sort_array(F.transform(F.array_distinct(atoms), lambda a: F.struct(atom_json(a).alias("j"), a.alias("a")))), lambda x: x["a"])
    return s.select(
        "document_id", F.concat("document_id", F.lit(".rule."), F.col("k")).alias("rule_id"), "k", "statement_id", "segment_id", F.array(ordered).alias("context"), "direction", "strength", "certainty",
        "action_kind", "action_target", "action_key", F.sort_array(F.array_distinct(F.concat("region_ids", F.coalesce("more", _none())))).alias("source_region_ids"), F.coalesce("exception_refs", _none()).alias("exception_refs"),
    )


def rule_json(prefix: str = "") -> Column:
    """The canonical payload of a rule row."""
    c = lambda n: F.col(prefix + n)
    strings = lambda xs: canon.array_of(F.transform(xs, canon.string))
    context = canon.object_of({"any": canon.array_of(F.transform(c("context"), lambda conj: F.concat(F.lit('{"all":'), canon.array_of(F.transform(conj, atom_json)), F.lit("}"))))})
    action = canon.object_of({"key": canon.string(c("action_key")), "kind": canon.string(c("action_kind")), "target": canon.string(c("action_target"))})
    return canon.object_of({"action": action, "certainty": canon.string(c("certainty")), "context": context, "direction": canon.string(c("direction")), "exception_refs": strings(c("exception_refs")), "rule_id": canon.string(c("rule_id")), "source_region_ids": strings(c("source_region_ids")), "strength": canon.string(c("strength"))})
