"""Solver texts of query pairs, rendered from rules as expressions. No solver runs: verdicts are
decided symbolically (see verdicts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbol(c: Column | str) -> Column:
    return F.concat(F.lit("|"), _col(c), F.lit("|"))


def numeral(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n < 0, F.concat(F.lit("(- "), F.abs(n).cast("string"), F.lit(")"))).otherwise(n.cast("string"))


def _joined(op: str, terms: Column, empty: str) -> Column:
    """Terms under an operator; one alone stands bare, none is `empty`. The terms are bound to a
    variable, or every use would compute them anew, at every level of nesting."""
    text = lambda t: F.when(F.size(t) == 0, F.lit(empty)).when(F.size(t) == 1, F.try_element_at(t, F.lit(1))).otherwise(F.concat(F.lit(f"({op} "), F.array_join(t, " "), F.lit(")")))
    return F.transform(F.array(terms), text)[0]


def conjunction(terms: Column | str) -> Column:
    return _joined("and", _col(terms), "true")


def disjunction(terms: Column | str) -> Column:
    return _joined("or", _col(terms), "true")


def bound_terms(var: Column, ge: Column, gt: Column, le: Column, lt: Column) -> Column:
    one = lambda op, n: F.when(n.isNotNull(), F.concat(F.lit(f"({op} "), symbol(var), F.lit(" "), numeral(n), F.lit(")")))
    return F.array_compact(F.array(one(">=", ge), one(">", gt), one("<=", le), one("<", lt)))


def atom_term(atom: Column) -> Column:
    """Of a struct (tag, concept, var, ge, gt, le, lt)."""
    return (
        F.when(atom["tag"] == "concept", symbol(atom["concept"]))
        .when(atom["tag"] == "concept_negated", F.concat(F.lit("(not "), symbol(atom["concept"]), F.lit(")")))
        .otherwise(conjunction(bound_terms(atom["var"], atom["ge"], atom["gt"], atom["le"], atom["lt"])))
    )


def guard(context: Column | str) -> Column:
    """Of an array (any) of arrays (all) of atoms."""
    return disjunction(F.transform(_col(context), lambda conj: conjunction(F.transform(conj, atom_term))))


def declarations(contexts: list[Column]) -> Column:
    """Declared symbols of some contexts, by name: concepts are Bool, quantities Real."""
    atoms = F.flatten(F.concat(*contexts))
    named = F.transform(atoms, lambda a: F.struct(F.coalesce(a["concept"], a["var"]).alias("s"), F.when(a["concept"].isNotNull(), "Bool").otherwise("Real").alias("t")))
    return F.transform(F.sort_array(F.array_distinct(named)), lambda d: F.concat(F.lit("(declare-const "), symbol(d["s"]), F.lit(" "), d["t"], F.lit(")")))


def named_assertion(term: Column, name: Column) -> Column:
    return F.concat(F.lit("(assert (! "), term, F.lit(" :named "), symbol(name), F.lit("))"))


def _lines(*parts: Column) -> Column:
    return F.concat(F.array_join(F.flatten(F.array(*parts)), "\n"), F.lit("\n"))


def overlap_body(a_id: Column | str, a_context: Column | str, b_id: Column | str, b_context: Column | str) -> Column:
    """May both contexts hold at once?"""
    ctx = lambda i, c: named_assertion(guard(c), F.concat(F.lit("ctx."), _col(i)))
    head = F.array(F.lit("(set-logic QF_LRA)"), F.lit("(set-option :print-success false)"), F.lit("(set-option :produce-models true)"))
    return _lines(head, declarations([_col(a_context), _col(b_context)]), F.array(ctx(a_id, a_context), ctx(b_id, b_context), F.lit("(check-sat)"), F.lit("(get-model)")))


def deontic_body(a_id: Column | str, a_positive: Column | str, b_id: Column | str, b_positive: Column | str, action_key: Column | str) -> Column:
    """May both directions on one action hold at once?"""
    p = symbol(F.concat(F.lit("pos:"), _col(action_key)))
    side = lambda i, pos: named_assertion(F.when(_col(pos), p).otherwise(F.concat(F.lit("(not "), p, F.lit(")"))), F.concat(F.lit("a."), _col(i)))
    head = F.array(F.lit("(set-logic QF_UF)"), F.lit("(set-option :print-success false)"), F.lit("(set-option :produce-unsat-cores true)"))
    return _lines(head, F.array(F.concat(F.lit("(declare-const "), p, F.lit(" Bool)")), side(a_id, a_positive), side(b_id, b_positive), F.lit("(check-sat)"), F.lit("(get-unsat-core)")))


# --- solver output ---------------------------------------------------------------------------


def verdict_token(stdout: Column | str) -> Column:
    """sat, unsat or unknown if the first line is exactly that, else null."""
    first = F.regexp_extract(_col(stdout), r"\A(sat|unsat|unknown)(?:\r?\n|\z)", 1)
    return F.when(first != "", first)


def solver_version(text: Column | str) -> Column:
    v = F.regexp_extract(_col(text), r"\bversion\s+(\S+)", 1)
    return F.when(v != "", v)


def unsat_core(stdout: Column | str) -> Column:
    """Sorted names of a flat core listing, or null without one."""
    flat = F.regexp_extract(_col(stdout), r"\Aunsat\r?\n\s*\(([^()]*)\)", 1)
    names = F.regexp_extract_all(flat, F.lit(r"\|([^|]*)\||([^\s|]+)"), F.lit(0))
    return F.when(flat != "", F.sort_array(F.array_distinct(F.transform(names, lambda n: F.replace(n, F.lit("|"), F.lit(""))))))


def surface_markers(body: Column | str) -> Column:
    """A text that at least looks like a query."""
    return _col(body).startswith("(set-logic") & _col(body).contains("(check-sat)")
