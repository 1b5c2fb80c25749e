"""Schemas (as DDL) and closed vocabularies of the clinical model."""

from __future__ import annotations

# The closed vocabularies of rules and knowledge bases.
DIRECTIONS = ("for", "require", "permit", "against", "avoid", "contraindicate")
POSITIVE = ("for", "require", "permit")
STRENGTHS = ("strong", "weak")
CERTAINTIES = ("high", "moderate", "low", "very_low")
CONCEPTS = ("cond.sepsis", "cond.renal_severe", "cond.pregnancy")
QUANTITIES = ("q.age_years",)
POPULATIONS = ("pop.patient",)
ACTION_KINDS = ("act.administer",)
ACTION_TARGETS = ("drug.abx_a",)
OPENNESS = ("open", "closed")
SIDES = ("lower", "upper")
OUTCOMES = ("ok", "residual", "ambiguity", "unsupported", "incoherence", "invalid")
ID_KINDS = ("rule", "stmt", "bind", "exc")

# The nine fact relations of a knowledge base.
_ATOM = "tag string, concept string, quantity string, bound decimal(38,18), openness string, side string"
KB = {
    "rule": "rule_id string, stmt_id string",
    "direction": "rule_id string, direction string",
    "strength": "rule_id string, strength string",
    "certainty": "rule_id string, certainty string",
    "population": "stmt_id string, population string",
    "action": "stmt_id string, action_key string",
    "condition": f"bind_id string, stmt_id string, {_ATOM}",
    "exception": f"exc_id string, stmt_id string, {_ATOM}",
    "source": "id string, doc_id string, regions array<int>, basis string",
}

# Documents as graphs, and what is derived from them.
NODES = "document_id string, node_id string, pos int, kind string, parent_id string, attrs map<string,string>"
SPANS = "document_id string, span_id string, node_id string, raw_text string, start long, reading_order long"
REGIONS = "document_id string, region_id string, pos int, node_ids array<string>, span_ids array<string>"
DIAGNOSTICS = "document_id string, code string, outcome string, detail string, region_ids array<string>"
LEXICON = "category string, id string, surface string, direction string, strength string, implies_action string, value string"
INTERVALS = "concept string, var string, ge long, gt long, le long, lt long"
