"""Reports, manifests and replay of runs. Reports are small: one row per finding is collected."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import canon, text
from concordat.operators import metrics, sets

# Fixed value: wording of the claims a synthetic run may make.
WORDING = "synthetic test source measurement"


def assemble(tables: dict[str, DataFrame]) -> dict:
    """The report of a run as a plain value (see canon.emit): findings, documented no-conflict
    results, and the histogram of diagnostics."""
    rows = sorted(tables["findings"].collect(), key=lambda r: r["finding_id"])
    entry = lambda r: {"finding_id": r["finding_id"], "group_id": r["group_id"], "query_id": r["query_id"], "category": r["category"], "verdict": r["verdict"], "conflict_kind": r["conflict_kind"], "unsat_core": list(r["core"] or []), "participating_rules": list(r["rules"] or []), "quoted": list(r["quoted"] or []), "wording": WORDING}
    counts = metrics.histogram(tables["diagnostics"].withColumn("all", F.lit(1)), "all", "code").collect()
    return {
        "findings": [entry(r) for r in rows if r["part"] == "finding"],
        "no_conflict_results": [entry(r) for r in rows if r["part"] == "no_conflict"],
        "diagnostics": {x["code"]: x["n"] for r in counts for x in r["taxonomy"]},
    }


def violations(report: dict) -> list[str]:
    """What a reader would refuse."""
    out, seen = [], set()
    for part in ("findings", "no_conflict_results"):
        ids = [e["finding_id"] for e in report[part]]
        out += [f"DuplicateFindingId {i}" for i, n in sorted(Counter(ids).items()) if n > 1 or i in seen]
        seen |= set(ids)
        if ids != sorted(ids):
            out.append(f"SetOrder {part}")
        for e in report[part]:
            if (e["conflict_kind"] is not None) != (part == "findings"):
                out.append(f"ConflictKindPresence {e['finding_id']}")
            if part == "findings" and not e["unsat_core"]:
                out.append(f"CorePresence {e['finding_id']}")
            if e.get("verdict") not in (("unsat",) if part == "findings" else ("sat", "unsat")):
                out.append(f"VerdictRule {e['finding_id']}")
            if not e["participating_rules"] or not e["quoted"]:
                out.append(f"EmptyEvidence {e['finding_id']}")
            out += [f"QuotedTextLineBreak {e['finding_id']}" for q in e["quoted"] if "\n" in q or "\r" in q]
            out += [f"EmptyQuotedText {e['finding_id']}" for q in e["quoted"] if not q.strip()]
    out += [f"ZeroCount {k}" for k, n in report["diagnostics"].items() if n < 1]
    taxonomy, table = report.get("failure_taxonomy"), report.get("metrics")
    if taxonomy is not None:
        out += [] if taxonomy else ["EmptyTaxonomy"]
        out += [f"TaxonomyZeroCount {route} {k}" for route, counts in taxonomy.items() for k, n in counts.items() if n < 1]
    return out + (_table_violations(table) if table is not None else [])


def _table_violations(table: dict) -> list[str]:
    """What a reader would refuse of a metric table: baseline, routes and deltas, each of both a
    list of route and rows, where rows have metric, num and den."""
    routes, listed = [r["route"] for r in table["routes"]], [r["route"] for r in table["deltas"]]
    out = [f"DuplicateRoute {r}" for r in sorted(r for r, n in Counter(routes).items() if n > 1)]
    out += [] if table["baseline"] in routes else [f"BaselineMissing {table['baseline']}"]
    out += [] if [r for r in routes if r != table["baseline"]] == listed else ["DeltaTableMismatch"]
    for r in [*table["routes"], *table["deltas"]]:
        names = [x["metric"] for x in r["rows"]]
        out += [] if names == sorted(set(names)) else [f"MetricRowOrder {r['route']}"]
    return out


_WORDS = {
    "en": {"title": "Conflict report", "findings": "Findings", "none": "No findings.", "closed": "Documented no-conflict results", "rules": "Rules", "core": "Unsatisfiable core", "quotes": "Source text", "diagnostics": "Diagnostics"},
    "ja": {"title": "矛盾レポート", "findings": "検出結果", "none": "検出結果はありません。", "closed": "矛盾なしの記録", "rules": "規則", "core": "充足不能コア", "quotes": "原文", "diagnostics": "診断"},
}


def markdown(report: dict, language: str = "en") -> str:
    """A rendering that depends on the report's value alone."""
    w = _WORDS[language]
    lines = [f"# {w['title']}", "", f"## {w['findings']}", ""]
    lines += [w["none"], ""] if not report["findings"] else []
    for part, heading in (("findings", None), ("no_conflict_results", w["closed"])):
        if heading:
            lines += [f"## {heading}", ""]
        for e in report[part]:
            lines += [f"### {e['finding_id']}", "", f"- {e['category']}" + (f" ({e['conflict_kind']})" if e["conflict_kind"] else ""), f"- {w['rules']}: " + ", ".join(f"`{r}`" for r in e["participating_rules"])]
            if e["unsat_core"]:
                lines.append(f"- {w['core']}: " + ", ".join(f"`{c}`" for c in e["unsat_core"]))
            lines += [f"- {w['quotes']}:"] + [f"  - {q}" for q in e["quoted"]] + [""]
    lines += [f"## {w['diagnostics']}", ""] + [f"- {k}: {n}" for k, n in sorted(report["diagnostics"].items())]
    return "\n".join(lines) + "\n"


def content_hash(value) -> str:
    return "sha256:" + hashlib.sha256(canon.emit(value).encode()).hexdigest()


def artifact_hashes(tables: dict[str, DataFrame], names: tuple[str, ...] = ("segments", "bindings", "statements", "rules", "results", "findings")) -> DataFrame:
    """(artifact, hash): one hash per table over its rows, repeats included, in any order. Row hashes
    are cut in four and summed, so each task adds up its own and nothing is gathered."""
    out = None
    for name in names:
        df = tables[name]
        rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
        parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4)]
        one = rows.agg(text.sha256(F.concat_ws(":", F.count("*").cast("string"), *parts)).alias("hash")).select(F.lit(name).alias("artifact"), "hash")
        out = one if out is None else out.unionByName(one)
    return out


def manifest(run_id: str, experiment: str, hashes: DataFrame, seed: int, budget: dict[str, int]) -> dict:
    rows = {r["artifact"]: r["hash"] for r in hashes.collect()}
    if not rows:
        raise ValueError("a manifest without artifacts")
    return {"run_id": run_id, "experiment_id": experiment, "seed": seed, "budget": dict(budget), "artifact_hashes": rows, "hash_set": "sha256:" + hashlib.sha256("\n".join(sorted(set(rows.values()))).encode()).hexdigest()}


def replay(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """Artifacts whose hashes differ between a recorded run and its repetition, with their side;
    none means the replay matches."""
    return sets.difference(recorded, again)
