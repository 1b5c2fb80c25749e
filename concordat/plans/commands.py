"""Commands over registries and finished runs: check, run, trace, replay.

    python -m concordat check  --registry DIR
    python -m concordat run    --registry DIR --base DIR --lexicon FILE --experiment ID --out DIR
    python -m concordat trace  --run DIR --finding ID
    python -m concordat replay RUN

A registry folder holds corpora.yaml, candidates.yaml, experiments.yaml; paths in them are relative
to --base. A run's folder must be new; it gets its tables, query and report files and a manifest.
Each command prints one JSON line with its outcome at the end; the exit code is 0 for ok.
"""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from concordat.functions import canon
from concordat.operators import trace, verdicts
from concordat.plans import guidelines, report, sinks
from concordat.sources import html, registry
from concordat.sources.registry import load_yaml

#: Tables of a run that later commands read.
LANDED = ("segments", "bindings", "statements", "rules", "results", "findings", "lineage", "edges", "diagnostics", "spans", "regions")


class CommandError(Exception):
    """A command that can't be carried out: (code, detail)."""


def load_registries(folder: str) -> dict:
    read = lambda name: load_yaml(Path(folder, name).read_text(encoding="utf-8"))
    candidates = read("candidates.yaml")
    return {"corpora": read("corpora.yaml"), "pipelines": candidates["pipelines"], "stages": candidates["processing_stages"], "experiments": read("experiments.yaml")}


def reference_of(experiment: dict, base: str) -> list[dict]:
    return load_yaml(Path(base, experiment["expected_outcomes"]).read_text(encoding="utf-8"))


def check(folder: str, base: str) -> list[str]:
    r = load_registries(folder)
    paths = sorted({e["expected_outcomes"] for e in r["experiments"]})
    reference = [g for p in paths for g in load_yaml(Path(base, p).read_text(encoding="utf-8"))]
    return registry.check(r["corpora"], r["pipelines"], r["stages"], r["experiments"], reference)


def _resolve(folder: str, experiment_id: str) -> tuple[dict, dict]:
    r = load_registries(folder)
    found = [e for e in r["experiments"] if e["id"] == experiment_id]
    if len(found) != 1:
        raise CommandError("registry_invalid", f"no experiment {experiment_id}")
    if "pipeline" not in found[0]:
        raise CommandError("registry_invalid", f"{experiment_id} isn't bound to the layered pipeline")
    return r, found[0]


def tables_of(spark: SparkSession, folder: str, base: str, lexicon: str, experiment_id: str) -> tuple[dict[str, DataFrame], dict, list[str]]:
    """Tables of a run, its experiment, and documents that can't be read (left out)."""
    r, experiment = _resolve(folder, experiment_id)
    path_of = {c["id"]: c["path"] for c in r["corpora"]}
    wanted = sorted({t for g in experiment["test_source_groups"] for t in g["test_sources"]})
    paths = {t: os.path.join(base, path_of[t]) for t in wanted if t in path_of and registry.safe_path(path_of[t])}
    lost = [t for t in wanted if t not in paths or not os.path.exists(paths[t])]
    docs = html.read_files(spark, {t: p for t, p in paths.items() if t not in lost})
    lex = registry.lexicon(load_yaml(Path(lexicon).read_text(encoding="utf-8")))
    return guidelines.run(docs, registry.groups_table(spark, experiment), lex), experiment, lost


def run(spark: SparkSession, folder: str, base: str, lexicon: str, experiment_id: str, out: str) -> dict:
    if os.path.exists(out):
        raise CommandError("run_exists", out)
    tables, experiment, lost = tables_of(spark, folder, base, lexicon, experiment_id)
    landed = {name: sinks.land(tables[name], out, f"tables/{name}") for name in LANDED}
    sinks.write_queries(tables["pairs"], out)
    value = report.assemble(landed)
    wrong = report.violations(value)
    hashes = report.artifact_hashes(landed)
    manifest = report.manifest(os.path.basename(out), experiment_id, hashes, experiment["seed"], experiment["budget"])
    manifest |= {"registry": folder, "base": base, "lexicon": lexicon}
    for name, body in (("report.json", canon.emit(value)), ("report_en.md", report.markdown(value)), ("report_ja.md", report.markdown(value, "ja")), ("manifest.json", canon.emit(manifest))):
        Path(sinks.inside(out, name)).write_text(body, encoding="utf-8")
    expected = [(g["group_id"], g["expected_outcome"], g.get("expected_unsat_core"), g.get("expected_no_conflict_result")) for g in reference_of(experiment, base)]
    reference = spark.createDataFrame(expected, "group_id string, expected_outcome string, expected_unsat_core array<string>, expected_no_conflict_result boolean")
    matched = {r["group_id"]: r["matched"] for r in verdicts.group_outcomes(landed["results"], reference).collect()}
    return {"outcome": "ok" if not wrong and not lost else "invalid", "findings": len(value["findings"]), "no_conflict_results": len(value["no_conflict_results"]), "matched": matched, "unreadable": lost, "violations": wrong}


def show_trace(spark: SparkSession, run_dir: str, finding: str) -> list[str]:
    """The chain from a finding down to source documents, then the quoted texts."""
    read = lambda name: spark.read.parquet(f"{run_dir}/tables/{name}")
    found = read("findings").where(f"finding_id = '{finding}'") if "'" not in finding else read("findings").limit(0)
    rows = found.collect()
    if len(rows) != 1:
        raise CommandError("trace_incomplete", f"no finding {finding}")
    chain = sorted(trace.chain(read("edges"), finding).collect(), key=lambda r: (r["up"], r["to_id"], r["from_id"]))
    if not any(r["from_kind"] == "source" for r in chain):
        raise CommandError("trace_incomplete", f"{finding} doesn't reach a source")
    return [f"{r['to_kind']} {r['to_id']} <- {r['from_kind']} {r['from_id']}" for r in chain] + [f"quoted: {q}" for q in rows[0]["quoted"]]


def replay(spark: SparkSession, run_dir: str) -> dict:
    manifest = canon.read(Path(run_dir, "manifest.json").read_text(encoding="utf-8"))
    recorded = spark.createDataFrame(sorted(manifest["artifact_hashes"].items()), "artifact string, hash string")
    tables, _, lost = tables_of(spark, manifest["registry"], manifest["base"], manifest["lexicon"], manifest["experiment_id"])
    rows = sorted((r["artifact"], r["side"]) for r in report.replay(recorded, report.artifact_hashes(tables)).collect())
    return {"outcome": "ok" if not rows and not lost else "invalid", "mismatches": [" ".join(r) for r in rows]}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="concordat")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check")
    c.add_argument("--registry", required=True)
    c.add_argument("--base", default=".")
    c = sub.add_parser("run")
    for name in ("registry", "lexicon", "experiment", "out"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--base", default=".")
    c = sub.add_parser("trace")
    c.add_argument("--run", required=True)
    c.add_argument("--finding", required=True)
    sub.add_parser("replay").add_argument("run")
    a = p.parse_args(argv)
    try:
        if a.command == "check":
            found = check(a.registry, a.base)
            result = {"outcome": "invalid" if found else "ok", "findings": found}
        else:
            if spark is None:
                from concordat.session import local_session

                spark = local_session()
            if a.command == "run":
                result = run(spark, a.registry, a.base, a.lexicon, a.experiment, a.out)
            elif a.command == "trace":
                lines = show_trace(spark, a.run, a.finding)
                print("\n".join(lines))
                result = {"outcome": "ok", "lines": len(lines)}
            else:
                result = replay(spark, a.run)
    except (CommandError, registry.RegistryError, OSError) as e:
        result = {"outcome": "invalid", "error": [str(x) for x in e.args]}
    print(json.dumps({"command": a.command, **result}, ensure_ascii=False))
    return 0 if result["outcome"] == "ok" else 1
