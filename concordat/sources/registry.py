"""Registries and lexica: small YAML files, checked on the driver, handed on as typed values."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID = re.compile(r"\A[a-z][a-z0-9_.:-]*\Z")
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


class RegistryError(ValueError):
    """All that is wrong with a registry, one line each, in order."""

    def __init__(self, findings: list[str]):
        super().__init__("\n".join(findings))
        self.findings = findings


def fold_ja(text: str) -> str:
    """semantic_ja of one string (see functions.text)."""
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", text)).strip().translate(str.maketrans("、。", ",."))


def load_yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


# --- lexicon ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Interval:
    var: str
    ge: int | None = None
    gt: int | None = None
    le: int | None = None
    lt: int | None = None

    def coherent(self) -> bool:
        lower = [x for x in (self.ge, self.gt) if x is not None]
        upper = [x for x in (self.le, self.lt) if x is not None]
        if not lower + upper or len(lower) > 1 or len(upper) > 1:
            return False
        return not (lower and upper) or lower[0] < upper[0] or (lower == upper and self.gt is None and self.lt is None)


@dataclass(frozen=True)
class Modality:
    direction: str
    strength: str
    implies_action: str | None = None


@dataclass
class Lexicon:
    system: str
    concepts: dict[str, list[str]] = field(default_factory=dict)  # id -> surfaces, the first stands for it
    intervals: dict[str, Interval] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)  # surface -> kind
    modality: dict[str, Modality] = field(default_factory=dict)
    certainty: dict[str, str] = field(default_factory=dict)

    def candidates(self) -> dict[str, list[str]]:
        """Concepts of each surface, sorted."""
        out: dict[str, list[str]] = {}
        for ident, surfaces in self.concepts.items():
            for s in surfaces:
                out.setdefault(s, []).append(ident)
        return {s: sorted(ids) for s, ids in out.items()}


def _only(entry: dict, allowed: set[str], where: str, found: list[str]) -> None:
    found.extend(f"{where}: unknown field {k}" for k in sorted(set(entry) - allowed))


def lexicon(data: dict) -> Lexicon:
    """The lexicon of a parsed file. Surfaces are folded; repeated ids, empty or repeated surfaces,
    unknown fields and incoherent intervals are refused together."""
    found: list[str] = []
    lex = Lexicon(data.get("system", ""))
    _only(data, {"system", "concepts", "actions", "modality", "certainty"}, "lexicon", found)

    def surfaces(entry: dict, where: str) -> list[str]:
        got = entry.get("surface")
        folded = [fold_ja(s) for s in (got if isinstance(got, list) else [got] if got else [])]
        if not folded or not all(folded):
            found.append(f"{where}: empty surface")
        if len(set(folded)) < len(folded):
            found.append(f"{where}: repeated surface")
        return [s for s in folded if s]

    seen: set[str] = set()
    for e in data.get("concepts", []):
        _only(e, {"id", "surface", "interval"}, e["id"], found)
        if e["id"] in seen:
            found.append(f"{e['id']}: repeated id")
        if not ID.match(e["id"]):
            found.append(f"{e['id']}: malformed id")
        seen.add(e["id"])
        lex.concepts[e["id"]] = surfaces(e, e["id"])
        if "interval" in e:
            interval = Interval(**e["interval"])
            if not interval.coherent():
                found.append(f"{e['id']}: incoherent interval")
            lex.intervals[e["id"]] = interval
    for e in data.get("actions", []):
        if e["id"] in seen:
            found.append(f"{e['id']}: repeated id")
        seen.add(e["id"])
        for s in surfaces(e, e["id"]):
            if s in lex.actions:
                found.append(f"{e['id']}: repeated surface")
            lex.actions[s] = e["id"]
    for e in data.get("modality", []):
        for s in surfaces(e, "modality"):
            if s in lex.modality:
                found.append(f"modality {s}: repeated surface")
            lex.modality[s] = Modality(e["direction"], e["strength"], e.get("implies_action"))
    for e in data.get("certainty", []):
        for s in surfaces(e, "certainty"):
            if s in lex.certainty:
                found.append(f"certainty {s}: repeated surface")
            lex.certainty[s] = e["value"]
    if found:
        raise RegistryError(found)
    return lex


# --- registries ------------------------------------------------------------------------------


def check(corpora: list[dict], pipelines: list[dict], stages: list[dict], experiments: list[dict], reference: list[dict]) -> list[str]:
    """Everything wrong with a set of registries, in a fixed order; empty if all is well."""
    found: list[str] = []

    def repeated(kind: str, ids: list[str]) -> None:
        found.extend(f"duplicate {kind} {i}" for i, n in sorted(Counter(ids).items()) if n > 1)

    corpus, stage, pipe = ({e["id"] for e in x} for x in (corpora, stages, pipelines))
    repeated("corpus", [e["id"] for e in corpora])
    repeated("stage", [e["id"] for e in stages])
    repeated("pipeline", [e["id"] for e in pipelines])
    repeated("experiment", [e["id"] for e in experiments])
    repeated("reference group", [e["group_id"] for e in reference])
    found += [f"unsafe path {e['path']}" for e in corpora if not safe_path(e["path"])]
    by_stage = {e["id"]: e for e in stages}
    for p in pipelines:
        if not p["processing_stages"]:
            found.append(f"empty pipeline {p['id']}")
        made: set[str] = set()
        for s in p["processing_stages"]:
            if s not in stage:
                found.append(f"dangling stage {s} in {p['id']}")
                continue
            found += [f"chain break at {s} in {p['id']}: {k}" for k in by_stage[s]["input_artifact_kinds"] if k not in made]
            made |= set(by_stage[s]["output_artifact_kinds"])
    groups = {e["group_id"] for e in reference}
    for e in experiments:
        bound = e.get("pipelines") or ([e["pipeline"]] if e.get("pipeline") else [])
        if not bound or ("pipeline" in e and "pipelines" in e):
            found.append(f"pipeline binding of {e['id']}")
        repeated(f"pipeline in {e['id']}", bound)
        found += [f"dangling pipeline {p} in {e['id']}" for p in bound if p not in pipe]
        if "baseline_pipeline" in e and e["baseline_pipeline"] not in bound:
            found.append(f"baseline {e['baseline_pipeline']} not in {e['id']}")
        names = [g["group_id"] for g in e["test_source_groups"]]
        repeated(f"group in {e['id']}", names)
        for g in e["test_source_groups"]:
            if not g["test_sources"]:
                found.append(f"empty group {g['group_id']}")
            found += [f"dangling corpus {t} in {g['group_id']}" for t in g["test_sources"] if t not in corpus]
            if g["group_id"] not in groups:
                found.append(f"no reference for {g['group_id']}")
    used = {g["group_id"] for e in experiments for g in e["test_source_groups"]}
    found += [f"unknown reference group {g}" for g in sorted(groups - used)] if experiments else []
    return found


def safe_path(path: str) -> bool:
    """Relative, without . or .. components."""
    parts = path.split("/")
    return bool(path) and not path.startswith("/") and all(p not in ("", ".", "..") for p in parts)


def is_safe_path(path: Column | str) -> Column:
    """safe_path() of a column; null is unsafe."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce((c != "") & ~F.exists(F.split(c, "/"), lambda p: p.isin("", ".", "..")), F.lit(False))


def chain_breaks(stages: DataFrame) -> DataFrame:
    """(pipeline, ord, kind) of inputs that no earlier stage of the pipeline makes. stages:
    pipeline, ord, inputs, outputs; any number of pipelines, one anti-join."""
    made = stages.select("pipeline", F.col("ord").alias("made_at"), F.explode("outputs").alias("kind")).groupBy("pipeline", "kind").agg(F.min("made_at").alias("made_at"))
    need = stages.select("pipeline", "ord", F.explode("inputs").alias("kind"))
    return need.join(made, ["pipeline", "kind"], "left").where("made_at is null or made_at >= ord").select("pipeline", "ord", "kind")


def groups_table(spark: SparkSession, experiment: dict) -> DataFrame:
    rows = [(g["group_id"], t) for g in experiment["test_source_groups"] for t in g["test_sources"]]
    return spark.createDataFrame(rows, "group_id string, document_id string")
