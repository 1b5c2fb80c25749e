"""The commands, end to end over a registry folder."""

import json

import pytest
from test_guidelines import CONTROL, DOC_A, DOC_B, LEXICON

from concordat.plans import commands

yaml = pytest.importorskip("yaml")


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, body in (("a", DOC_A), ("b", DOC_B), ("c", CONTROL)):
        (root / f"{name}.html").write_text(body, encoding="utf-8")
    dump = lambda path, value: (root / path).write_text(yaml.safe_dump(value, allow_unicode=True), encoding="utf-8")
    (root / "registry").mkdir()
    dump("registry/corpora.yaml", [{"id": f"doc.{x}", "path": f"{x}.html"} for x in "abc"])
    dump("registry/candidates.yaml", {"pipelines": [{"id": "p", "processing_stages": ["s"]}], "processing_stages": [{"id": "s", "input_artifact_kinds": [], "output_artifact_kinds": ["graph"]}]})
    groups = [{"group_id": "group.x", "test_sources": ["doc.a", "doc.b"]}, {"group_id": "group.y", "test_sources": ["doc.a", "doc.c"]}]
    dump("registry/experiments.yaml", [{"id": "e", "pipeline": "p", "test_source_groups": groups, "seed": 42, "budget": {"ms": 1}, "expected_outcomes": "expected.yaml"}])
    dump("expected.yaml", [{"group_id": "group.x", "expected_outcome": "semantic_contradiction", "expected_unsat_core": ["a.doc.b.rule.0", "a.doc.a.rule.0"]}, {"group_id": "group.y", "expected_outcome": "semantic_no_conflict", "expected_no_conflict_result": True}])
    dump("lexicon.yaml", LEXICON)
    return root


def call(capsys, spark, *argv):
    code = commands.main([str(a) for a in argv], spark)
    out = capsys.readouterr().out.strip().split("\n")
    return code, json.loads(out[-1]), out[:-1]


def test_commands(project, spark, capsys):
    assert call(capsys, spark, "check", "--registry", project / "registry", "--base", project)[:2] == (0, {"command": "check", "outcome": "ok", "findings": []})
    args = ("run", "--registry", project / "registry", "--base", project, "--lexicon", project / "lexicon.yaml", "--experiment", "e", "--out", project / "out")
    code, result, _ = call(capsys, spark, *args)
    assert code == 0 and result["matched"] == {"group.x": True, "group.y": True} and result["findings"] == 1
    assert call(capsys, spark, *args)[1]["error"][0] == "run_exists"
    code, _, lines = call(capsys, spark, "trace", "--run", project / "out", "--finding", "finding.group.x.1")
    assert code == 0 and "span doc.a/s.2 <- source doc.a" in lines and sum(x.startswith("quoted: ") for x in lines) == 3
    assert call(capsys, spark, "trace", "--run", project / "out", "--finding", "nothing")[1]["error"][0] == "trace_incomplete"
    assert call(capsys, spark, "replay", project / "out")[:2] == (0, {"command": "replay", "outcome": "ok", "mismatches": []})
    (project / "b.html").write_text(DOC_B.replace("妊娠中の", ""), encoding="utf-8")
    code, result, _ = call(capsys, spark, "replay", project / "out")
    assert code == 1 and {m.split(" ")[0] for m in result["mismatches"]} >= {"rules", "bindings"}
    assert call(capsys, spark, "run", *args[1:-3], "none", "--out", project / "o2")[1]["error"] == ["registry_invalid", "no experiment none"]
