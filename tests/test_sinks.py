"""Sinks, exports and the term registry."""

import json

import pytest
from test_guidelines import LEXICON
from test_kb import DOC_A, DOC_B, merged

from concordat.functions import canon
from concordat.operators import kb
from concordat.plans import sinks
from concordat.sources import registry, terms


def test_land_and_contain(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "i int, s string, x array<int>")
    assert sorted(sinks.land(df, str(tmp_path), "t").collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.land(df, str(tmp_path), "t")
    for bad in ("../x", "/x", "a//b", "", "a/./b"):
        with pytest.raises(sinks.SinkError):
            sinks.inside("f", bad)


def test_fact_and_query_files(spark, tmp_path):
    base = kb.knowledge_base(spark, merged(DOC_A, DOC_B))
    sinks.write_facts(base, str(tmp_path))
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/facts").collect()]
    assert lines == sorted(set(lines)) and len(lines) == 18
    found = spark.createDataFrame([("g", "q.g.pair1.overlap", "a\n", "q.g.pair1.deontic", "b\n")], "group_id string, q1_id string, q1_body string, q2_id string, q2_body string")
    assert {tuple(r)[1:] for r in sinks.query_texts(found).collect()} == {("groups/g/smt/q.g.pair1.overlap.smt2", "a\n"), ("groups/g/smt/q.g.pair1.deontic.smt2", "b\n")}
    assert sinks.write_queries(found, str(tmp_path)) == 2
    assert (tmp_path / "groups/g/smt/q.g.pair1.overlap.smt2").read_bytes() == b"a\n" and (tmp_path / "groups/g/smt/q.g.pair1.deontic.smt2").read_bytes() == b"b\n"


def test_statement_schema():
    value = sinks.statement_schema(registry.lexicon(LEXICON))
    assert canon.read(value)["properties"]["action"]["properties"]["target"]["enum"] == ["drug.abx_a"]
    assert json.loads(value)["properties"]["population"]["items"]["enum"] == ["pop.adult", "pop.child"]


def test_terms(spark):
    table = terms.surfaces(spark)
    assert terms.integrity(table).count() == 0
    lines = [r["line"] for r in terms.entry_lines(terms.word_forms(table)).collect()]
    assert "noun_sg(patient, patient, human)." in lines and "pn_sg('Abx-A', 'Abx-A', neutr)." in lines and "tv_finsg(takes, take)." in lines
    bad = table.where("id <> 'cond.sepsis'").union(spark.createDataFrame([("concept", "cond.x", "pregnancy")], table.schema))
    assert sorted(tuple(r) for r in terms.integrity(bad).collect()) == [("ambiguous", "pregnancy"), ("uncovered", "cond.sepsis"), ("unknown", "cond.x")]
