"""No join of the layered run broadcasts a table whose files are small and whose rows aren't."""

from functools import cache

import pytest
from pyspark.sql import functions as F

from concordat.operators import graph
from concordat.plans import layers


@pytest.fixture(scope="module")
def plans():
    """Plans of everything that is written, as Spark makes them before it runs. One run serves all."""
    seen, own = [], (graph.written, layers.layers, layers.graph)

    def written(df, what):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return own[0](df, what)

    graph.written, layers.layers, layers.graph = written, cache(own[1]), cache(own[2])
    yield seen
    graph.written, layers.layers, layers.graph = own


NAMES = ["trace_edges", "guideline_segments", "assertion_map", "bundle_breaks", "finding_lineage", "fresh_lineage", "group_scores", "guideline_findings", "guideline_exceptions", "run_hashes", "layer_components"]


@pytest.mark.parametrize("name", NAMES)
def test_layered_query_broadcasts_nothing(spark, sf, plans, name):
    plans.append(layers.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]


def test_fresh_lineage_broadcasts_nothing_as_run(spark, sf, plans):
    """Nor when sizes are known: Spark plans anew while a query runs."""
    df = layers.QUERIES["fresh_lineage"](spark, sf)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_bundle_breaks_plans_few_shuffles_at_once(spark, sf, plans):
    own = len(plans)
    plans.append(layers.QUERIES["bundle_breaks"](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert max(p.count("Exchange ") for p in plans[own:]) < 30


def test_kept_tables_join_by_key(spark):
    small = spark.range(10).select("id", F.lit("x").alias("v"))
    joined = graph.kept(small).where("id > 1").join(small.groupBy("id").count(), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 8
