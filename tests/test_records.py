"""Record queries on tables made for a defect of theirs."""

from oracle import compare

from concordat.plans import records, records_sql


def tables(spark, folder, orders):
    """A folder with orders of these (o_orderkey, o_custkey)."""
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_artifacts_whose_orders_share_an_assertion(spark, tmp_path):
    """Orders 1 and 21 are both named ctx.r1, one without rules, one with unsorted ones."""
    import duckdb

    for turn, keys in enumerate(([1, 21], [21, 1], [1, 56, 91, 21])):
        sf = tables(spark, tmp_path / str(turn), [(k, 7) for k in keys] + [(k, 8) for k in (2, 21)])
        con = duckdb.connect()
        con.execute(f"create view orders as select * from '{sf}/orders.parquet/*.parquet'")
        assert compare(con, records_sql.ORACLES["artifact_checks"], records.artifact_checks(spark, sf)) > 0


def test_documents_are_parsed_once_for_their_violations(spark, sf):
    plan = records.cnl_fact_violations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
