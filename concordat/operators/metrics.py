"""Route metrics as exact fractions, their deltas, and agreement between samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import rational


def unpivot(df: DataFrame, key: str, metrics: dict[str, Column]) -> DataFrame:
    """(key, metric, num, den), one row per metric; a null fraction is not applicable."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("v")) for name, value in sorted(metrics.items())]))
    return df.select(key, rows.alias("m")).select(key, "m.metric", F.col("m.v.num").alias("num"), F.col("m.v.den").alias("den"))


def verdict_fingerprint(plan: DataFrame, results: DataFrame, key: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """(key..., print) of every group with a plan or a result: a line for each planned pair and for
    each result, both in order. plan: key, n, q1_id, q2_id; results: key, seq, query_id, category,
    verdict, core. Neither models nor solvers count."""
    line = lambda place, at, *parts: F.struct(F.lit(place).alias("place"), F.col(at).cast("long").alias("at"), F.concat_ws(" ", *parts).alias("line"))
    absent = lambda c: F.coalesce(c, F.lit("-"))
    core = F.when(F.col("core").isNotNull(), F.array_join("core", ","))
    lines = plan.select(*key, line(0, "n", F.lit("pair"), F.col("q1_id"), F.col("q2_id")).alias("x")).unionByName(
        results.select(*key, line(1, "seq", F.lit("result"), F.col("query_id"), F.col("category"), absent(F.col("verdict")), absent(core)).alias("x"))
    )
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("print"))


# Expected outcomes that a reference may name.
OUTCOMES = ("semantic_contradiction", "semantic_no_conflict")


def route_metrics(fills: DataFrame, results: DataFrame, samples: DataFrame, reference: DataFrame, routes: DataFrame, draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics). rows: the seven metrics of each route as (route, metric, num, den); den 0
    is not applicable. A reference with an unknown outcome drops the accuracy of every route, for
    which diagnostics has (route, metric, detail).

    fills: route, recorded_calls, schema_violations, repairs, accepted; results: route and the
    columns of verdicts.results; samples: route, group_id, sample, print, with print as from
    verdict_fingerprint and a row per group that a draw produced, whose print may be empty;
    reference: see verdicts.group_outcomes; routes: route; draws: route, k, the number of draws."""
    from concordat.operators.verdicts import matched

    zero = lambda *names: [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names]
    given = fills.groupBy("route").agg(F.sum("recorded_calls").alias("calls"), F.sum("schema_violations").alias("violations"), F.sum("repairs").alias("repairs"), F.count_if("accepted").alias("accepted"), F.count("*").alias("fills"))
    ran = results.groupBy("route").agg(F.count("*").alias("executed"), F.count_if(F.col("category") != "target_syntax_failure").alias("parsed"))
    hits = matched(results, routes.crossJoin(reference), ("route", "group_id")).groupBy("route").agg(F.count_if("matched").alias("hits"), F.count("*").alias("expected"))
    same = samples.groupBy("route", "group_id", "print").count().groupBy("route", "group_id").agg(F.sum(F.expr("count * (count - 1) div 2")).alias("same"), F.sum("count").alias("present"))
    agreed = same.join(draws, "route").groupBy("route").agg(F.sum(F.col("same") + F.expr("(k - present) * (k - present - 1) div 2")).alias("agreeing"), F.sum(F.expr("k * (k - 1) div 2")).alias("pairs"))
    names = ("calls", "violations", "repairs", "accepted", "fills", "executed", "parsed", "hits", "expected", "agreeing", "pairs")
    per = routes.select("route").distinct()
    for df in (given, ran, hits, agreed):
        per = per.join(df, "route", "left")
    per = per.select("route", *zero(*names))
    broken = per.where(F.col("violations") > F.col("calls")).limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['route']}: more schema violations than recorded calls")
    rows = unpivot(
        per,
        "route",
        {
            "acceptance_rate": rational.ratio("accepted", "fills"),
            "conflict_verdict_accuracy": rational.ratio("hits", "expected"),
            "k_sample_convergence": rational.ratio("agreeing", "pairs"),
            "recorded_call_count": rational.count("calls"),
            "repair_count": rational.count("repairs"),
            "schema_valid_rate": rational.ratio(F.col("calls") - F.col("violations"), "calls"),
            "target_syntactic_validity": rational.ratio("parsed", "executed"),
        },
    ).na.fill(0, ["num", "den"])
    odd = reference.where(~F.coalesce(F.col("expected_outcome").isin(*OUTCOMES), F.lit(False)))
    named = odd.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "group_id", "expected_outcome"))), ", ").alias("d")).where("d <> ''")
    lost = routes.crossJoin(named).select("route", F.lit("conflict_verdict_accuracy").alias("metric"), F.concat(F.lit("unrecognized expected_outcome(s): "), "d").alias("detail"))
    return rows.join(lost, ["route", "metric"], "left_anti").select("route", "metric", "num", "den"), lost


def deltas(rows: DataFrame, key: str, baseline: str) -> DataFrame:
    """Per route and metric of either side its value less the baseline's; null where one lacks it
    or isn't applicable."""
    routes = rows.select(key).where(F.col(key) != baseline).distinct()
    base = rows.where(F.col(key) == baseline).select("metric", F.struct("num", "den").alias("b"))
    mine = rows.where(F.col(key) != baseline).select(key, "metric", F.struct("num", "den").alias("a"))
    both = routes.crossJoin(base).join(mine, [key, "metric"], "full")
    d = rational.subtract("a", "b")
    return both.select(key, "metric", d["num"].alias("num"), d["den"].alias("den"))


def agreeing_pairs(prints: DataFrame, groups: DataFrame, group: str, samples: int) -> DataFrame:
    """Per group how many of its C(k, 2) unordered sample pairs carry one fingerprint, where
    having none is a state too. prints: (group, sample, print), one row per sample that has one.
    Pairs are counted from the sizes of equal-print classes, never written out."""
    classes = prints.groupBy(group, "print").count()
    per = classes.groupBy(group).agg(F.sum(F.expr("count * (count - 1) div 2")).alias("same"), F.sum("count").alias("present"))
    absent = F.lit(samples) - F.coalesce("present", F.lit(0))
    return groups.join(per, group, "left").select(
        group,
        (F.coalesce("same", F.lit(0)) + (absent * (absent - 1) / 2).cast("long")).alias("agreeing"),
        F.lit(samples * (samples - 1) // 2).cast("long").alias("pairs"),
    )


def convergence(pairs: DataFrame) -> DataFrame:
    """One row: agreeing pairs of all groups over all pairs of all groups."""
    total = pairs.agg(F.sum("agreeing").alias("a"), F.sum("pairs").alias("p"))
    f = rational.ratio("a", "p")
    return total.select(f["num"].alias("num"), f["den"].alias("den"))


def severity(rank_of: dict[str, int], column: Column | str) -> Column:
    """Rank of an outcome; fold with max and name the result with outcome_of."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("int")
    for name, rank in rank_of.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def outcome_of(rank: Column | str, names: tuple[str, ...]) -> Column:
    c = F.col(rank) if isinstance(rank, str) else rank
    return F.element_at(F.array(*map(F.lit, names)), c + 1)


def histogram(df: DataFrame, key: str, code: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, taxonomy): sorted (code, count) pairs; keys without any keep an empty array."""
    counted = df.groupBy(key, code).count().groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(code).alias("code"), F.col("count").alias("n")))).alias("taxonomy"))
    if keys is None:
        return counted
    kind = counted.schema["taxonomy"].dataType
    return keys.join(counted, key, "left").select(key, F.coalesce("taxonomy", F.array().cast(kind)).alias("taxonomy"))
