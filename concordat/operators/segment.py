"""Typed segments of documents from ordered rules over their spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import text
from concordat.operators import sets
from concordat.operators.graph import kept

# The markers of recommendations, exceptions and definition tables.
RECOMMENDATION = ("推奨する", "推奨しない", "提案する", "提案しない", "考慮してもよい", "禁忌", "投与しないこと")
EXCEPTION = ("ただし", "を除く")
DEFINITION = "定義"


def spans_with_text(spans: DataFrame) -> DataFrame:
    """Spans with end offset, NFKC and search text, and hash; one Python pass for NFKC."""
    folded = spans.withColumn("nfkc_text", text.source_nfkc("raw_text"))
    return folded.withColumns(
        {"end": F.col("start") + text.byte_length("raw_text"), "search_text": F.translate(text.folded("nfkc_text"), "、。", ",."), "text_hash": text.sha256("raw_text")}
    )


def section_headings(nodes: DataFrame, spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted node the heading of its nearest section above that has text. Documents nest a few
    levels, so the walk up is a handful of passes over what still climbs, each written: in one plan
    every pass would hold all those before it once more."""
    own = spans.groupBy("document_id", "node_id").agg(F.min_by("search_text", "reading_order").alias("heading"))
    up = nodes.select("document_id", F.col("node_id").alias("at"), F.col("parent_id").alias("above"), (F.col("kind") == "section").alias("is_section"))
    up = up.join(own.withColumnRenamed("node_id", "at"), ["document_id", "at"], "left").withColumn("heading", F.when(F.col("is_section"), F.col("heading"))).drop("is_section")
    up, found = kept(up), wanted.select("document_id", "node_id", F.col("parent_id").alias("at"))
    out = None
    for _ in range(8):  # sections nest at most six deep, under a document, over a table or list
        step = kept(found.join(up, ["document_id", "at"], "left"))
        hit = step.where("heading is not null").select("document_id", "node_id", "heading")
        out = hit if out is None else out.unionByName(hit)
        found = step.where("heading is null and above is not null").select("document_id", "node_id", F.col("above").alias("at"))
        if found.isEmpty():
            break
    return out


def segments(nodes: DataFrame, spans: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, diagnostics). segments: document_id, segment_id, ord, kind, region_ids in byte
    order. A span that no rule places leaves a segmentation_boundary_error and takes no number."""
    spans = spans if "search_text" in spans.columns else spans_with_text(spans)
    region_of = regions.select("document_id", F.explode("span_ids").alias("span_id"), "region_id", "pos").groupBy("document_id", "span_id").agg(F.min_by("region_id", "pos").alias("region_id"))
    parents = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    s = (
        spans.select("document_id", "span_id", "node_id", "search_text", "reading_order")
        .join(nodes.select("document_id", "node_id", "kind", "parent_id", "attrs"), ["document_id", "node_id"])
        .join(parents, ["document_id", "parent_id"], "left")
        .join(region_of, ["document_id", "span_id"], "left")
        .withColumns({"row": F.col("attrs")["row"], "header": F.coalesce(F.col("attrs")["header"] == "true", F.lit(False))})
    )
    x = F.col("search_text")
    kind = (
        F.when(F.col("region_id").isNull(), None)
        .when(F.col("kind") == "section", F.when(x.rlike(r"\ACQ[0-9]"), "cq").otherwise("metadata"))
        .when(F.col("kind") == "caption", "metadata")
        .when(F.col("kind") == "paragraph", F.when(F.col("parent_kind") == "list", "evidence").when(text.contains_any(x, EXCEPTION), "exception").when(text.contains_any(x, RECOMMENDATION), "recommendation"))
    )
    single = s.where("kind <> 'cell'").withColumn("segment_kind", kind)
    cells = s.where("kind = 'cell' and row is not null and parent_id is not null and region_id is not null")
    headings = section_headings(nodes, spans, nodes.where("kind = 'table'")).withColumnRenamed("node_id", "parent_id")
    rows = (
        cells.groupBy("document_id", "parent_id", "row")
        .agg(F.min("reading_order").alias("reading_order"), F.bool_and("header").alias("all_header"), F.sort_array(F.collect_set("region_id")).alias("region_ids"))
        .join(headings, ["document_id", "parent_id"], "left")
        .withColumn("segment_kind", F.when(~F.col("all_header") & F.coalesce(F.col("heading").contains(DEFINITION), F.lit(False)), "definition").otherwise("table_row"))
    )
    columns = ["document_id", "reading_order", F.col("segment_kind").alias("kind"), "region_ids"]
    placed = single.where("segment_kind is not null").withColumn("region_ids", F.array("region_id")).select(*columns).unionByName(rows.select(*columns))
    numbered = sets.counted(placed, ["document_id"], ["reading_order"], "ord")
    detail = F.when(F.col("region_id").isNull(), F.concat(F.lit("no region grounds span "), F.col("span_id"))).when(F.col("kind") == "paragraph", F.concat(F.lit("unclassified paragraph: "), x)).otherwise(F.concat(F.lit("no segmentation rule for "), F.col("kind"), F.lit(" span "), F.col("span_id")))
    lost_cells = s.where("kind = 'cell' and (row is null or parent_id is null or region_id is null)").withColumn("detail", F.concat(F.lit("ungroupable cell "), F.col("node_id")))
    missed = single.where("segment_kind is null").withColumn("detail", detail).unionByName(lost_cells.withColumn("segment_kind", F.lit(None).cast("string")))
    diagnostics = missed.select("document_id", F.lit("segmentation_boundary_error").alias("code"), F.lit("residual").alias("outcome"), "detail", F.when(F.col("region_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("region_id")).alias("region_ids"))
    return numbered.select("document_id", F.concat(F.lit("seg."), F.col("ord")).alias("segment_id"), "ord", "kind", "region_ids"), diagnostics
