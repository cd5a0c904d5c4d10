"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions.polygon import shoelace_area, valid_points
from stepfree.functions.text import class_key, clean_split
from stepfree.llm import diverse, leak, packing, pii, splits, topn
from stepfree.operators.spatial import near_groups
from stepfree.session import cut, table

SUBSET_SHARE = 0.1
STREET_M = 15.0
TOP_DETECTIONS = 3


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return diverse.view_cells(table(spark, sf, "manifest"), "image_id", "latitude", "longitude", "compass_angle")


def p1_varied_subset(spark: SparkSession, sf: str) -> DataFrame:
    return diverse.round_robin(_cells(spark, sf), share=SUBSET_SHARE).select(F.col("id").alias("image_id"), "cell", "rank_pos")


def _street_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cut(near_groups(table(spark, sf, "manifest"), "image_id", "latitude", "longitude", STREET_M))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    recorded = table(spark, sf, "manifest").groupBy(F.col("image_id").alias("id")).agg(F.min(clean_split(F.col("split"))).alias("recorded"))
    return splits.torn_groups(_street_groups(spark, sf), recorded).select(F.col("id").alias("image_id"), "group_id")


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_by_group(_street_groups(spark, sf)).select(F.col("id").alias("image_id"), "group_id", "split")


def scored_detections(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "detections").where("confidence > 0 and not isnan(confidence)")
    points = valid_points(F.col("polygon_xy"))
    rows = rows.select(F.trim("image_id").alias("image_id"), class_key(F.col("class_name")).alias("class_key"), "det_id", points.alias("points"))
    rows = rows.where("image_id <> '' and class_key <> '' and size(points) > 0")
    return rows.select("image_id", "class_key", "det_id", shoelace_area(F.col("points")).alias("area"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    best = topn.top_n(cut(scored_detections(spark, sf)), ["image_id", "class_key"], "det_id", "area", TOP_DETECTIONS)
    return best.select("image_id", "class_key", "rank_pos", "det_id")


def p6_sequences(spark: SparkSession, sf: str) -> DataFrame:
    counts = cut(packing.token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    return packing.pack(counts).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leak.leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    found = leak.leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("words").cast("int").alias("most_words"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    spans = pii.tag_mentions(table(spark, sf, "documents"), "doc_id", "text")
    return spans.select("doc_id", "kind", "mention").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_varied_subset, p3_found, p3_splits, p5_found, p6_sequences, p7_found, p7_items, p8_found, p8_redacted,
    )
}
