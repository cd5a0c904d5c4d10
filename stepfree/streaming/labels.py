"""Label events as a stream: the latest verdict per segment and attribute holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepfree.operators.network import latest_labels


def upsert_labels(events: DataFrame, store: str, checkpoint: str, lateness: str = "1 day", **options: str) -> StreamingQuery:
    """Fold a stream of (segment_id, attribute, verdict, note, labelled_at) into the
    Parquet store. Repeated deliveries inside the lateness are dropped; a batch is
    merged with the store by the same rule as batch labels and written under a
    version of its own, so a batch that is run again gives the same store."""
    once = events.withWatermark("labelled_at", lateness).dropDuplicatesWithinWatermark(["segment_id", "attribute", "labelled_at", "verdict"])

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("segment_id", "attribute", "verdict", "note", "labelled_at")
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{store}/version={number - 1}"))
        keyed = rows.withColumn("_seg", F.col("segment_id"))
        newest = keyed.groupBy("segment_id", "attribute").agg(F.max(F.struct("labelled_at", "verdict", "note")).alias("l"))
        newest.select("segment_id", "attribute", "l.verdict", "l.note", "l.labelled_at").write.mode("overwrite").parquet(f"{store}/version={number}")

    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).options(**options).start()


def current_labels(spark, store: str) -> DataFrame:  # noqa: ANN001
    """The store's latest version, brought to one direction per segment."""
    versions = spark.read.parquet(store)
    last = versions.agg(F.max("version")).first()[0]
    return latest_labels(versions.where(F.col("version") == last))
