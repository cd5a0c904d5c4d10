"""What changed between two snapshots of the network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.tags import WAY_TAGS, values
from stepfree.operators.network import KEY


def diff(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(change, u, v, k, tag, before, after): added and removed edges, and one row
    per tag whose value differs, lists joined by a semicolon. Without an old snapshot one row says so.
    Keys have to be unique on either side. One full outer join on the key."""
    if old is None:
        return new.sparkSession.createDataFrame([("initial", None, None, None, None, None, None)], "change string, u bigint, v bigint, k int, tag string, before string, after string")
    tags = lambda s: F.map_from_arrays(F.array(*[F.lit(t) for t in WAY_TAGS]), F.array(*[F.array_join(values(F.col("tags"), t), ";") for t in WAY_TAGS])).alias(s)
    a = old.select(*KEY, tags("before"), F.lit(True).alias("_old"))
    b = new.select(*KEY, tags("after"), F.lit(True).alias("_new"))
    both = a.join(b, KEY, "full")
    none = F.lit(None).cast("string")
    gone = both.where("_old is null or _new is null").select(F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"), *KEY, none.alias("tag"), none.alias("before"), none.alias("after"))
    common = both.where("_old and _new").withColumn("tag", F.explode(F.array(*[F.lit(t) for t in WAY_TAGS])))
    x, y = F.try_element_at("before", F.col("tag")), F.try_element_at("after", F.col("tag"))
    changed = common.where(~x.eqNullSafe(y)).select(F.lit("changed").alias("change"), *KEY, "tag", x.alias("before"), y.alias("after"))
    return gone.unionByName(changed)


def lines(changes: DataFrame) -> DataFrame:
    """(line): the change log as text."""
    edge = F.concat_ws("-", *[F.col(c).cast("string") for c in KEY])
    show = lambda c: F.coalesce(F.col(c), F.lit("none"))
    text = F.when(F.col("change") == "initial", F.lit("Initial snapshot"))
    text = text.when(F.col("change") == "changed", F.concat(edge, F.lit(": "), F.col("tag"), F.lit(" "), show("before"), F.lit(" -> "), show("after")))
    return changes.select(text.otherwise(F.concat_ws(" ", "change", edge)).alias("line"))
