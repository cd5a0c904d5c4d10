"""A varied subset: grid cells over several attributes, taken round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.geo import usable
from stepfree.operators.ranking import hash_order, spread_rank
from stepfree.session import cut

#: Metres per degree of latitude.
DEGREE_M = 111_195.0


def view_cells(df: DataFrame, key: str, lat: str, lon: str, heading: str, cell_m: float = 50.0, sectors: int = 8) -> DataFrame:
    """(id, cell): one row per key with a usable position; the cell is a square of
    about `cell_m` metres and a heading sector. Headings outside 0..360 are turned
    into it; null and NaN headings have the sector -1. Of copies of a key the one
    with the least (lat, lon, heading) counts, null headings last."""
    rows = df.select(
        F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
        F.nanvl(F.col(heading).cast("double"), F.lit(None).cast("double")).alias("heading"),
    )
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon")))
    best = F.min(F.struct("lat", "lon", F.coalesce("heading", F.lit(1e9)).alias("heading"))).alias("p")
    one = rows.groupBy("id").agg(best).select("id", "p.lat", "p.lon", F.expr("case when p.heading < 1e9 then p.heading end").alias("heading"))
    step = cell_m / DEGREE_M
    row = F.floor(F.col("lat") / F.lit(step))
    # the width of a column of cells follows the latitude of the row's lower edge
    col = F.floor(F.col("lon") * F.cos(F.radians(row * F.lit(step))) / F.lit(step))
    # the same form in every engine: x - 360 * floor(x / 360) rather than a signed modulus
    turned = F.col("heading") - 360.0 * F.floor(F.col("heading") / 360.0)
    sector = F.when(F.col("heading").isNull(), F.lit(-1)).otherwise(F.least(F.floor(turned / F.lit(360.0 / sectors)), F.lit(sectors - 1)))
    return one.select("id", F.concat_ws("|", row.cast("string"), col.cast("string"), sector.cast("string")).alias("cell"))


def round_robin(cells: DataFrame, share: float | None = None, count: int | None = None) -> DataFrame:
    """(id, cell, rank_pos): the first k rows of `cells(id, cell)` by (rank inside
    the cell, cell, id), k being `count` or the `share` of the rows, rounded up.

    Ranks inside a cell and the order of cells follow md5, so that neither old ids
    nor southern cells come first. Every cell gives its r-th row before any cell
    gives its (r+1)-th. k above the number of rows takes all; an empty frame gives
    an empty result. The last full round follows from the distribution of cell
    sizes alone (at most sqrt(2 rows) different ones); no task sorts all rows.
    """
    if (share is None) == (count is None):
        raise ValueError("give either share or count")
    spark = cells.sparkSession
    cells = cut(cells)
    ranked = spread_rank(cells.withColumn("_order", hash_order("id")), ["cell"], "_order", "rank_pos").drop("_order")
    ranked = cut(ranked)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    wanted = f"ceil(sum(size * n) over () * {share!r}D)" if share is not None else str(int(count))
    cut_row = spark.sql(
        f"""
        with steps as (
          select size, {wanted} as k,
                 coalesce(sum(size * n) over (order by size rows between unbounded preceding and 1 preceding), 0) as below,
                 coalesce(lag(size) over (order by size), 0) as prev,
                 sum(n) over (order by size rows between current row and unbounded following) as cells_left
          from {{sizes}}
        ), rounds as (
          select least(size, floor((k - below) / cells_left)) as full, below, cells_left, k
          from steps where below + prev * cells_left <= k
        )
        select cast(max(full) as bigint) as full_rounds,
               cast(max_by(k - below - full * cells_left, full) as bigint) as rest from rounds
        """,
        sizes=sizes,
    )
    placed = ranked.crossJoin(F.broadcast(cut_row))  # one row
    whole = placed.where("rank_pos <= full_rounds").select("id", "cell", "rank_pos")
    partial = placed.where("rank_pos = full_rounds + 1").withColumn("_order", hash_order("cell"))
    last = spread_rank(partial, ["rank_pos"], "_order", "_at").where("_at <= rest").select("id", "cell", "rank_pos")
    return whole.unionByName(last)
