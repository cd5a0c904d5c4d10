"""Rasters as long tables (row, col, value): slope, samples, lines to points, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SLOPE = 150.0


def clean_cells(df: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """(row, col, value) with null for NaN and NoData."""
    v = F.col("value").cast("double")
    return df.select("row", "col", F.when(~F.isnan(v) & (F.abs(v - nodata) > 1e-6), v).alias("value"))


def slope(cells: DataFrame, rows: int, cols: int, res: float = 1.0, most: float = MOST_SLOPE) -> DataFrame:
    """(row, col, slope): percent, by central differences, one-sided at the raster's
    border. Null where the cell or a neighbour in use is missing, or above `most`.
    A window per line and per column, so a task never holds more than one of them."""
    def gradient(at: str, across: str, size: int) -> Column:
        w = Window.partitionBy(across).orderBy(at)
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("value").over(w))
        after = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("value").over(w))
        middle = (after - before) / (2 * res)
        return F.when(F.col(at) == 0, (after - F.col("value")) / res).when(F.col(at) == size - 1, (F.col("value") - before) / res).otherwise(middle)

    if rows < 2 or cols < 2:
        raise ValueError("a slope needs two rows and two columns")
    both = cells.withColumn("gx", gradient("col", "row", cols)).withColumn("gy", gradient("row", "col", rows))
    pct = 100.0 * F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return both.select("row", "col", F.when(F.col("value").isNotNull() & (pct <= most), pct).alias("slope"))


def sample(points: DataFrame, cells: DataFrame, value: str, x0: float, y0: float, res_x: float, res_y: float) -> DataFrame:
    """`points` (with x, y) and the value of the cell each lies in; null outside. An
    equi-join on the cell's numbers."""
    at = points.withColumns({"_r": F.floor((F.col("y") - y0) / res_y), "_c": F.floor((F.col("x") - x0) / res_x)})
    grid = cells.select(F.col("row").cast("bigint").alias("_r"), F.col("col").cast("bigint").alias("_c"), F.col(value))
    return at.join(grid, ["_r", "_c"], "left").drop("_r", "_c")


def stats(cells: DataFrame, value: str = "value") -> DataFrame:
    """(n, n_valid, pct_valid, least, mean, most); nulls for no valid cell."""
    n, ok = F.count(F.lit(1)), F.count(value)
    mean = F.sum(F.floor(F.col(value) * 1e6 + 0.5).cast("bigint")) / 1e6 / ok
    return cells.agg(
        n.alias("n"), ok.alias("n_valid"), F.when(n > 0, F.floor(ok * 10000.0 / n + 0.5) / 100).alias("pct_valid"), F.min(value).alias("least"),
        F.when(ok > 0, F.floor(mean * 1e6 + 0.5) / 1e6).alias("mean"), F.max(value).alias("most"),
    )


def densify(lines: DataFrame, keys: list[str], spacing: float) -> DataFrame:
    """(keys..., i, x, y, z) along straight lines (x0, y0, x1, y1, z): max(2,
    floor(length / spacing)) equal steps; lines without length give nothing."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.floor(F.sqrt(dx * dx + dy * dy) / spacing), F.lit(2))
    rows = lines.withColumn("_n", n).where(F.sqrt(dx * dx + dy * dy) > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    t = F.col("i") / F.col("_n")
    return rows.select(*keys, "i", (F.col("x0") + dx * t).alias("x"), (F.col("y0") + dy * t).alias("y"), "z")


def grid(points: DataFrame, cell: float, reach: int = 3) -> DataFrame:
    """(row, col, value): elevation at cell centres, by inverse squared distance over
    the points whose cell lies at most `reach` cells away; cells without one are
    left out. A substitute for triangulated interpolation and not equal to it. Each
    point goes to the cells around it, partial sums meet there: no neighbour search."""
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)])
    p = points.where("z is not null").withColumn("o", F.explode(offsets))
    p = p.withColumns({"row": F.floor(F.col("y") / cell) + F.col("o.r"), "col": F.floor(F.col("x") / cell) + F.col("o.c")})
    dx, dy = F.col("x") - (F.col("col") + 0.5) * cell, F.col("y") - (F.col("row") + 0.5) * cell
    w = 1.0 / (dx * dx + dy * dy + 1e-6)
    return p.withColumn("w", w).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("value"))
