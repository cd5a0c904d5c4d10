"""Looks at data as a whole: bounds, value counts, expected figures, daily refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfree.functions.geo import usable
from stepfree.operators import snapshots


def bounds(df: DataFrame, lat: str, lon: str, by: list[str]) -> DataFrame:
    """(by..., west, south, east, north) of usable positions."""
    ok = df.where(usable(F.col(lat), F.col(lon)))
    return ok.groupBy(*by).agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def parse_box(text: str) -> tuple[float, float, float, float]:
    """west,south,east,north of a text; the box must not be empty."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("four numbers are needed: west,south,east,north")
    west, south, east, north = (float(p) for p in parts)
    if not (west < east and south < north):
        raise ValueError("the box is empty")
    return west, south, east, north


def value_audit(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """(column, n, n_null, n_different, first_values): counts and the first different
    values as text, sorted. One aggregation per column over counted values."""
    out = None
    for c in columns:
        counts = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("v").alias("n_different"))
        firsts = counts.where("v is not null").orderBy("v").limit(most).agg(F.array_join(F.array_sort(F.collect_list("v")), ";").alias("first_values"))
        part = total.crossJoin(F.broadcast(firsts)).select(F.lit(c).alias("column"), "n", "n_null", "n_different", "first_values")  # one row by one row
        out = part if out is None else out.unionByName(part)
    return out


def ledger(figures: DataFrame, expected: DataFrame, tolerance: float = 5e-3) -> DataFrame:
    """(claim, expected, value, holds): whole numbers exactly, others within the
    tolerance; a claim without a figure does not hold."""
    joined = expected.join(figures, "claim", "left")
    whole = F.col("expected") == F.floor("expected")
    near = F.when(whole & (F.col("value") == F.floor("value")), F.col("value") == F.col("expected")).otherwise(F.abs(F.col("value") - F.col("expected")) <= tolerance)
    return joined.select("claim", "expected", "value", F.coalesce(near, F.lit(False)).alias("holds"))


def run_counters(df: DataFrame, failed: Column, empty: Column) -> DataFrame:
    """(processed, failed, no_detections) of a run's rows."""
    hit = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("processed"), hit(failed).alias("failed"), hit(~failed & empty).alias("no_detections"))


def refresh(old: DataFrame | None, nodes: DataFrame, edges: DataFrame, path: str, day: str) -> DataFrame:
    """The day's job: what changed since `old`, a snapshot, a line in the log.
    Run again with the same inputs it writes the same snapshot. Returns the lines."""
    from stepfree.session import cut
    from stepfree.sources.sinks import append_changes, write_snapshot

    lines = cut(snapshots.lines(snapshots.diff(old, edges)))
    write_snapshot(nodes, edges, path, day)
    append_changes(lines, f"{path}/log", day)
    return lines
