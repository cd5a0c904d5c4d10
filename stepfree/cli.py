"""python -m stepfree.cli COMMAND ...: the engine's jobs. `COMMAND --help` lists a job's options."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.operators import audit, images, raster
from stepfree.plans import journeys, registry
from stepfree.sources import files
from stepfree.sources.sinks import write_csv, write_shards

#: Jobs that are a registered query over a folder of tables.
QUERIES = {
    "fuse": "fused_edges", "score": "barrier_score", "downselect": "downselect_topk", "worklist": "worklist_unlabelled", "status": "label_status", "labels": "apply_labels",
    "weights": "weight_sweep", "seeds": "seed_stability", "thresholds": "threshold_sensitivity", "widths": "width_confusion", "verify": "guard_violations", "coverage": "tag_coverage",
}


def _refresh(spark: SparkSession, given: argparse.Namespace) -> None:
    """Compare the tables' network with the latest snapshot, write today's, append to the log."""
    nodes, edges = (spark.read.parquet(f"{given.input}/{n}.parquet") for n in ("nodes", "edges_raw"))
    try:
        old = files.read_snapshot(spark, given.output)[1]
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    audit.refresh(old, nodes, edges, given.output, given.day).show(20, truncate=False)


def _slope(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    cells = raster.clean_cells(spark.read.parquet(given.input).select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double")), given.nodata)
    size = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    return raster.slope(cells, size[0], size[1], given.cell)


def _dem(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    lines = files.read_lines(spark, given.input, given.elevation)
    if given.box:
        west, south, east, north = audit.parse_box(given.box)
        inside = F.exists("vertices", lambda p: (p[0] >= west) & (p[0] <= east) & (p[1] >= south) & (p[1] <= north))
        lines = lines.where(inside)
    return raster.grid(raster.densify(files.segments(lines), ["line_id", "part"], given.spacing), given.cell)


def _manifests(spark: SparkSession, given: argparse.Namespace) -> None:
    rows = files.read_manifest(spark, given.input, given.train, given.city)
    if given.box:
        rows = images.in_box(rows, "latitude", "longitude", *audit.parse_box(given.box))
    write_shards(rows.join(images.shards(rows, "image_id", "split", given.shard_size).select("image_id", "shard"), "image_id"), given.output)


def _experiment(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    return journeys.experiment(spark, given.input, given.pairs, given.seed, given.steep)


def _query(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    return registry.queries()[given.name if given.command == "query" else QUERIES[given.command]](spark, given.input)


def _parser() -> argparse.ArgumentParser:
    cli = argparse.ArgumentParser(description=__doc__)
    jobs = cli.add_subparsers(dest="command", required=True)

    def job(name: str, run, what: str, formats: bool = True) -> argparse.ArgumentParser:  # noqa: ANN001
        out = jobs.add_parser(name, help=run.__doc__ or what)
        out.add_argument("input", help=what)
        out.add_argument("--output", required=True)
        if formats:
            out.add_argument("--format", choices=["parquet", "csv"], default="parquet")
        out.set_defaults(run=run)
        return out

    for name in QUERIES:
        job(name, _query, "folder of Parquet tables")
    job("query", _query, "folder of Parquet tables").add_argument("--name", required=True, choices=sorted(registry.queries()))
    job("refresh", _refresh, "folder with nodes and edges_raw", formats=False).add_argument("--day", required=True, help="YYYY-MM-DD of the snapshot")
    slope = job("slope", _slope, "Parquet of cells (row, col, value)")
    slope.add_argument("--cell", type=float, default=1.0, help="metres")
    slope.add_argument("--nodata", type=float, default=-9999.0)
    dem = job("dem", _dem, "GeoJSON contour lines, coordinates in metres")
    dem.add_argument("--elevation", required=True, help="property with the height")
    dem.add_argument("--cell", type=float, default=1.0)
    dem.add_argument("--spacing", type=float, default=5.0)
    dem.add_argument("--box", help="west,south,east,north: only lines that reach into it")
    manifests = job("manifests", _manifests, "manifest CSV with a header", formats=False)
    manifests.add_argument("--train", type=float, default=0.85)
    manifests.add_argument("--shard-size", type=int, default=5000)
    manifests.add_argument("--city")
    manifests.add_argument("--box", help="west,south,east,north")
    experiment = job("experiment", _experiment, "folder of Parquet tables")
    experiment.add_argument("--pairs", type=int, default=journeys.PAIRS)
    experiment.add_argument("--seed", type=int, default=42)
    experiment.add_argument("--steep", type=float, default=journeys.M.STEEP)
    return cli


def main(args: list[str] | None = None) -> None:
    given = _parser().parse_args(args)
    spark = SparkSession.builder.appName(f"stepfree {given.command}").getOrCreate()
    result = given.run(spark, given)
    if result is None:
        return
    if given.format == "csv":
        write_csv(result, given.output)
    else:
        result.write.mode("overwrite").parquet(given.output)


if __name__ == "__main__":
    main()
