"""Which region holds each point: a plane sweep over polygon edges.

The plane is cut by k-d planes fitted on a bounded sample, so that leaves hold about
equally many points. A point lies in the regions of which it has an odd number of
edges to its west, and never east of a region's last corner: an edge goes to the
leaves that the rectangle from its west end to that corner reaches into. In a leaf,
points and edges are swept from south to north. A leaf with very many points, such
as one place, is divided into blocks that each meet the leaf's edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.operators.kdtree import Planes

LEAF_ROWS = 50_000
#: Rows the planes are fitted on: so many a leaf, at least and at most.
SAMPLE_PER_LEAF, SAMPLE_ROWS, MOST_SAMPLE_ROWS = 16, 100_000, 4_000_000
_BLOCK = 2_000_000


def polygon_edges(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """(region, east: the ring's last corner, x0, y0, x1, y1) of rings given as arrays of [x, y]; the last point is
    joined with the first. Level edges never count and are dropped, as are rings of
    fewer than three points and points that are no pair of numbers."""
    ok = F.filter(ring, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull() & ~F.isnan(p[0]) & ~F.isnan(p[1]))
    rings = regions.where(F.col(key).isNotNull()).select(F.col(key).alias("region"), ok.alias("r")).where(F.size("r") >= 3)
    east = F.array_max(F.transform("r", lambda p: p[0])).alias("east")
    pairs = rings.select("region", east, F.explode(F.expr("transform(sequence(0, size(r) - 1), i -> struct(r[i] as a, r[(i + 1) % size(r)] as b))")).alias("e"))
    edges = pairs.select("region", "east", *[F.col(f"e.{p}")[i].alias(n) for p, i, n in (("a", 0, "x0"), ("a", 1, "y0"), ("b", 0, "x1"), ("b", 1, "y1"))])
    return edges.where("y0 <> y1")


def _fit(here: DataFrame, leaf_rows: int) -> tuple[Planes, np.ndarray]:
    total = here.count()
    leaves = max(1, -(-total // leaf_rows))
    if leaves == 1:
        return Planes(np.zeros((0, 2)), 1), np.ones(2, np.int64)
    rows = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, leaves * SAMPLE_PER_LEAF))
    some = here.sample(min(1.0, rows / total), seed=5).limit(rows).select("px", "py").toPandas().to_numpy(float)
    planes = Planes(some, min(leaves, rows // SAMPLE_PER_LEAF))
    return planes, planes.blocks(some, total, leaf_rows)


def sweep(px: np.ndarray, py: np.ndarray, edges: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) pairs by a sweep over y. `edges` is (n, 4) as x0, y0, x1, y1;
    `region` numbers them. A point on an edge belongs to one side of it."""
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    by_low = np.argsort(low, kind="stable")
    order = np.argsort(py, kind="stable")
    active, entered = np.zeros(0, np.int64), 0
    found_p, found_r = [], []
    at = 0
    while at < len(order):
        size = max(1, min(4096, _BLOCK // max(1, len(active) + 64)))
        block = order[at : at + size]
        at += size
        south, north = py[block[0]], py[block[-1]]
        upto = int(np.searchsorted(low[by_low], north, "right"))
        active = np.concatenate([active, by_low[entered:upto]])
        entered = upto
        active = active[high[active] > south]
        if not len(active):
            continue
        active = active[np.argsort(region[active], kind="stable")]
        y = py[block][:, None]
        inside = (low[active][None, :] <= y) & (y < high[active][None, :])
        west = edges[active, 0][None, :] + (y - edges[active, 1][None, :]) * slope[active][None, :] < px[block][:, None]
        starts = np.nonzero(np.diff(region[active], prepend=-1))[0]
        odd = np.add.reduceat((inside & west).astype(np.int32), starts, axis=1) % 2 == 1
        p, r = np.nonzero(odd)
        found_p.append(block[p])
        found_r.append(region[active][starts[r]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_p) if found_p else none), (np.concatenate(found_r) if found_r else none)


def regions_of(points: DataFrame, key: str, x: str, y: str, regions: DataFrame, region_key: str, ring: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, region): every region that holds each point, on the plane of x and y.

    Points without coordinates and points in no region have no row; overlapping
    regions give several rows; repeated keys are located row by row. A ring over the
    date line has to be given in two parts. Edges are sent to the leaves they
    can matter in, points are shuffled once; nothing is compared with everything.
    Empty tables give an empty result.
    """
    here = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    here = here.where("id is not null and px is not null and py is not null and not isnan(px) and not isnan(py)")
    planes, blocks = _fit(here, leaf_rows)
    kind, region_kind = points.schema[key].dataType.simpleString(), regions.schema[region_key].dataType.simpleString()
    edges = polygon_edges(regions, region_key, ring)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]).reshape(-1, 2)
            row, leaf, mine = planes.assign(at, 0.0)
            home = np.zeros(len(at), np.int64)
            home[row[mine]] = leaf[mine]
            block = batch.column(1).to_numpy() % blocks[home]
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(block), *[batch.column(i) for i in (0, 2, 3)]], names=["leaf", "block", "id", "px", "py"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, y0, x1, y1, east = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            low, high = np.column_stack([np.minimum(x0, x1), np.minimum(y0, y1)]), np.column_stack([east, np.maximum(y0, y1)])
            row, leaf = planes.assign_boxes(low.reshape(-1, 2), high.reshape(-1, 2))
            many = blocks[leaf]
            copy = np.repeat(np.arange(len(row)), many)
            block = np.arange(len(copy)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf[copy]), pa.array(block), *[batch.column(i).take(pa.array(row[copy])) for i in range(5)]], names=["leaf", "block", "region", "x0", "y0", "x1", "y1"]
            )

    hashed = here.select("id", F.pmod(F.xxhash64("id", "px", "py"), F.lit(1 << 20)).alias("h"), "px", "py")
    placed = hashed.mapInArrow(place, f"leaf bigint, block bigint, id {kind}, px double, py double")
    laid = edges.select("region", "x0", "y0", "x1", "y1", "east").mapInArrow(lay, f"leaf bigint, block bigint, region {region_kind}, x0 double, y0 double, x1 double, y1 double")

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("id", left.schema.field("id").type), ("region", right.schema.field("region").type)])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        coded = right.column("region").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        lines = np.column_stack([right.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")])
        p, r = sweep(left.column("px").to_numpy(), left.column("py").to_numpy(), lines, coded.indices.to_numpy().astype(np.int64))
        return pa.table([left.column("id").combine_chunks().take(pa.array(p)), coded.dictionary.take(pa.array(r))], schema=out)

    return placed.groupBy("leaf", "block").cogroup(laid.groupBy("leaf", "block")).applyInArrow(locate, f"id {kind}, region {region_kind}")
