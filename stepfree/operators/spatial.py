"""Neighbours within a distance, groups of neighbours, and regions holding a point.

Positions become unit vectors in space, so poles and the date line are places
like any other and a distance on the sphere is a chord length. Space is cut by
k-d planes that are fitted on a bounded sample; every row is assigned to a leaf
and copied to the leaves within the radius of it (its halo). Each leaf is then
queried alone by a local k-d tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.geo import chord, unit_vector, usable
from stepfree.operators.components import connected_components
from stepfree.operators.kdtree import KDTree, Planes

#: Rows a leaf is planned to hold; rows the split planes are fitted on.
LEAF_ROWS = 8192
SAMPLE_ROWS = 200_000
#: With more leaves the sample grows by so many rows a leaf, up to the most (100 MB on
#: the driver, enough for 2 billion rows; beyond that crowded leaves are divided).
SAMPLE_PER_LEAF, MOST_SAMPLE_ROWS = 16, 4_000_000


def clean_positions(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """One usable position per key (the least, should copies disagree) as (id, lat, lon)."""
    rows = df.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon")))
    best = rows.groupBy("id").agg(F.min(F.struct(F.col("lat") + 0.0, F.col("lon") + 0.0)).alias("p"))
    return best.select("id", F.col("p.col1").alias("lat"), F.col("p.col2").alias("lon"))


def fit_planes(df: DataFrame, lat: str, lon: str, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> tuple[Planes, np.ndarray]:
    """Planes fitted on a sample, and the blocks each leaf is divided into: a place
    with very many rows lies in one leaf whatever the planes. Both decide how the
    work is divided, never which rows are compared."""
    here = df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    total = here.count()
    leaves = max(1, -(-total // leaf_rows))
    sample_rows = max(sample_rows, min(MOST_SAMPLE_ROWS, leaves * SAMPLE_PER_LEAF))
    leaves = min(leaves, max(1, sample_rows // SAMPLE_PER_LEAF))
    if leaves == 1:
        return Planes(np.zeros((0, 3)), 1), np.ones(2, np.int64)
    part = here.where(usable(F.col("lat"), F.col("lon"))).sample(min(1.0, sample_rows / total), seed=7).limit(sample_rows)
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    points = part.select(x.alias("x"), y.alias("y"), z.alias("z")).toPandas().to_numpy(float)
    planes = Planes(points, leaves)
    return planes, planes.blocks(points, total, leaf_rows)


def _to_leaves(points: DataFrame, planes: Planes, halo: float, blocks: np.ndarray | None = None) -> DataFrame:
    """(leaf, first, second, block, home, shared, id, weight, x, y, z) from (id, lat, lon,
    weight). A row of a leaf with several blocks goes to its block's task with each
    block, its own included: first <= second."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    vectors = points.select("id", "weight", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int").alias("h"), x.alias("x"), y.alias("y"), z.alias("z"))
    kind = points.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)]).reshape(-1, 3)
            row, leaf, home = planes.assign(xyz, halo)
            shared = np.bincount(row, minlength=len(xyz))[row] > 1
            many = np.ones(len(row), np.int64) if blocks is None else blocks[leaf]
            block = batch.column(2).to_numpy()[row] % many
            copy = np.repeat(np.arange(len(row)), many)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(many) - many, many)
            row, leaf, home, shared, block = row[copy], leaf[copy], home[copy], shared[copy], block[copy]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(leaf, pa.int64()), pa.array(np.minimum(block, other), pa.int32()), pa.array(np.maximum(block, other), pa.int32()), pa.array(block, pa.int32()),
                    pa.array(home), pa.array(shared), *[batch.column(i).take(pa.array(row)) for i in (0, 1)], *[pa.array(xyz[row, i]) for i in range(3)],
                ],
                names=["leaf", "first", "second", "block", "home", "shared", "id", "weight", "x", "y", "z"],
            )

    return vectors.mapInArrow(
        assign, f"leaf bigint, first int, second int, block int, home boolean, shared boolean, id {kind}, weight bigint, x double, y double, z double"
    )


def _leaf_arrays(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    whole = pa.Table.from_batches(list(batches)).combine_chunks()
    ids = whole.column("id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    xyz = np.column_stack([whole.column(c).to_numpy() for c in ("x", "y", "z")])
    flags = [whole.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "shared")]
    return whole, ids, rank, xyz, *flags


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every pair (id_a, id_b), id_a < id_b, of different keys at most `metres` apart.

    Rows with a null key or an unusable position take no part; copies of a key
    count once; keys at the very same place are pairs like others. Each pair is
    reported once, by the leaf that is home to the lesser key. An empty table
    gives an empty result. Work follows the result: a spot with n pictures has
    n(n-1)/2 pairs. A leaf that holds such a spot is divided into blocks and each
    pair of blocks is a task of its own; `near_links` answers without listing pairs.
    """
    radius = chord(metres)
    points = clean_positions(df, key, lat, lon).withColumn("weight", F.lit(1).cast("bigint"))
    planes, blocks = fit_planes(df, lat, lon, leaf_rows, sample_rows)
    leaves = _to_leaves(points, planes, radius, blocks)
    kind = points.schema["id"].dataType.simpleString()

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ids, rank, xyz, home, _ = _leaf_arrays(batches)
        block = whole.column("block").to_numpy()
        if key[1].as_py() == key[2].as_py():
            found = KDTree(xyz).pairs(radius)
        else:
            sides = [np.flatnonzero(block == key[n].as_py()) for n in (1, 2)]
            depth = KDTree.fitting(max(len(s) for s in sides))
            trees = [KDTree(xyz[s], depth=depth) for s in sides]
            found = ((sides[0][i], sides[1][j]) for i, j in trees[0].pairs_with(trees[1], radius))
        for i, j in found:
            a, b = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            mine = home[a]
            if mine.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[mine])), ids.take(pa.array(b[mine]))], names=["id_a", "id_b"])

    return leaves.groupBy("leaf", "first", "second").applyInArrow(join, f"id_a {kind}, id_b {kind}")


def near_links(df: DataFrame, key: str, lat: str, lon: str, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, place_id, n_links): per key the class of keys at the very same position, named
    by its least key, and the number of other keys at most `metres` away.

    What `near_pairs` tells without its pairs: keys at one place are one weighted
    point, and crowds within the distance are added as wholes. Nulls, unusable
    positions, copies and empty tables as in `near_pairs`; lone keys have 0 links.
    """
    radius = chord(metres)
    images = clean_positions(df, key, lat, lon)
    places = images.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    planes, _ = fit_planes(df, lat, lon, leaf_rows, sample_rows)
    kind = images.schema["id"].dataType.simpleString()

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ids, _, xyz, home, _ = _leaf_arrays(batches)
        near = KDTree(xyz).weights_near(radius, whole.column("weight").to_numpy())
        mine = np.flatnonzero(home)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), pa.array(near[mine] - 1, pa.int64())], names=["place_id", "n_links"])

    counted = _to_leaves(places, planes, radius).groupBy("leaf").applyInArrow(count, f"place_id {kind}, n_links bigint")
    at = places.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("id").alias("place_id")).join(counted, "place_id")
    return images.join(at, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))).select("id", "place_id", "n_links")


def near_groups(df: DataFrame, key: str, lat: str, lon: str, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, group_id): keys whose positions are linked by steps of at most `metres`;
    group_id is the least key of the group, lone keys are groups of one.

    Keys at one place are merged before anything else and no pairs are listed:
    every leaf finds its own components, and only rows that several leaves hold
    link those components across leaves. Nulls, unusable positions, copies and
    empty tables as in `near_pairs`.
    """
    radius = chord(metres)
    images = clean_positions(df, key, lat, lon)
    places = images.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    leaves = _to_leaves(places, fit_planes(df, lat, lon, leaf_rows, sample_rows)[0], radius)
    kind = images.schema["id"].dataType.simpleString()

    def local(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, rank, xyz, home, shared = _leaf_arrays(batches)
        label = KDTree(xyz).components(radius)
        least = np.full(len(rank), len(rank))
        np.minimum.at(least, label, rank)
        by_rank = np.argsort(rank)
        lead = by_rank[least[label]]
        keep = np.nonzero(home | shared)[0]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(keep)), ids.take(pa.array(lead[keep])), pa.array(home[keep]), pa.array(shared[keep])],
            names=["id", "lead", "home", "shared"],
        )

    from stepfree.session import cut

    found = cut(leaves.groupBy("leaf").applyInArrow(local, f"id {kind}, lead {kind}, home boolean, shared boolean"))
    roots = connected_components(found.where("shared").select(F.col("id").alias("u"), F.col("lead").alias("v")))
    roots = roots.where("node <> root").withColumnRenamed("node", "lead")
    grouped = found.where("home").join(roots, "lead", "left").select(F.col("id").alias("place"), F.coalesce("root", "lead").alias("group_id"))
    keyed = places.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("id").alias("place")).join(grouped, "place")
    return images.join(keyed, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))).select("id", "group_id")
