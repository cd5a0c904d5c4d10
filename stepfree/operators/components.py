"""Connected components of an edge list, by alternating star contraction.

Each round turns the graph into stars around lesser ids ("large star": hand the
greater neighbours to the least neighbour; "small star": hand the lesser ones on
as well). The number of rounds grows with the logarithm of the longest path, and
every round is two aggregations and two joins over the links alone. Before the
rounds every task contracts its own links to stars, and links few enough for one
task (a checked bound) are finished by one, so small inputs need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.operators.kdtree import merge_labels
from stepfree.session import cut

#: More rounds than this end the job with an error.
MAX_ROUNDS = 60
#: Links that one task finishes: about 50 MB of ids.
TASK_LINKS = 1_000_000


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    handed = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = found.select("u", F.col("m").alias("v"))
    return handed.unionByName(own).where("u <> v").distinct()


def _contract(links: DataFrame) -> DataFrame:
    """Each task's links (u, v) as stars around the least node of what they connect, in
    blocks of at most `TASK_LINKS`; the same components with fewer links."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_LINKS:
                yield from _stars(held)
                held = []
        yield from _stars(held)

    kind = links.schema["u"].dataType.simpleString()
    return links.mapInArrow(stars, f"u {kind}, v {kind}")


def _stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    whole = pa.Table.from_batches(held)
    n = whole.num_rows
    coded = pa.chunked_array(whole.column("u").chunks + whole.column("v").chunks).combine_chunks()
    coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    names = coded.dictionary
    order = pa.compute.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()]
    labels = merge_labels(np.arange(len(order)), at[:n], at[n:])
    sorted_names = names.take(pa.array(order))
    inner = np.flatnonzero(labels != np.arange(len(order)))
    yield pa.RecordBatch.from_arrays([sorted_names.take(pa.array(inner)), sorted_names.take(pa.array(labels[inner]))], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(u, v)`; root is the least node it is
    linked to, directly or not. Self links and repeated links are harmless, links
    with a null end are dropped, an empty frame gives an empty result. Nodes
    that only link to themselves come out as their own root.
    """
    links = edges.select("u", "v").where("u is not null and v is not null")
    state = cut(_contract(links.where("u <> v")))
    seen = None
    for _ in range(MAX_ROUNDS):
        if state.count() <= TASK_LINKS:
            state = cut(_contract(state.coalesce(1)))
            break
        state = cut(_small_star(_large_star(state)))
        mark = state.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = links.select(F.col("u").alias("node")).union(links.select("v"))
    return (
        nodes.distinct().join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    )
