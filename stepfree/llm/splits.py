"""Train, validation and test splits that keep groups of related records whole."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from itertools import count as counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.operators.ranking import hash_order, spread_rank

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
BINS = 100


def _flatten(tree: object) -> list[tuple[int, int]]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if x is None:
            continue
        if isinstance(x[0], int):
            out.append(x)
        else:
            todo += [x[0], x[1]]
    return out


def largest_differencing(classes: Mapping[int, int], bins: int = BINS) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """Weight classes {weight: number of groups} into bins of nearly equal weight.

    Of a class, every full round of `bins` groups gives each bin one group. What
    is left over starts as one partial partition per class (the weight in some
    bins, nothing in the others); the two partitions with the greatest difference
    between their extreme bins are combined, heaviest bin with lightest, until one
    is left. Returns the bins' weights and the bin of (weight, i), the i-th left
    over group of a class.
    """
    base = float(sum(w * (n // bins) for w, n in classes.items()))
    tick = counter()
    heap: list[tuple[float, int, np.ndarray, list]] = []
    for w in sorted(classes):
        left = classes[w] % bins
        if left:
            loads = np.zeros(bins)
            loads[:left] = w
            heap.append((-float(w), next(tick), loads, [(w, i) for i in range(left)] + [None] * (bins - left)))
    heapq.heapify(heap)
    if not heap:
        return np.full(bins, base), {}
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        loads = a + b[::-1]
        joined = [x if y is None else y if x is None else (x, y) for x, y in zip(in_a, reversed(in_b))]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        heapq.heappush(heap, (-(loads[0] - loads[-1]), next(tick), loads, [joined[i] for i in order]))
    _, _, loads, inside = heap[0]
    return loads + base, {item: b for b, tree in enumerate(inside) for item in _flatten(tree)}


def allot_bins(loads: np.ndarray, shares: Mapping[str, float]) -> list[str]:
    """A split for each bin: heaviest bins first, each to the split that is
    furthest below its target."""
    names = list(shares)
    missing = np.array([shares[s] for s in names]) / sum(shares.values()) * loads.sum()
    out = [""] * len(loads)
    for b in np.argsort(-loads, kind="stable"):
        best = int(np.argmax(missing))
        out[b] = names[best]
        missing[best] -= loads[b]
    return out


def split_by_group(members: DataFrame, shares: Mapping[str, float] = SHARES, bins: int = BINS) -> DataFrame:
    """(id, group_id, split) from (id, group_id): whole groups, splits near `shares`.

    Only the distribution of group sizes reaches the driver (at most sqrt(2 rows)
    different sizes). A group larger than a split's target makes that split larger
    than asked; groups are never torn. The result is the same on every run. Rows
    with a null group are left out; an empty frame gives an empty result.
    """
    spark = members.sparkSession
    members = members.where("group_id is not null")
    weights = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("w"))
    classes = {int(r.w): int(r.n) for r in weights.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    loads, left = largest_differencing(classes, bins)
    names = allot_bins(loads, shares)
    of_bin = F.array(*[F.lit(n) for n in names])
    plan = pd.DataFrame(
        [(w, classes[w] // bins * bins + i + 1, names[b]) for (w, i), b in left.items()] or [(0, 0, "")],
        columns=["_w", "_at", "_split"],
    )
    ranked = spread_rank(weights.withColumn("_order", hash_order("group_id")), ["w"], "_order", "at").drop("_order")
    placed = ranked.join(spark.createDataFrame(plan, "_w bigint, _at bigint, _split string"), (F.col("w") == F.col("_w")) & (F.col("at") == F.col("_at")), "left")
    split = F.coalesce("_split", F.element_at(of_bin, (F.pmod(F.col("at") - 1, F.lit(bins)) + 1).cast("int")))
    chosen = placed.select(F.col("group_id").alias("_group"), split.alias("split"))
    return members.join(chosen, F.col("group_id") == F.col("_group")).select("id", "group_id", "split")


def torn_groups(members: DataFrame, recorded: DataFrame) -> DataFrame:
    """(id, group_id) of every member of a group whose recorded splits differ.

    `recorded` is (id, recorded), at most one row per id; null is no split.
    """
    known = members.join(recorded, "id", "left")
    torn = known.groupBy("group_id").agg(F.min("recorded").alias("a"), F.max("recorded").alias("b")).where("a < b")
    return members.join(torn.select("group_id"), "group_id", "left_semi").select("id", "group_id")
