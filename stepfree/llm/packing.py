"""Documents into sequences of a fixed number of tokens, with little left unused.

The plan is made on the distribution of lengths (at most `capacity` numbers),
never on documents, so its cost does not depend on how many there are:

1. lengths above `capacity / small_part` are large. They are cut into groups of
   nearly equal cardinality and rounded up to the group's longest (linear
   grouping); a length is never divided between groups;
2. the few rounded sizes give a cutting-stock linear programme, solved by column
   generation: a dense basis and a knapsack by dynamic programming;
3. the actual documents take the slots of the chosen configurations, by rank;
4. what the actual documents leave free is again a distribution, and the small
   lengths are put best-fit, longest first, into it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfree.operators.ranking import hash_order, spread_rank
from stepfree.session import cut

CAPACITY = 2048
SMALL_PART = 8
SIZE_GROUPS = 24
#: Vocabulary file of a public tokenizer; the session setting `stepfree.tokenizer` names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(id, n_tokens) of the whole text; null and empty texts have 0 tokens. The
    vocabulary (a file of a megabyte or so, whatever the data) is read on the driver
    and sent along, so executors need no file."""
    spark = df.sparkSession
    with open(path or spark.conf.get("stepfree.tokenizer", TOKENIZER), "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, n_tokens bigint")


# --- configurations of few sizes -------------------------------------------------


def _best_config(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one container (unbounded knapsack)."""
    smallest = int(sizes.min())
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    rows = list(zip(sizes.tolist(), worth.tolist()))
    for c in range(smallest, capacity + 1):
        best, at = value[c - 1], -1
        for k, (s, w) in enumerate(rows):
            if s <= c and value[c - s] + w > best + 1e-12:
                best, at = value[c - s] + w, k
        value[c], last[c] = best, at
    config, c = np.zeros(len(sizes), np.int64), capacity
    while c >= smallest:
        if last[c] < 0:
            c -= 1
        else:
            config[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(value[capacity]), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """(configuration, how often): covers `demand` of `sizes` with few containers."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, config = _best_config(sizes, np.maximum(dual, 0.0), capacity)
        if value <= 1 + 1e-9:
            break
        way = np.linalg.solve(basis, config.astype(float))
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * way, 0.0)
        x[out] = step
        basis[:, out] = config
    chosen = [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(k)]
    chosen = [(c, n) for c, n in chosen if n > 0]
    left = np.maximum(demand - sum((c * n for c, n in chosen), np.zeros(k, np.int64)), 0)
    by_size = np.argsort(-sizes, kind="stable")
    while left.any():
        config, room = np.zeros(k, np.int64), capacity
        for j in by_size:
            config[j] = min(int(left[j]), room // int(sizes[j]))
            room -= int(config[j]) * int(sizes[j])
        used = config > 0
        n = int((left[used] // config[used]).min())
        chosen.append((config, n))
        left = left - config * n
    return chosen


def linear_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """The rounded-up size of each length: groups of about equal cardinality,
    longest first."""
    order = np.argsort(-lengths, kind="stable")
    total = counts.sum()
    before = np.cumsum(counts[order]) - counts[order]
    number = np.minimum(before * groups // max(1, total), groups - 1)
    rounded = np.empty(len(lengths), np.int64)
    for g in np.unique(number):
        inside = order[number == g]
        rounded[inside] = lengths[inside].max()
    return rounded


@dataclass
class LargePlan:
    """Where the j-th item of a rounded size goes; sizes and slots only."""

    sizes: np.ndarray
    starts: list[np.ndarray] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    containers: int = 0

    @classmethod
    def of(cls, sizes: np.ndarray, chosen: list[tuple[np.ndarray, int]]) -> LargePlan:
        plan = cls(sizes)
        base = np.concatenate([[0], np.cumsum([n for _, n in chosen])]).astype(np.int64)
        plan.containers = int(base[-1])
        for k in range(len(sizes)):
            use = [i for i, (c, _) in enumerate(chosen) if c[k]]
            slots = np.array([chosen[i][0][k] * chosen[i][1] for i in use], np.int64)
            plan.starts.append(np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.int64) if len(use) else np.zeros(0, np.int64))
            plan.first.append(base[use])
            plan.times.append(np.array([chosen[i][1] for i in use], np.int64))
        return plan

    def container(self, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Container of the `at`-th (from 0) item of each rounded size."""
        out = np.zeros(len(size), np.int64)
        for k, s in enumerate(self.sizes):
            here = size == s
            if here.any():
                i = np.searchsorted(self.starts[k], at[here], side="right") - 1
                out[here] = self.first[k][i] + (at[here] - self.starts[k][i]) % self.times[k][i]
        return out


def best_fit(free: dict[int, int], small: dict[int, int], capacity: int, next_container: int) -> tuple[list[tuple[int, ...]], int]:
    """Small lengths into free space, longest first, each into the least space
    that holds it; new containers where nothing does.

    Works on counts: `free` {space: containers}, `small` {length: documents}.
    Returns rows (length, first document, documents, space class or -1 for new
    ones, first container of the class, documents per container) and the next
    unused container number.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in free.items() if n and r > 0}
    plan: list[tuple[int, ...]] = []
    for s in sorted(small, reverse=True):
        at, left = 0, small[s]
        while left:
            fits = min((r for r in runs if r >= s), default=None)
            if fits is None:
                per = capacity // s
                n = -(-left // per)
                runs.setdefault(capacity, []).append((-1, next_container, next_container + n))
                next_container += n
                fits = capacity
            origin, a, b = runs[fits].pop()
            if not runs[fits]:
                del runs[fits]
            per = fits // s
            full = min(b - a, left // per)
            if full:
                plan.append((s, at, full * per, origin, a, per))
                at, left = at + full * per, left - full * per
                if fits - per * s:
                    runs.setdefault(fits - per * s, []).append((origin, a, a + full))
                a += full
            elif left:
                plan.append((s, at, left, origin, a, left))
                if fits - left * s:
                    runs.setdefault(fits - left * s, []).append((origin, a, a + 1))
                at, left, a = at + left, 0, a + 1
            if a < b:
                runs.setdefault(fits, []).append((origin, a, b))
    return plan, next_container


# --- the operator ----------------------------------------------------------------


def pack(counts: DataFrame, capacity: int = CAPACITY, small_part: int = SMALL_PART, groups: int = SIZE_GROUPS) -> DataFrame:
    """(id, piece, seq_no, place, start, n_tokens) from (id, n_tokens).

    Items longer than `capacity` are cut into full pieces and a rest, numbered
    from 0; no other item is split. `place` counts from 1 inside a sequence,
    longest first, and `start` is the token at which the piece begins there.
    Items without tokens (0, negative or null) have one row with null sequence,
    place and start. ids must be unique; a repeated id is packed once per row.
    An empty frame gives an empty result. Sequence numbers are unique, start at 0
    and may have gaps.
    """
    spark = counts.sparkSession
    kind = counts.schema["id"].dataType.simpleString()
    counts = counts.select("id", F.coalesce(F.greatest("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens"))
    pieces = counts.where("n_tokens > 0").select(
        "id", F.posexplode(F.expr(f"transform(sequence(0, ceil(n_tokens / {capacity}) - 1), i -> least({capacity}, n_tokens - i * {capacity}))")).alias("piece", "size")
    )
    pieces = pieces.select("id", "piece", F.col("size").cast("long").alias("size"), hash_order("id", "piece").alias("_order"))
    sizes = {int(r["size"]): int(r.n) for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = counts.where("n_tokens = 0").select(
        "id", F.lit(0).alias("piece"), F.lit(None).cast("bigint").alias("seq_no"), F.lit(None).cast("int").alias("place"),
        F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_tokens"),
    )

    lengths = np.array(sorted(s for s in sizes if s * small_part > capacity), np.int64)
    numbers = np.array([sizes[int(s)] for s in lengths], np.int64)
    rounded = linear_groups(lengths, numbers, groups) if len(lengths) else lengths
    few = np.unique(rounded)
    plan = LargePlan.of(few, configurations(few, np.array([numbers[rounded == s].sum() for s in few], np.int64), capacity))
    to_rounded = np.zeros(capacity + 1, np.int64)
    to_rounded[lengths] = rounded

    def place_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(4).to_numpy() - 1
            seq = plan.container(batch.column(3).to_numpy(), at)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(seq)], names=["id", "piece", "size", "seq_no"])

    steps = F.array(*[F.lit(int(x)) for x in few]) if len(few) else F.array(F.lit(0))
    grouped = pieces.where(F.col("size") * small_part > capacity).withColumn(
        "rounded", F.array_min(F.filter(steps, lambda x: x >= F.col("size"))).cast("long")
    )
    ranked = spread_rank(grouped, ["rounded"], "_order", "at")
    shape = f"id {kind}, piece int, size bigint, seq_no bigint"
    large = cut(ranked.select("id", "piece", "size", "rounded", "at").mapInArrow(place_large, shape))

    room = large.groupBy("seq_no").agg((F.lit(capacity) - F.sum("size")).cast("long").alias("free")).where("free > 0")
    room = room.withColumn("_order", hash_order("seq_no"))
    free = {int(r.free): int(r.n) for r in room.groupBy("free").agg(F.count(F.lit(1)).alias("n")).collect()}
    fill, _ = best_fit(free, {s: n for s, n in sizes.items() if s * small_part <= capacity}, capacity, plan.containers)
    table = np.array(sorted(fill) or [(0, 0, 0, 0, 0, 1)], np.int64)
    # one sorted key for (length, first document): lengths are at most `capacity`
    marks = [(int(s), int(a)) for s, a in table[:, :2]]

    def place_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(marks, dtype=np.int64)
        by_size = {int(s): np.nonzero(edges[:, 0] == s)[0] for s in np.unique(edges[:, 0])}
        for batch in batches:
            size, at = batch.column(2).to_numpy(), batch.column(3).to_numpy() - 1
            row = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                here, own = size == s, by_size[int(s)]
                row[here] = own[np.searchsorted(edges[own, 1], at[here], side="right") - 1]
            found = table[row]
            spot = found[:, 4] + (at - found[:, 1]) // found[:, 5]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(found[:, 3]), pa.array(spot)], names=["id", "piece", "size", "space", "spot"]
            )

    low = spread_rank(pieces.where(F.col("size") * small_part <= capacity), ["size"], "_order", "at").select("id", "piece", "size", "at")
    small = cut(low.mapInArrow(place_small, f"id {kind}, piece int, size bigint, space bigint, spot bigint"))
    fresh = small.where("space < 0").select("id", "piece", "size", F.col("spot").alias("seq_no"))
    spots = spread_rank(room, ["free"], "_order", "at").select("seq_no", F.col("free").alias("space"), (F.col("at") - 1).alias("spot"))
    filled = small.where("space >= 0").join(spots, ["space", "spot"]).select("id", "piece", "size", "seq_no")

    inside = Window.partitionBy("seq_no").orderBy(F.desc("size"), "id", "piece")
    done = large.unionByName(fresh).unionByName(filled).select(
        "id", "piece", "seq_no", F.row_number().over(inside).alias("place"),
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("start"),
        F.col("size").alias("n_tokens"),
    )
    return done.unionByName(none)
