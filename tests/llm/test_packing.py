import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfree.llm import packing as P


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(13, 100), st.integers(1, 300), min_size=1, max_size=8))
def test_configurations_cover_the_demand(demand):
    sizes, need = np.array(sorted(demand)), np.array([demand[s] for s in sorted(demand)])
    chosen = P.configurations(sizes, need, 100)
    got = sum(c * n for c, n in chosen)
    assert (got >= need).all() and all((c * sizes).sum() <= 100 and n > 0 for c, n in chosen)
    assert sum(n for _, n in chosen) <= np.ceil((sizes * need).sum() / 100) * 2 + len(sizes)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=8), st.dictionaries(st.integers(1, 12), st.integers(1, 200), max_size=8))
def test_best_fit_places_every_small_one_within_the_space(free, small):
    plan, last = P.best_fit(free, small, 100, 1000)
    placed, used = {}, {}
    for s, first, n, origin, a, per in plan:
        placed.setdefault(s, []).extend(range(first, first + n))
        for i in range(n):
            used[origin, a + i // per] = used.get((origin, a + i // per), 0) + s
    assert {s: sorted(x) for s, x in placed.items()} == {s: list(range(n)) for s, n in small.items()}
    for (origin, c), n in used.items():
        assert n <= (100 if origin == -1 else origin)
        assert 1000 <= c < last if origin == -1 else 0 <= c < free[origin]


def test_linear_groups_round_up_within_groups():
    lengths, counts = np.arange(1, 101), np.full(100, 5)
    rounded = P.linear_groups(lengths, counts, 10)
    assert (rounded >= lengths).all() and len(set(rounded)) == 10
    assert P.linear_groups(np.array([50]), np.array([1000]), 10).tolist() == [50]


def check(spark, sizes, capacity):
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n_tokens bigint").repartition(3)
    rows = P.pack(df, capacity).collect()
    whole, filled = {}, {}
    for r in rows:
        if r.seq_no is None:
            assert (r.place, r.start, r.n_tokens, r.piece) == (None, None, 0, 0) and (sizes[r.id] or 0) <= 0
            continue
        whole.setdefault(r.id, []).append((r.piece, r.n_tokens))
        filled.setdefault(r.seq_no, []).append((r.place, r.start, r.n_tokens))
    for i, n in enumerate(sizes):
        n = max(n or 0, 0)
        parts = [p for _, p in sorted(whole.get(i, []))]
        assert sum(parts) == n and [k for k, _ in sorted(whole.get(i, []))] == list(range(-(-n // capacity)))
        assert all(p == capacity for p in parts[:-1])
    for parts in filled.values():
        at = 0
        for place, (p, start, n) in enumerate(sorted(parts), 1):
            assert p == place and start == at
            at += n
        assert at <= capacity
    return len(filled), sum(max(s or 0, 0) for s in sizes)


def test_packing_is_sound_and_tight(spark):
    r = np.random.default_rng(4)
    sizes = [int(x) for x in np.concatenate([r.integers(0, 40, 3000), r.integers(13, 101, 800), r.integers(100, 900, 40)])] + [0, None, -3, 100, 1]
    used, total = check(spark, sizes, 100)
    assert used <= 1.01 * np.ceil(total / 100)


@pytest.mark.parametrize("sizes", [[], [5], [100], [101], [0, None], [51] * 37, [7] * 400, [100, 1] * 20])
def test_packing_of_odd_inputs(spark, sizes):
    used, total = check(spark, sizes, 100)
    assert used <= max(1.0, 2 * np.ceil(total / 100)) if total else used == 0


def test_token_counts_are_whole(spark):
    long = "a stone kerb, " * 20_000 + "x" * 5000
    rows = {r.id: r.n_tokens for r in P.token_counts(spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (4, long), (5, "<|endoftext|>")], "k bigint, t string"), "k", "t").collect()}
    assert rows[1] == 2 and rows[2] == rows[3] == 0 and rows[4] > 80_000 and rows[5] > 1


def test_the_vocabulary_is_a_setting(spark, tmp_path):
    import base64

    few = tmp_path / "bytes.tiktoken"
    few.write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    spark.conf.set("stepfree.tokenizer", str(few))
    try:
        (row,) = P.token_counts(spark.createDataFrame([(1, "one two")], "k bigint, t string"), "k", "t").collect()
    finally:
        spark.conf.unset("stepfree.tokenizer")
    assert row.n_tokens == 7
