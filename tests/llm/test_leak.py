import random

import numpy as np
import pytest

from stepfree.llm import leak as L

WORDS = [f"w{i}" for i in range(400)]


def item(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def test_words_whatever_their_dress():
    plain = "La rampa de Yarko mantém 42 degraus".split()
    want = L.words(" ".join(plain))
    dressed = [
        "LA <b>Rampa</b>, de&nbsp;Yarko<br/>mant&eacute;m 42 degraus!", "La ram­pa de Yar​ko manté́m 42 degraus".replace("é́", "é"), "La rampa de Yar-\n> ko mantém 42 degraus",
        'La\\nrampa de Yarko mant\\u00e9m "42" degraus', "Lа rаmpа de Yаrko mаntém 42 degrаus", "Ｌａ rampa de Yarko mantém ４２ degraus", "La rampa de Yarko mantem 42 degraus",
    ]
    for text in dressed:
        assert L.words(text) == want, text
    assert L.words(None) == L.words("") == L.words(" <br/> ") == []


def damaged(r, said):
    """One word in eight changed, added or misspelled."""
    out = list(said)
    for at in sorted(r.sample(range(len(out)), len(out) // 8), reverse=True):
        kind = r.random()
        if kind < 0.4:
            out[at] = "other" + str(r.random())[2:6]
        elif kind < 0.7:
            out.insert(at, "added")
        else:
            out[at] = out[at][1:] + out[at][:1]
    return out


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(5)
    stock = "read the passage below and answer the question using only the facts that are given in it".split()
    items = {i: (stock if i % 3 == 0 else []) + item(r, 40 + i % 50) for i in range(60)}
    items[100] = item(r, 9)
    docs, want, number = [], set(), 0

    def add(said, leaks):
        nonlocal number
        number += 1
        around = [item(r, r.randrange(0, 30)) for _ in range(2)]
        docs.append((number, " ".join(around[0] + said + around[1])))
        want.update((number, i) for i in leaks)

    for i in range(60):
        own = items[i][17:] if i % 3 == 0 else items[i]
        add(items[i], [i])
        add(damaged(r, own), [i])
        at = r.randrange(0, len(own) - 18) if len(own) > 18 else 0
        add(damaged(r, own[at : at + 18]), [i])
        add(own[: 10] + item(r, 60) + own[10:20], [i])
        add(own[at : at + 11], [])
        mixed = own[:]
        r.shuffle(mixed)
        add(mixed, [])
    add(items[100], [100])
    add(items[100][:5], [])
    add(stock * 3, [])
    docs += [(9001, None), (9002, ""), (9003, "  "), (9004, docs[0][1])]
    want.add((9004, 0))
    d = spark.createDataFrame(docs, "k bigint, t string").repartition(3)
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(500, None), (501, ""), (502, " ".join(stock))], "k bigint, t string")
    return d, e, want


@pytest.mark.parametrize("block", [10_000_000, 4000])
def test_leaks_are_found_in_one_or_many_blocks(world, block):
    d, e, want = world
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d, "k", "t", e, "k", "t", block).collect()}
    assert got == want


def test_empty_tables(world):
    d, e, _ = world
    assert L.leaked_items(d.limit(0), "k", "t", e, "k", "t").count() == 0
    assert L.leaked_items(d, "k", "t", e.limit(0), "k", "t").count() == 0


def test_nine_words_with_one_changed_share_a_seed():
    for hole in range(9):
        clean = np.arange(9)
        bent = clean.copy()
        bent[hole] = 99
        assert any(
            (clean[[s + i for i, c in enumerate(m) if c == "1"]] == bent[[s + i for i, c in enumerate(m) if c == "1"]]).all() for m in L.MASKS for s in range(9 - len(m) + 1)
        ), hole


HASHES = L.WordHashes()


def block_of(*said, marks=()):
    return L.ItemBlock.of([(i, HASHES.of(w).tobytes(), list(marks)) for i, w in enumerate(said)])


def search(block, *texts):
    return L._search(block, block.index(), [HASHES.of(t) for t in texts])


def test_one_letter_runs_and_long_texts():
    said = [f"w{i}" for i in range(30)]
    (hit,) = [h for h in search(block_of(said), ["w1"] * 5000 + said + ["x"] * 50_000) if L.enough(h[2], 30)]
    assert hit[:3] == (0, 0, 30)


def test_a_text_that_repeats_the_item_all_over():
    said = [f"w{i}" for i in range(40)]
    (hit,) = [h for h in search(block_of(said), said * 5000) if L.enough(h[2], 40)]
    assert hit == (0, 0, 40)


def plain_chain(item, text):
    """The best score by the definition, without blocks."""
    n, m = len(item), len(text)
    best = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = [0, best[i - 1, j] - L._GAP, best[i, j - 1] - L._GAP, best[i - 1, j - 1] + (1 if item[i - 1] == text[j - 1] else -L._GAP)]
            if item[i - 1] == text[j - 1]:
                ways.append(best[:i, :j].max() - L._JUMP + 1)
            best[i, j] = max(ways)
    return best.max()


@pytest.mark.parametrize("cells", [1, 4_000_000])
def test_chains_are_the_best_ones(monkeypatch, cells):
    monkeypatch.setattr(L, "_CELLS", cells)
    r = random.Random(7)
    for _ in range(60):
        said = item(r, r.randrange(5, 40))
        text = []
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(0, len(said))
            text += item(r, r.randrange(0, 9)) + damaged(r, said[at : at + r.randrange(3, 20)])
        a, b = HASHES.of(said), HASHES.of(text)
        chain = L.chained(a, b)
        score = plain_chain(a.tolist(), b.tolist()) if len(b) else 0
        assert bool(chain) == (score >= 4 and len(b) >= 5), (chain, score)
        flat = [p for s, _ in chain for p in s], [q for _, t in chain for q in t]
        assert all(list(x) == sorted(set(x)) for x in flat) and all(a[p] == b[q] for p, q in zip(*flat))
        if chain:  # what the chain earns, by its matches, gaps and jumps
            earned = sum(len(s) for s, _ in chain) - L._JUMP * (len(chain) - 1)
            for s, t in chain:
                earned -= L._GAP * sum(max(q - p - 1, v - u - 1) for p, q, u, v in zip(s, s[1:], t, t[1:]))
            assert earned == score


def test_passages_in_any_number_of_parts():
    r = random.Random(3)
    said = [f"p{i}" for i in range(40)]
    for size in (20, 10, 8, 5):
        text = item(r, 30)
        for at in range(0, 40, size):
            text += said[at : at + size] + item(r, 25)
        (hit,) = search(block_of(said), text)
        assert hit[2] == 40, size


def test_a_thousand_words_in_many_parts():
    r = random.Random(4)
    said = [f"q{i}" for i in range(1000)]
    text = []
    for at in range(0, 1000, 10):
        text += said[at : at + 10] + item(r, 12)
    (hit,) = search(block_of(said), text)
    assert hit[2] == 1000


@pytest.mark.parametrize("copies", [3, 10])
def test_copies_of_an_item_are_no_stock(spark, copies):
    r = random.Random(9)
    said, other = item(r, 40), item(r, 40)
    rows = [(i, " ".join(said).upper() if i % 2 else " ".join(said)) for i in range(copies)] + [(100, " ".join(other))]
    docs = spark.createDataFrame([(1, "it says " + " ".join(said)), (2, " ".join(other)), (3, " ".join(item(r, 60)))], "k bigint, t string")
    got = {(x.doc_id, x.item_id) for x in L.leaked_items(docs, "k", "t", spark.createDataFrame(rows, "k bigint, t string"), "k", "t").collect()}
    assert got == {(1, i) for i in range(copies)} | {(2, 100)}


def test_odd_columns_and_rows(spark):
    said = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("a", said, 1, "x"), ("b", None, 2, "y"), ("a", said, 3, "z"), (None, said, 4, "z")], "doc_id string, text string, id int, tokens string")
    items = spark.createDataFrame([("i", said, 1), (None, said, 2), ("j", None, 3), ("j", "", 4)], "item_id string, text string, words int")
    got = sorted((x.doc_id or "", x.item_id) for x in L.leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [("", "i"), ("a", "i"), ("a", "i")]
