import itertools
import sys

import numpy as np
import pytest

from stepfree.llm import pii, pii_model
from stepfree.llm.pii_labels import KINDS, labelled_spans
from stepfree.llm.pii_model import TAGS, Tagger
from stepfree.llm.pii_make import Maker
from stepfree.llm.pii_train import counts, measure, read_texts, train

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from pii_sentences import labelled  # noqa: E402

TEXTS = [
    "Contact: Brenja S. Merotano <brenja.merotano+routes @ uni.example> about the kerb.",
    "Meu nome é Lámgasa Holbrezar e moro na Rua Veldunek, 1305. Tel.: +55 (60) 95571-3083 / e-mail: lamgasa@rede.test",
    "La vecina Sardaja Stenlin, de Plaza Merbredra, 1321, dejó el número 000-069-555.",
    "Ms Uloja Jorlivald (ID 666-68-4147) asked for a copy of the survey.",
    "The meter box with serial 2758/9627/27 stands at House numbers 7 to 531 on Stenlimar Road. Follow @yarmar_works.",
]


@pytest.fixture(scope="module")
def model():
    return Tagger.load()


def found(model, text):
    return {(k, text[a:b]) for a, b, k in pii._mentions(model, [text])[0]}


def test_mentions_of_each_kind(model):
    assert found(model, TEXTS[0]) == {("name", "Brenja S. Merotano"), ("email", "brenja.merotano+routes @ uni.example")}
    assert found(model, TEXTS[1]) == {("name", "Lámgasa Holbrezar"), ("address", "Rua Veldunek, 1305"), ("phone", "+55 (60) 95571-3083"), ("email", "lamgasa@rede.test")}
    assert found(model, TEXTS[2]) == {("name", "Sardaja Stenlin"), ("address", "Plaza Merbredra, 1321"), ("phone", "000-069-555")}
    assert found(model, TEXTS[3]) == {("name", "Uloja Jorlivald"), ("identity", "666-68-4147")}
    assert found(model, TEXTS[4]) == set()


def test_held_out_accuracy(model):
    """Texts of another scale; about half of them are in the training files too (README has figures for texts that are not)."""
    scores = measure(model, [t for t, _ in read_texts("/root/testdata/sf0.01/documents.parquet", 1000)])
    for kind, (precision, recall) in scores.items():
        assert precision > 0.93 and recall > 0.93, (kind, precision, recall)


def test_sentences_written_by_hand(model):
    """Sentences that share no wording with anything the tagger is trained on."""
    rows = labelled()
    scores = counts(pii._mentions(model, [t for t, _ in rows]), [s for _, s in rows])
    assert len(rows) >= 200
    for kind, (precision, recall) in scores.items():
        assert precision >= 0.9 and recall >= 0.9, (kind, precision, recall)


def test_made_up_texts_have_sound_spans():
    maker = Maker(4, ["the kerb is high and the lamp is dark"])
    for _ in range(200):
        text, spans = maker.text([("en", "A lamp stands in the middle of the footway and nobody moves it.")])
        assert all(0 <= a < b <= len(text) and k in KINDS and text[a:b].strip() for a, b, k in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_decoding_is_the_best_path(model):
    r = np.random.default_rng(2)
    x = r.integers(0, pii_model.CLASSES, (4, 5)).astype(np.int16)
    e, a = model.emissions(x), model.transitions()
    got = model.decode(x)
    for j in range(5):
        best, want = -1e9, None
        for path in itertools.product(range(len(TAGS)), repeat=4):
            score = sum(e[t, k, j] for t, k in enumerate(path)) + sum(a[p, q] for p, q in zip(path, path[1:]))
            if score > best:
                best, want = score, path
        assert tuple(got[:, j]) == want


def test_equal_texts_are_tagged_once(spark, model):
    rows = [(i, TEXTS[0]) for i in range(300)] + [(900, TEXTS[1])]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(4)
    assert pii._different(df, "k", "t")[1].count() == 2
    assert pii.tag_mentions(df, "k", "t", model).where("doc_id < 900").count() == 600


def test_training_from_labelled_spans_learns():
    texts = read_texts("/root/testdata/sf0.001/documents.parquet", 80)
    losses = []
    train(texts, 200, hidden=12, report=lambda step, loss: losses.append(loss))
    assert losses[-1] < 0.5 * losses[0]


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    m = Tagger.fresh(5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    for n in "LEG":
        m.p[n] += r.normal(0, 0.3, m.p[n].shape)
    x, y = r.integers(0, pii_model.CLASSES, (6, 3)), np.array([[1, 0, 4], [2, 3, 4], [2, 4, 0], [0, 5, 1], [1, 0, 2], [2, 7, 2]])
    _, grads = m.gradients(x, y)
    for name, at in {"L": (2,), "E": (1,), "G": (0, 0), "O": (3, 4), "c": (2,), "U0": (1, 7), "U1": (2, 3), "P0": (x[3, 1], 4), "P1": (x[3, 1], 9)}.items():
        keep = m.p[name][at]
        m.p[name][at] = keep + 2e-2
        up = m.gradients(x, y)[0]
        m.p[name][at] = keep - 2e-2
        down = m.gradients(x, y)[0]
        m.p[name][at] = keep
        assert abs((up - down) / 4e-2 - grads[name][at]) < 2e-4 + 0.03 * abs(grads[name][at])


def test_windows_are_reconciled(model):
    """A mention is found wherever windows begin and end."""
    for pad in (0, 250, 300, 318, 500, 3000):
        text = "kerb and lamp. " * (pad // 15) + "x" * (pad % 15) + " " + TEXTS[0] + " More of the same." * 40
        assert ("email", "brenja.merotano+routes @ uni.example") in found(model, text), pad


def test_odd_texts_and_placeholders(spark, model):
    rows = [(1, TEXTS[3]), (2, None), (3, ""), (4, "   \n"), (5, TEXTS[3]), (6, "\U0001f6b6 ́​" * 50), (7, "word " * 40_000 + TEXTS[1])]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(3)
    got = {}
    for r in pii.tag_mentions(df, "k", "t", model).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.mention))
        assert dict(rows)[r.doc_id][r.start : r.stop] == r.mention
    assert got[1] == got[5] and set(got) == {1, 5, 7} and len(got[7]) == 4
    clean = {r.doc_id: (r.redacted, r.n_mentions) for r in pii.redact(df, "k", "t", model).collect()}
    assert clean[1] == ("Ms [NAME] (ID [IDENTITY]) asked for a copy of the survey.", 2) and clean[2] == (None, 0) and clean[3] == ("", 0)
    assert pii.tag_mentions(df.limit(0), "k", "t", model).count() == 0


def test_labels_come_in_order_and_apart():
    for text in TEXTS:
        spans = labelled_spans(text)
        assert all(a < b and k in KINDS for a, b, k in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert labelled_spans("") == []
