"""Train the mention tagger: OMP_NUM_THREADS=1 python -m stepfree.llm.pii_train DOCUMENTS... --held-out FILE

Nearly half of the training windows are made up (`pii_make`), with mentions and wording
drawn at random; the others come from at most `MOST_TEXTS` texts of the given
Parquet files, labelled by the frames of `pii_labels`, where some mentions are
exchanged for made-up ones. The held-out file only measures. Gradients of several
processes are averaged, so a step sees `WORKERS` times `BATCH` windows.
"""

from __future__ import annotations

import argparse
import multiprocessing as mp
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.parquet as pq

from stepfree.llm.pii_labels import KINDS, labelled_spans
from stepfree.llm.pii_make import Maker
from stepfree.llm.pii_model import PAD, TAGS, Tagger, descend, encode, fit, tag_texts

MOST_TEXTS = 14_000
HIDDEN = 40
LENGTH = 160
BATCH = 96
WORKERS = 8
MADE_SHARE = 0.35
#: Added to the score of beginning a name after training: a name missed is worse than one too many.
NAME_LEAN = 0.8

Spans = list[tuple[int, int, str]]


def read_texts(path: str, most: int) -> list[tuple[str, str]]:
    rows = pq.read_table(path, columns=["text", "lang"]).slice(0, most).to_pylist()
    return [(r["text"], r["lang"] or "") for r in rows if r["text"]]


def tag_array(length: int, spans: Spans) -> np.ndarray:
    out = np.zeros(length, np.int8)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        out[a] = 1 + 2 * k
        out[a + 1 : b] = 2 + 2 * k
    return out


def exchanged(maker: Maker, text: str, spans: Spans, lang: str) -> tuple[str, Spans]:
    """The text with some mentions exchanged for a made-up one of its kind."""
    parts, out, last, at = [], [], 0, 0
    for a, b, kind in spans:
        said = maker.mention(kind, lang) if maker.p(0.4) else text[a:b]
        parts += [text[last:a], said]
        at += a - last
        out.append((at, at + len(said), kind))
        at, last = at + len(said), b
    return "".join([*parts, text[last:]]), out


def carriers_of(labelled: list[tuple[str, Spans, str]]) -> list[tuple[str, str]]:
    """(language, text) of lines without a mention, to plant mentions in."""
    out = []
    for text, spans, lang in labelled:
        if not spans and 60 <= len(text):
            out += [(lang, line.strip()) for line in text[:2000].split("\n") if len(line) > 40]
    return out


def batches(labelled: list[tuple[str, Spans, str]], seed: int = 11, made: float = MADE_SHARE, parts: list[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of made-up texts, and of labelled ones: around mentions (three quarters) and anywhere."""
    maker = Maker(seed, [t for t, s, _ in labelled if not s][:2000], parts)
    r = maker.r
    carriers = carriers_of(labelled)
    marks = [(i, j) for i, (_, s, _) in enumerate(labelled) for j in range(len(s))]
    sizes = np.array([len(t) for t, _, _ in labelled], float)
    share = sizes / sizes.sum()
    while True:
        x, y = np.full((LENGTH, BATCH), PAD, np.int16), np.zeros((LENGTH, BATCH), np.int8)
        anywhere = r.choice(len(labelled), BATCH, p=share)
        for j in range(BATCH):
            if r.random() < made:
                text, spans = maker.text(carriers)
                a = spans[int(r.integers(len(spans)))][0] if spans else 0
                at = int(r.integers(a - LENGTH + 8, a + 8))
            elif r.random() < 0.75 and marks:
                i, n = marks[r.integers(len(marks))]
                text, spans, lang = labelled[i]
                a = spans[n][0]
                low = max(0, a - 2 * LENGTH)
                text, spans = text[low : a + 2 * LENGTH], [(s - low, e - low, k) for s, e, k in spans if s >= low and e <= a + 2 * LENGTH]
                cut = len(text)
                text, spans = exchanged(maker, text[:cut], spans, lang)
                a = min((s for s, _, _ in spans), key=lambda s, want=a - low: abs(s - want), default=0)
                at = int(r.integers(a - LENGTH + 8, a + 8))
            else:
                text, spans, _ = labelled[int(anywhere[j])]
                at = int(r.integers(-16, max(1, len(text) - LENGTH // 2)))
                low = max(0, at - LENGTH)
                text, spans, at = text[low : at + 2 * LENGTH], [(max(0, s - low), e - low, k) for s, e, k in spans if e > low and s < at + 2 * LENGTH], at - low
            at = max(0, min(at, len(text) - 1))
            tags = tag_array(len(text), [(s, min(e, len(text)), k) for s, e, k in spans])[at : at + LENGTH]
            part = encode(text)[at : at + LENGTH]
            x[: len(part), j] = part
            y[: len(part), j] = tags
        yield x, y


def counts(got: list[Spans], gold: list[Spans]) -> dict[str, tuple[float, float]]:
    """(precision, recall) of exact spans by kind."""
    hit, said, true = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for a, b in zip(got, gold):
        wanted = set(b)
        for s in a:
            said[s[2]] += 1
            hit[s[2]] += s in wanted
        for s in wanted:
            true[s[2]] += 1
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, true[k])) for k in KINDS}


def measure(model: Tagger, texts: list[str]) -> dict[str, tuple[float, float]]:
    """(precision, recall) of exact spans by kind against the frames' labels."""
    return counts(tag_texts(model, texts), [labelled_spans(t) for t in texts])


_SOURCE: Iterator[tuple[np.ndarray, np.ndarray]] | None = None


def _ready(labelled: list, parts: list[str] | None, number, shift: int) -> None:  # noqa: ANN001
    global _SOURCE
    with number.get_lock():
        number.value += 1
        seed = number.value + shift
    _SOURCE = batches(labelled, 100 + seed, parts=parts)


def _slope(params: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    return Tagger(params).gradients(*next(_SOURCE))


def train(
    texts: list[tuple[str, str]], steps: int, hidden: int = HIDDEN, report: Callable[[int, float], None] | None = None, workers: int = 1, parts: list[str] | None = None,
    start: Tagger | None = None,
) -> Tagger:
    lang = lambda x: x.strip().lower()[:2] if x.strip().lower()[:2] in ("en", "pt", "es") else "en"
    labelled = [(t, labelled_spans(t), lang(tongue)) for t, tongue in texts]
    assert len(TAGS) == 1 + 2 * len(KINDS)
    model, rate = (start, 2.5e-3) if start else (Tagger.fresh(hidden), 6e-3)
    if workers == 1:
        return fit(model, batches(labelled, parts=parts), steps, rate, report)
    context = mp.get_context("fork")
    with context.Pool(workers, _ready, (labelled, parts, context.Value("i", 0), 1000 if start else 0)) as pool:

        def slope(m: Tagger) -> tuple[float, dict[str, np.ndarray]]:
            done = pool.map(_slope, [m.p] * workers, chunksize=1)
            return float(np.mean([d[0] for d in done])), {n: np.mean([d[1][n] for d in done], axis=0) for n in m.p}

        return descend(model, slope, steps, rate, report)


def main() -> None:
    cli = argparse.ArgumentParser()
    cli.add_argument("documents", nargs="+")
    cli.add_argument("--held-out")
    cli.add_argument("--name-parts", help="Parquet file with a column token")
    cli.add_argument("--steps", type=int, default=2500)
    cli.add_argument("--hidden", type=int, default=HIDDEN)
    cli.add_argument("--go-on", action="store_true", help="start from the stored weights, at a lower rate")
    args = cli.parse_args()
    began = time.time()
    texts = [t for p in args.documents for t in read_texts(p, MOST_TEXTS // len(args.documents))]
    parts = pq.read_table(args.name_parts, columns=["token"]).column(0).to_pylist() if args.name_parts else None
    model = train(texts, args.steps, args.hidden, lambda s, v: print(f"{s} {v:.5f} {time.time() - began:.0f}s", flush=True), WORKERS, parts, Tagger.load() if args.go_on else None)
    model.p["E"][1 + KINDS.index("name")] += NAME_LEAN
    model.save()
    if args.held_out:
        print(measure(Tagger.load(), [t for t, _ in read_texts(args.held_out, 1500)]))


if __name__ == "__main__":
    main()
