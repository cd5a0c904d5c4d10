"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Tags are O and begin/inside of each kind of mention. Characters are classes
(letter, case, accent, digit, sign), so that every alphabet variant of one letter
shares what is learned and the input layer is a table lookup.

Inside a mention follows its begin or inside tag only; every other transition is
the sum of a score of the tag left and one of the tag entered. The best way into
O or a begin tag is then one maximum for all of them, so decoding needs 21 sums a
character instead of 121.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np

from stepfree.llm.pii_labels import KINDS

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW = 640
OVERLAP = 64
_CLOSED = -1e4
_SIGNS = " .,;:@()[]<>-_/+&#%'\"!?=|*{}°º\n"


def _char_classes() -> tuple[np.ndarray, int]:
    size = 0x250
    table = np.zeros(size + 1, np.int16)
    signs = {c: 1 + i for i, c in enumerate(_SIGNS)}
    digits = 1 + len(_SIGNS)
    letters = digits + 10
    other_letter = letters + 26 * 4
    for code in range(size):
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        if c in signs:
            table[code] = signs[c]
        elif c.isdigit():
            table[code] = digits + int(unicodedata.digit(c, 0))
        elif "a" <= base <= "z" and len(base) == 1:
            table[code] = letters + (ord(base) - 97) * 4 + 2 * c.isupper() + (ord(c) > 127)
        elif c.isspace():
            table[code] = signs[" "]
        elif c.isalpha():
            table[code] = other_letter
    table[size] = other_letter + 1
    return table, other_letter + 3


_TABLE, CLASSES = _char_classes()
PAD = CLASSES - 1


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    np.add(x, 0.5, out=x)
    return x


class Tagger:
    """Parameters: per direction an input table P, recurrent weights U and bias in
    P; the output layer O, bias c; transition scores of leaving a tag (L), of
    entering O or a begin tag (E), and of going on inside (G: from begin, from inside)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.hidden = params["U0"].shape[0]

    @classmethod
    def fresh(cls, hidden: int, seed: int = 3) -> Tagger:
        r = np.random.default_rng(seed)
        k, h = len(TAGS), hidden
        p: dict[str, np.ndarray] = {}
        for d in "01":
            p["P" + d] = r.normal(0, 0.3, (CLASSES, 4 * h))
            p["P" + d][:, h : 2 * h] += 1.0
            p["U" + d] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        kinds = len(KINDS)
        p |= {"O": r.normal(0, 0.2, (2 * h, k)), "c": np.zeros(k), "L": np.zeros(k), "E": np.zeros(1 + kinds), "G": np.zeros((2, kinds))}
        return cls({n: v.astype(np.float32) for n, v in p.items()})

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Tagger:
        with np.load(path) as stored:
            return cls({n: stored[n].astype(np.float32) for n in stored.files})

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{n: v.astype(np.float16) for n, v in self.p.items()})

    # --- forward -------------------------------------------------------------

    def transitions(self) -> np.ndarray:
        """(from, to) scores; `_CLOSED` where a tag cannot follow."""
        p, k = self.p, len(TAGS)
        out = np.full((k, k), _CLOSED, p["L"].dtype)
        out[:, 0] = p["L"] + p["E"][0]
        out[:, 1::2] = p["L"][:, None] + p["E"][None, 1:]
        begin = np.arange(1, k, 2)
        out[begin, begin + 1], out[begin + 1, begin + 1] = p["G"][0], p["G"][1]
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, tags, B) scores of windows x (T, B). Both directions step together;
        states and cells are kept doubled and the halves are in the weights, so the
        logistic function costs one tanh and one addition."""
        steps, b = x.shape
        h, k = self.hidden, len(TAGS)
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5
        tables = [np.ascontiguousarray(self.p["P" + d] * half, np.float32) for d in "01"]
        u = np.ascontiguousarray(np.stack([self.p["U" + d] * half for d in "01"]) * 0.5, np.float32)
        o = np.ascontiguousarray(np.stack([self.p["O"][:h], self.p["O"][h:]]) * 0.5, np.float32)
        out = np.empty((steps, b, k), np.float32)
        out[:] = self.p["c"].astype(np.float32)
        z, g = np.empty((2, b, 4 * h), np.float32), np.empty((2, b, 4 * h), np.float32)
        state, cell, part = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32), np.empty((2, b, h), np.float32)
        e = np.empty((2, b, k), np.float32)
        x = x.astype(np.intp)
        for t in range(steps):
            r = steps - 1 - t
            np.matmul(state, u, out=z)
            np.take(tables[0], x[t], axis=0, out=g[0], mode="clip")
            np.take(tables[1], x[r], axis=0, out=g[1], mode="clip")
            z += g
            np.tanh(z, out=z)
            z[:, :, : 3 * h] += 1.0
            cell *= z[:, :, h : 2 * h]
            cell *= 0.5
            np.multiply(z[:, :, :h], z[:, :, 3 * h :], out=part)
            cell += part
            np.multiply(cell, 0.5, out=part)
            np.tanh(part, out=state)
            state *= z[:, :, 2 * h : 3 * h]
            np.matmul(state, o, out=e)
            out[t] += e[0]
            out[r] += e[1]
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (T, B) of windows x (T, B) under emissions and transitions."""
        e, p = self.emissions(x), self.p
        steps, _, b = e.shape
        leave, enter = p["L"].astype(np.float32)[:, None], p["E"].astype(np.float32)[:, None]
        go = p["G"].astype(np.float32)[:, :, None]
        best = e[0].copy()
        came, stayed = np.zeros((steps, b), np.int8), np.zeros((steps, len(KINDS), b), bool)
        for t in range(1, steps):
            left = best + leave
            came[t] = left.argmax(axis=0)
            most = left.max(axis=0)
            begun, inside = best[1::2] + go[0], best[2::2] + go[1]
            np.greater(inside, begun, out=stayed[t])
            best = e[t]
            best[0] += most + enter[0]
            best[1::2] += most + enter[1:]
            best[2::2] += np.maximum(begun, inside)
        tags = np.empty((steps, b), np.int8)
        now, rows = best.argmax(axis=0), np.arange(b)
        tags[-1] = now
        for t in range(steps - 1, 0, -1):
            within = (now > 0) & (now % 2 == 0)
            kind = np.maximum(now - 2, 0) // 2
            now = np.where(within, np.where(stayed[t, kind, rows], now, now - 1), came[t])
            tags[t - 1] = now
        return tags

    # --- training ------------------------------------------------------------

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per character of tags y (T, B), and its gradients."""
        h, p = self.hidden, self.p
        steps, b = x.shape
        xs = np.stack([x, x[::-1]], axis=1).astype(np.intp)
        u = np.stack([p["U0"], p["U1"]])
        kind = u.dtype
        gates, cells, states = np.empty((steps, 2, b, 4 * h), kind), np.empty((steps, 2, b, h), kind), np.empty((steps, 2, b, h), kind)
        state, cell = np.zeros((2, b, h), kind), np.zeros((2, b, h), kind)
        for t in range(steps):
            z = np.matmul(state, u, out=gates[t])
            z[0] += p["P0"][xs[t, 0]]
            z[1] += p["P1"][xs[t, 1]]
            _sigmoid(z[:, :, : 3 * h])
            np.tanh(z[:, :, 3 * h :], out=z[:, :, 3 * h :])
            cell = cell * z[:, :, h : 2 * h]
            cell += z[:, :, :h] * z[:, :, 3 * h :]
            cells[t] = cell
            state = np.tanh(cell, out=states[t])
            state *= z[:, :, 2 * h : 3 * h]
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        e = both @ p["O"] + p["c"]
        loss, de, da = _crf(e, self.transitions(), y)
        begin = np.arange(1, len(TAGS), 2)
        scale = 1.0 / (steps * b)
        de *= scale
        free = da[:, [0, *begin]] * scale
        grads = {
            "L": free.sum(axis=1), "E": free.sum(axis=0), "G": np.stack([da[begin, begin + 1], da[begin + 1, begin + 1]]) * scale,
            "O": both.reshape(-1, 2 * h).T @ de.reshape(-1, de.shape[2]), "c": de.sum(axis=(0, 1)),
        }
        dh = de @ p["O"].T
        dhs = np.stack([dh[:, :, :h], dh[::-1, :, h:]], axis=1)
        dz_all, back = np.empty_like(gates), np.ascontiguousarray(u.transpose(0, 2, 1))
        next_dh, next_dc = np.zeros((2, b, h), kind), np.zeros((2, b, h), kind)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (gates[t][:, :, j * h : (j + 1) * h] for j in range(4))
            tc = np.tanh(cells[t])
            next_dh += dhs[t]
            dz = dz_all[t]
            dc = next_dh * o
            dc *= 1 - tc * tc
            dc += next_dc
            dz[:, :, :h] = dc * g * i * (1 - i)
            dz[:, :, h : 2 * h] = dc * cells[t - 1] * f * (1 - f) if t else 0.0
            dz[:, :, 2 * h : 3 * h] = next_dh * tc * o * (1 - o)
            dz[:, :, 3 * h :] = dc * i * (1 - g * g)
            next_dc = dc * f
            next_dh = dz @ back
        for d in range(2):
            flat, said = dz_all[:, d].reshape(-1, 4 * h), xs[:, d].reshape(-1)
            grads[f"U{d}"] = states[:-1, d].reshape(-1, h).T @ dz_all[1:, d].reshape(-1, 4 * h)
            order = np.argsort(said, kind="stable")
            there, first = np.unique(said[order], return_index=True)
            grads[f"P{d}"] = np.zeros_like(p[f"P{d}"])
            grads[f"P{d}"][there] = np.add.reduceat(flat[order], first, axis=0)
        return loss * scale, grads


def _crf(e: np.ndarray, a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed negative log likelihood, its gradient by emissions and by transitions."""
    steps, b, k = e.shape
    top = e.max(axis=2, keepdims=True)
    ex = np.exp(e - top)
    m = np.exp(a)
    alpha, norm = np.empty_like(ex), np.empty((steps, b, 1), np.float32)
    alpha[0] = ex[0]
    for t in range(steps):
        if t:
            alpha[t] = (alpha[t - 1] @ m) * ex[t]
        norm[t] = alpha[t].sum(axis=1, keepdims=True)
        alpha[t] /= norm[t]
    beta = np.ones((b, k), np.float32)
    de, pairs = np.empty_like(e), np.zeros((k, k), np.float32)
    for t in range(steps - 1, -1, -1):
        de[t] = alpha[t] * beta
        if t:
            right = ex[t] * beta / norm[t]
            pairs += (alpha[t - 1].T @ right) * m
            beta = right @ m.T
    rows = np.arange(b)
    at = np.arange(steps)[:, None]
    gold = float(e[at, rows[None], y].sum()) + float(a[y[:-1], y[1:]].sum())
    loss = float(np.log(norm).sum() + top.sum()) - gold
    de[at, rows[None], y] -= 1.0
    np.subtract.at(pairs, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1.0)
    return loss, de, pairs


def fit(model: Tagger, batches: Iterator[tuple[np.ndarray, np.ndarray]], steps: int, rate: float = 6e-3, report: Callable[[int, float], None] | None = None) -> Tagger:
    """Adam on one batch a step."""
    return descend(model, lambda m: m.gradients(*next(batches)), steps, rate, report)


def descend(
    model: Tagger, slope: Callable[[Tagger], tuple[float, dict[str, np.ndarray]]], steps: int, rate: float = 6e-3, report: Callable[[int, float], None] | None = None
) -> Tagger:
    """Adam with warm-up, linear decay and clipped gradients."""
    first = {n: np.zeros_like(v) for n, v in model.p.items()}
    second = {n: np.zeros_like(v) for n, v in model.p.items()}
    mean = 0.0
    for step in range(1, steps + 1):
        loss, grads = slope(model)
        length = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 0.5 / (length + 1e-12))
        now = rate * min(1.0, step / 50) * max(0.02, 1 - step / steps)
        for n, g in grads.items():
            g = g * shrink
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.002 * (g * g - second[n])
            model.p[n] -= (now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        mean = loss if step == 1 else 0.98 * mean + 0.02 * loss
        if report and step % 100 == 0:
            report(step, mean)
    return model


# --- whole texts -------------------------------------------------------------------


def _windows(lengths: Iterable[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of overlapping windows that cover every text."""
    text, start, stop = [], [], []
    for i, n in enumerate(lengths):
        at = 0
        while n:
            end = min(at + WINDOW, n)
            text.append(i)
            start.append(at)
            stop.append(end)
            if end == n:
                break
            at += WINDOW - OVERLAP
    return np.array(text, np.int64), np.array(start, np.int64), np.array(stop, np.int64)


def tag_texts(model: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the mentions in each whole text.

    Texts are cut into overlapping windows, each is decoded, and where two windows
    overlap the seam is laid at the place nearest the middle of the overlap where
    both say "no mention" (or at least the same tag), so no mention is cut by a
    window's edge. Spans are then read off the joined tags of the whole text.
    """
    codes = [encode(t) for t in texts]
    base = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    flat = np.concatenate([*codes, np.zeros(0, np.int16)])
    doc, start, stop = _windows(len(c) for c in codes)
    tags = np.zeros(len(flat), np.int8)
    order = np.argsort(stop - start, kind="stable")
    width = OVERLAP
    heads, tails = np.full((len(doc), width), -1, np.int8), np.full((len(doc), width), -2, np.int8)
    kept = np.zeros((len(doc), WINDOW), np.int8)
    for s in range(0, len(order), batch):
        w = order[s : s + batch]
        size = stop[w] - start[w]
        steps = int(size.max())
        at = base[doc[w]][None, :] + start[w][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < size[None, :]
        x = np.where(inside, flat[np.minimum(at, len(flat) - 1)], PAD)
        kept[w, :steps] = np.where(inside, model.decode(x), 0).T
    more = np.nonzero(doc[1:] == doc[:-1])[0] if len(doc) else np.zeros(0, np.int64)
    step = WINDOW - OVERLAP
    heads[more + 1] = kept[more + 1, :width]
    tails[more] = kept[more, step : step + width]
    same = tails[more] == heads[more + 1]
    good = (same & (tails[more] == 0)) * 2 + same
    central = 1.0 - np.abs(np.arange(width) - width / 2) / width
    seam = np.argmax(good * 2 + central, axis=1)
    left, right = start.copy(), stop.copy()
    left[more + 1] = start[more + 1] + seam
    right[more] = start[more + 1] + seam
    for i in range(len(doc)):
        tags[base[doc[i]] + left[i] : base[doc[i]] + right[i]] = kept[i, left[i] - start[i] : right[i] - start[i]]
    return [_spans(tags[base[i] : base[i + 1]]) for i in range(len(texts))]


def _spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of one kind; a begin tag opens a new run."""
    hot = np.nonzero(tags)[0]
    if not len(hot):
        return []
    kind = (tags[hot] - 1) // 2
    opens = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(kind) != 0) | (tags[hot[1:]] % 2 == 1)])
    firsts = np.nonzero(opens)[0]
    lasts = np.concatenate([firsts[1:] - 1, [len(hot) - 1]])
    return [(int(hot[a]), int(hot[b]) + 1, KINDS[int(kind[a])]) for a, b in zip(firsts, lasts)]
