"""Held-out passages inside training texts, by spaced-seed hashing.

Texts are reduced to words (mark-up, entities, case, punctuation, accents,
look-alike letters, soft hyphens and line-break hyphens are taken away) and words
to 64-bit hashes. A seed is a fixed mask over word positions; the masked-out
positions may differ. One pass over the texts keeps those that share a seed with
any test item (a bit map of all items' seeds, of fixed size, goes along). The
texts kept are joined with the items' seeds, block by block, and every text and
item that share seeds are aligned word by word around the hits.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.llm.pii import blocks_of, spread
from stepfree.session import cut

#: Word positions a seed reads (1) and ignores (0). Any 9 words with one of them
#: changed still agree on a seed.
MASKS = ("11111", "111011", "110111", "1101011")
#: Evidence asked for: this many words of the item in order, of which one in
#: `ONE_IN` may be changed.
PASSAGE_WORDS = 18
ONE_IN = 8
#: Runs of this many words found in this many items of different text are stock wording.
STOCK_WORDS = 6
STOCK_ITEMS = 3
#: Characters of items in one block: what a task and the driver hold at a time.
BLOCK_CHARS = 4_000_000
#: Characters of texts searched at once in a worker; bounds its memory, not what is read.
WORK_CHARS = 2_000_000
#: The map of all items' seeds has 2**MAP_BITS bits (8 MB), whatever the number of
#: items; a fuller map lets more texts through to the blocks and never loses one.
MAP_BITS = 26
_LEAST_SEGMENT = 5
_GAP = 2
#: What beginning another segment costs: it has to match more words than this.
_JUMP = 4
#: Cells of the alignment's table kept at a time; rows before are made again on the way back.
_CELLS = 4_000_000
_WORDS_KNOWN = 1_000_000

# fixed values: Cyrillic and Greek letters that look like Latin ones
_LOOKS = str.maketrans("авеекмнорстухіјѕԁһɡӏԛԝαβεικνορτυχ", "abeekmhopctyxijsdhglqwabeikvoptux")
_INLINE = regex.compile(r"</?(?:b|i|u|em|strong|span|a|mark|sub|sup|small|font|code)(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(r"<[!/]?[a-zA-Z][^<>]*>|<!--.*?-->", regex.S)
_ESCAPE = regex.compile(r"\\u([0-9a-fA-F]{4})")
_BROKEN = regex.compile(r"(\p{L})[-‐‑][ \t]*\r?\n[ \t>|*#]*(?=\p{Ll})")
_HIDDEN = regex.compile("[­​-‏⁠﻿͏]")
_SPACE_ESCAPE = regex.compile(r"\\[nrt]")
_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """The words of a text, whatever their dress; none for null."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "\\" in t:
        t = _SPACE_ESCAPE.sub(" ", _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), t))
    t = _BROKEN.sub(r"\1", _HIDDEN.sub("", t))
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = t.casefold()
    return _WORDS.findall(t if t.isascii() else t.translate(_LOOKS))


class WordHashes(dict):
    """Hashes of words, each computed once while it is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, said: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in said), np.uint64, len(said))


def _seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The seed of every position the mask fits at."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2) * 1469598103934665603 % 2**64, np.uint64)
    for o, c in enumerate(mask):
        if c == "1":
            h = (h ^ tokens[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _fair_seeds(tokens: np.ndarray, stock: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, positions) of an item; seeds that lie in stock wording as a whole are
    no evidence and are left out."""
    seeds = _seeds(tokens, mask)
    fine = np.zeros(len(seeds), bool)
    for o, c in enumerate(mask):
        if c == "1":
            fine |= ~stock[o : o + len(seeds)]
    return seeds[fine], np.flatnonzero(fine)


def _slots(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of each seed in the map."""
    most = np.uint64(2**MAP_BITS - 1)
    return seeds & most, (seeds >> np.uint64(64 - MAP_BITS)) & most


@dataclass
class ItemBlock:
    """Some test items as arrays: what a pass over the texts kept is joined with."""

    ids: list
    tokens: list[np.ndarray]
    stock: list[np.ndarray]
    masks: tuple[str, ...]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes, list[int]]], masks: tuple[str, ...] = MASKS) -> ItemBlock:
        tokens = [np.frombuffer(t, np.uint64) for _, t, _ in rows]
        return cls([r[0] for r in rows], tokens, [_flags(len(t), m) for t, (_, _, m) in zip(tokens, rows)], masks)

    def index(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per mask: sorted seed hashes with item and position."""
        out = []
        for mask in self.masks:
            hashes, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for k, (t, s) in enumerate(zip(self.tokens, self.stock)):
                h, at = _fair_seeds(t, s, mask)
                hashes.append(h)
                items.append(np.full(len(h), k, np.int32))
                places.append(at.astype(np.int32))
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            out.append((h[order], np.concatenate(items)[order], np.concatenate(places)[order]))
        return out


def _flags(n: int, marks: list[int] | None) -> np.ndarray:
    flag = np.zeros(n, bool)
    flag[[m for m in marks or [] if m < n]] = True
    return flag


# --- alignment ---------------------------------------------------------------------


def _next_row(word: np.uint64, text: np.ndarray, above: np.ndarray, before: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Best score of a chain that ends at this word of the item and each place of the
    text. A match is worth 1, a changed, added or missing word costs `_GAP`;
    `before` is the best chain of earlier words that ends at or ahead of a place, which
    a match may follow for `_JUMP`."""
    row = above - _GAP
    np.maximum(row, 0, out=row)
    np.maximum(row[1:], above[:-1] - _GAP, out=row[1:])
    at = np.flatnonzero(text == word)
    row[at + 1] = np.maximum(row[at + 1], np.maximum(above[at], before[at] - _JUMP) + 1)
    row += slope
    np.maximum.accumulate(row, out=row)
    row -= slope
    return row


def chained(item: np.ndarray, text: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """The best chain of segments, in order in item and text, with anything between
    them: (item positions, text positions) of the matched words of each.

    One table of item words by text words, a row at a time. Rows are kept at every
    so many words and made again on the way back, so memory is bounded by `_CELLS`
    or two rows per square root of the item's length, whichever is more.
    """
    n, m = len(item), len(text)
    if n < _LEAST_SEGMENT or m < _LEAST_SEGMENT:
        return []
    slope = (_GAP * np.arange(m + 1)).astype(np.int32)
    size = max(1, min(n, max(_CELLS // (m + 1), int(np.sqrt(n)))))
    zero = np.zeros(m + 1, np.int32)
    kept, above, before, best, end = [], zero, zero, 0, (0, 0)
    held, low = np.zeros((n + 1 if size == n else 0, m + 1), np.int32), 0 if size == n else n + 1
    for i in range(n):
        if i % size == 0:
            kept.append((above, before))
        before = np.maximum(before, np.maximum.accumulate(above))
        above = _next_row(item[i], text, above, before, slope)
        if size == n:
            held[i + 1] = above
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), (i + 1, j)
    if best < _LEAST_SEGMENT - 1:
        return []
    def hold(i: int) -> None:
        """Make the rows of the block that holds row i (rows count from 1; row 0 is empty)."""
        nonlocal held, low
        block = max(0, i - 1) // size
        low = block * size
        up, far = kept[block]
        held = np.empty((min(size, n - low) + 1, m + 1), np.int32)
        held[0] = up
        for r in range(1, len(held)):
            far = np.maximum(far, np.maximum.accumulate(held[r - 1]))
            held[r] = _next_row(item[low + r - 1], text, held[r - 1], far, slope)

    segments: list[tuple[list[int], list[int]]] = [([], [])]
    i, j = end
    while i > 0 and j > 0:
        if not (low < i < low + len(held)):
            hold(i)
        here = int(held[i - low, j])
        if here <= 0:
            break
        same = text[j - 1] == item[i - 1]
        diagonal = int(held[i - 1 - low, j - 1])
        if here == diagonal + (1 if same else -_GAP):
            i, j = i - 1, j - 1
            if same:
                segments[-1][0].append(i)
                segments[-1][1].append(j)
        elif here == int(held[i - 1 - low, j]) - _GAP:
            i -= 1
        elif here == int(held[i - low, j - 1]) - _GAP:
            j -= 1
        else:  # a match that follows an earlier segment
            i, j, wanted = i - 1, j - 1, here - 1 + _JUMP
            segments[-1][0].append(i)
            segments[-1][1].append(j)
            segments.append(([], []))
            while i > 0:
                if not (low < i < low + len(held)):
                    hold(i)
                at = np.flatnonzero(held[i - low, : j + 1] == wanted)
                if len(at):
                    j = int(at[-1])
                    break
                i -= 1
    return [(a[::-1], b[::-1]) for a, b in reversed(segments) if a]


def _rim(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Words that go on in order just outside a segment, past one damaged word: too
    few of them to pay for the damage in the alignment. Both arrays begin at the
    segment's edge; positions of (item, text) counted from there."""
    out: list[tuple[int, int]] = []
    at = 0
    for i in range(min(3, len(item))):
        for j in range(at, min(4, len(text))):
            if item[i] == text[j]:
                out.append((i, j))
                at = j + 1
                break
    return out


def _without_long_runs(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The text with no more than four words in a row that the item does not have.
    To pass three costs more than another segment, and rims look four words far,
    so nothing is found or lost by the rest of a run."""
    known = np.unique(item)
    at = np.searchsorted(known, text)
    foreign = known[np.minimum(at, len(known) - 1)] != text
    run = np.arange(len(text)) - np.maximum.accumulate(np.where(foreign, -1, np.arange(len(text))))
    return text[~foreign | (run <= 4)]


def matched_positions(item: np.ndarray, text: np.ndarray) -> list[int]:
    """Item words found in the text, in order: the best chain of segments, however
    many, for other text may stand between the parts of a passage; with the words
    just outside each segment."""
    text = _without_long_runs(item, text)
    chain = chained(item, text)
    out: list[int] = []
    for s, (a, b) in enumerate(chain):
        low_i, low_j = (chain[s - 1][0][-1] + 1, chain[s - 1][1][-1] + 1) if s else (0, 0)
        low_i = max(low_i, out[-1] + 1 if out else 0)
        high_i, high_j = (chain[s + 1][0][0], chain[s + 1][1][0]) if s + 1 < len(chain) else (len(item), len(text))
        left = _rim(item[low_i : a[0]][::-1], text[low_j : b[0]][::-1])
        right = _rim(item[a[-1] + 1 : high_i], text[b[-1] + 1 : high_j])
        out += [a[0] - 1 - i for i, _ in reversed(left)] + a + [a[-1] + 1 + i for i, _ in right]
    return out


def passage(positions: list[int], stock: np.ndarray) -> int:
    """Most matched words in one stretch of the item of which at most one word in
    five is missing; stock wording counts neither way. Words scattered over an item
    are no passage."""
    place = np.cumsum(~stock) - 1
    at = [int(place[p]) for p in positions if not stock[p]]
    best = 0
    for i in range(len(at)):
        for j in range(len(at) - 1, i + best - 1, -1):
            if (j - i + 1) * 5 >= (at[j] - at[i] + 1) * 4:
                best = max(best, j - i + 1)
                break
    return best


def enough(matched: int, item_words: int) -> bool:
    """At least 18 words of the item (all of a shorter one), one in eight of them
    changed at most, and up to two unpaid words at the rims of a damaged passage."""
    asked = min(PASSAGE_WORDS, item_words)
    return matched > 0 and matched >= asked - asked // ONE_IN - (2 if asked >= PASSAGE_WORDS else 0)


# --- search ------------------------------------------------------------------------


def _search(block: ItemBlock, index: list, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(text number, item number, matched words) of every text and item that share
    seeds enough."""
    gap = max(len(m) for m in block.masks)
    # texts are laid one after another; what lies between belongs to none and matches nothing
    between = np.arange(1, gap + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    parts = [np.concatenate([t, between]) for t in texts]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    docs, numbers, spots, covered = [], [], [], []
    longest = max((len(t) for t in block.tokens), default=1)
    for mask, (hashes, items, places) in zip(block.masks, index):
        at = np.array([i for i, c in enumerate(mask) if c == "1"])
        if len(flat) < len(mask) or not len(hashes):
            continue
        seeds = _seeds(flat, mask)
        low = np.searchsorted(hashes, seeds, "left")
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == seeds)
        low = low[hit]
        reps = np.searchsorted(hashes, seeds[hit], "right") - low
        slots = np.repeat(low - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        spot = np.repeat(hit, reps)
        doc = np.searchsorted(starts, spot, "right") - 1
        docs.append(doc)
        numbers.append(items[slots].astype(np.int64))
        spots.append(spot)
        words_hit = ((doc * len(block.tokens) + items[slots]) * longest + places[slots])[:, None] + at[None, :]
        covered.append(np.unique(words_hit.reshape(-1)))
    if not docs:
        return []
    doc, number, spot = np.concatenate(docs), np.concatenate(numbers), np.concatenate(spots)
    pair = doc * len(block.tokens) + number
    seen, count = np.unique(np.unique(np.concatenate(covered)) // longest, return_counts=True)
    # a passage with one word in eight changed has its seeds cover half of the words asked for at least
    asked = np.minimum(PASSAGE_WORDS, np.array([len(t) for t in block.tokens]))[seen % len(block.tokens)]
    alive = seen[count * 9 >= asked * 4]
    keep = np.isin(pair, alive)
    order = np.lexsort((spot[keep], pair[keep]))
    pair, spot = pair[keep][order], spot[keep][order]
    firsts = np.concatenate([[0], np.nonzero(np.diff(pair))[0] + 1, [len(pair)]]) if len(pair) else np.zeros(1, np.int64)
    out = []
    for x, y in zip(firsts[:-1], firsts[1:]):
        d, k = divmod(int(pair[x]), len(block.tokens))
        item, text = block.tokens[k], parts[d]
        reach = len(item) + len(item) // 4 + 8
        edge = np.zeros(len(text) + 1, np.int64)
        places = np.unique(spot[x:y]) - starts[d]
        np.add.at(edge, np.maximum(0, places - reach), 1)
        np.add.at(edge, np.minimum(len(text), places + reach), -1)
        near = np.cumsum(edge[:-1]) > 0
        out.append((d, k, passage(matched_positions(item, text[near]), block.stock[k])))
    return out


def prepare_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tokens, stock): the word hashes of each item and the positions that stand
    in stock wording. Wording counts as stock by the different texts it is in, so
    an item that is in the table many times does not become stock by that."""
    kind = items.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            said = [known.of(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in said], pa.binary()), pa.array([s.view(np.int64) for s in said], pa.list_(pa.int64()))], names=["id", "tokens", "words"]
            )

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(split, f"id {kind}, tokens binary, words array<bigint>")
    n = STOCK_WORDS
    grams = rows.where(F.size("words") >= n).select(
        "id", F.md5("tokens").alias("said"), F.posexplode(F.expr(f"transform(sequence(0, size(words) - {n}), i -> xxhash64(slice(words, i + 1, {n})))")).alias("pos", "gram")
    )
    shared = grams.groupBy("gram").agg(F.count_distinct("said").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("gram")
    marks = grams.join(shared, "gram").select("id", F.explode(F.sequence("pos", F.col("pos") + n - 1)).alias("at"))
    return rows.select("id", "tokens").join(marks.groupBy("id").agg(F.collect_set("at").alias("stock")), "id", "left")


def seed_map(ready: DataFrame) -> np.ndarray:
    """The bits of all items' seeds, gathered task by task and joined by the bit: at
    most 2**MAP_BITS bits come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros(2**MAP_BITS // 64, np.uint64)
        for batch in batches:
            for t, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(t, np.uint64)
                for mask in MASKS:
                    for slot in _slots(_fair_seeds(tokens, _flags(len(tokens), marks), mask)[0]):
                        np.bitwise_or.at(here, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(here)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(here[at].view(np.int64))], names=["at", "bits"])

    joined = ready.select("tokens", "stock").mapInArrow(bits, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(2**MAP_BITS // 64, np.uint64)
    out[joined["at"].to_numpy()] = joined["bits"].to_numpy().view(np.uint64)
    return out


def sharing_texts(docs: DataFrame, key: str, text: str, bits: np.ndarray) -> DataFrame:
    """(doc_id, tokens): texts that share a seed with any item, and now and then one
    that does not; as word hashes."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHashes(), shared.value
        inside = lambda slot: (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in blocks_of(texts, WORK_CHARS):
                row, out = [], []
                for i in range(s, e):
                    tokens = known.of(words(texts[i]))
                    for mask in MASKS:
                        one, two = _slots(_seeds(tokens, mask))
                        if (inside(one) & inside(two)).any():
                            row.append(i)
                            out.append(tokens.tobytes())
                            break
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], names=["doc_id", "tokens"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(keep, f"doc_id {kind}, tokens binary")


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, words): texts that carry a test item or a passage of it.

    Words counts the item's words found in order, stock wording left out. Every
    text is searched whole. Texts are read once; those that share a seed with an
    item are written as word hashes and searched for the items in blocks of about
    `block_chars` characters, one after another. A block's items go to the driver
    and the tasks, its rows are written, and it is released before the next. Null
    and empty texts and items match nothing; repeated texts and repeated items are
    reported under each id; items that are stock wording only match nothing.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, words int"
    ready = cut(prepare_items(items, item_key, item_text))
    chars = ready.agg(F.sum(F.length("tokens"))).first()[0] or 0
    if not chars:
        return spark.createDataFrame([], schema)
    # 8 bytes a word, 6 characters a word and its blank
    blocks = max(1, -(-int(chars) * 6 // 8 // block_chars))
    texts = cut(sharing_texts(spread(docs.select(doc_key, doc_text), doc_key), doc_key, doc_text, seed_map(ready)))
    out = None
    for b in range(blocks):
        rows = ready.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not rows:
            continue
        block = ItemBlock.of([(r.id, bytes(r.tokens), r.stock) for r in rows])
        sent = spark.sparkContext.broadcast((block, block.index(), pa.array(block.ids), [int((~s).sum()) for s in block.stock]))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            block, index, ids, counted = sent.value
            for batch in batches:
                raw = batch.column(1).to_pylist()
                tokens = [np.frombuffer(t, np.uint64) for t in raw]
                for s, e in blocks_of(raw, WORK_CHARS):
                    hits = [h for h in _search(block, index, tokens[s:e]) if enough(h[2], counted[h[1]])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([s + h[0] for h in hits], pa.int64())),
                            ids.take(pa.array([h[1] for h in hits], pa.int64())),
                            pa.array([h[2] for h in hits], pa.int32()),
                        ],
                        names=["doc_id", "item_id", "words"],
                    )

        part = cut(texts.mapInArrow(find, schema))
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out
