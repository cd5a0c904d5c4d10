"""Personal mentions in free text: found by the tagger, replaced by typed placeholders."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.llm.pii_labels import ADDRESS, EMAIL, IDENTITY, PHONE
from stepfree.llm.pii_model import Tagger, tag_texts

#: Characters tagged at once in a worker; bounds its memory, not what is read.
BLOCK_CHARS = 1_000_000
#: Python-heavy stages read at least this many partitions per core.
TASKS_PER_CORE = 3

_LINK = r"(?:d[aeo]s?|del?|la|las|los|el|e|y)"
_WAY = r"(?<!\p{L})(?:Rua|R\.|Avenida|Avda?\.|Av\.|Travessa|Trav\.|Tv\.|Praça|Alameda|Al\.|Largo|Estrada|Rodovia|Calle|C/|Cl\.|Plaza|Pl\.|Travesía|Paseo|P\.º|Ronda|Camino)"
_HOUSE = (
    rf"{_WAY}\s?(?:(?-i:\p{{Lu}})[\p{{L}}\p{{M}}]*|{_LINK})(?:\s(?:(?-i:\p{{Lu}})[\p{{L}}\p{{M}}]*|{_LINK}|\d{{1,2}}(?=\sde))){{0,5}}(?:,\s|\s)(?:n\.?[ºo°]\s?|n\.\s?|núm\.?\s?|número\s)?\d+[A-Z]?\b"
    r"(?:(?:,|\s-|\s–)\s?(?:(?:apto|ap|apartamento|casa|bloco|bloque|piso|puerta|escalera|esc|sala|andar)\.?\s?\w*\d\w*|\d+\.?[ºª](?:\s(?:\w\b|andar))?|fundos|bajo))*"
)
_ENGLISH_HOUSE = (
    r"(?:(?:Flat|Apt|Unit|Apartment|Suite)\.?\s\w+,\s)?\d+[A-Z]?\s(?:(?-i:\p{Lu})[\p{L}\p{M}'’]+\s){1,3}"
    r"(?:Street|Road|Avenue|Lane|Way|St|Rd|Ave|Ln|Drive|Dr|Court|Ct|Square|Sq|Close|Terrace|Boulevard|Blvd|Place|Crescent)\b(?:,\s(?:Flat|Apt|Unit|Apartment|Suite|#)\.?\s?\w+)?"
)
_FORMS = {
    "email": [regex.compile(r"[\w+-]+(?:\.[\w+-]+)*(?:@|[ ]@[ ])[\w-]+(?:\.[\w-]+)+", regex.I), regex.compile(EMAIL, regex.I)],
    "phone": [regex.compile(PHONE)],
    "identity": [regex.compile(IDENTITY, regex.I), regex.compile(r"(?<!\w)(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{0,3}-?\d+(?:[ .-]?\d+)*(?:[.-]?[A-Z])?)(?!\w)")],
    "address": [regex.compile(ADDRESS, regex.I), regex.compile(_HOUSE, regex.I), regex.compile(_ENGLISH_HOUSE, regex.I)],
}
#: Characters around a tagged span in which its form is looked for.
_MARGIN = 48
#: Digits of a phone number that begins with neither + nor 00; a trunk 0 is not counted.
_NATIONAL_DIGITS = 11
# fixed values: groupings of digits that only identity numbers have
_GROUPED = regex.compile(r"\d{3}-\d\d-\d{4}|\d{3}\.\d{3}\.\d{3}-\d\d")
_FOURS = regex.compile(r"\d{4} \d{4} \d{4}")
# fixed values: words before numbers of things, not of persons
_THING = regex.compile(
    r"(?<!\p{L})(?:serial|série|serie|ticket|protocolo?|invoice|factura|fatura|nota(?:\sfiscal)?|nf|expediente|changeset|order|pedido)[\s:#]*(?:(?:number|número|no|n)\b\.?º?[\s:#]*)?$", regex.I
)
_TITLE = regex.compile(r"^(?:Mrs?|Ms|Dr|Sra?|Dra|Don|Doña)\b\.?\s+", regex.I)
# fixed values: words that begin names of streets and houses, not of persons
_PLACE = regex.compile(
    r"(?<!\p{L})(?:Rua|R\.|Avenida|Avda?\.|Av\.|Travessa|Praça|Alameda|Largo|Calle|C/|Plaza|Travesía|Paseo|Escola|Escuela|Colégio|Colegio|Hospital|Biblioteca|Fundação|Fundación"
    r"|Street|Road|Avenue|Lane|School|Foundation|Library|Square)(?!\p{L})", regex.I,
)
_WITHIN_PLACE = regex.compile(
    r"(?<!\p{L})(?:Rua|Avenida|Travessa|Praça|Alameda|Largo|Calle|Plaza|Travesía|Paseo|Escola|Escuela|Colégio|Colegio|Hospital|Biblioteca|Fundação|Fundación"
    r"|Street|Road|Avenue|Lane|School|Foundation|Library|Square)(?!\p{L})", regex.I,
)
_OF_PLACE = regex.compile(
    r"(?<!\p{L})(?:escola|escuela|colégio|colegio|hospital|biblioteca|school|library|hospital|instituto|fundação|fundación|foundation|universidade?)(?:\s\p{L}+)?\s+(?:d[aeo]s?\s|del\s)?$", regex.I
)
_PLACE_OF = regex.compile(r"\s+(?:primary\s+)?(?:school|foundation|library|hospital|street|road|avenue|lane|square|council|trust)(?!\p{L})", regex.I)
# fixed values: words of running text that are no part of a name
_RUNNING = frozenset(
    "the this that these those in on at of for from with because which beside between both only my our your is was are and foi fue como entre apenas que quando cuando para por com con em en um uma una sin sem queda fica quien quem"
    " ayer hoy ontem hoje yesterday today when how what where why who every keeps by qual quais casi todo toda delante a o as os".split()
)
_LETTER = regex.compile(r"[\p{L}\p{M}]")


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The mention as a whole: a tagged span has to hold the form of its kind,
    and is moved to where the form begins and ends. Names reach to their words'
    ends, lose a title and outer words in lower case, and need two words."""
    if kind == "name":
        while start > 0 and _LETTER.match(text[start - 1]) and _LETTER.match(text[start]):
            start -= 1
        while end < len(text) and _LETTER.match(text[end]) and _LETTER.match(text[end - 1]):
            end += 1
        part = text[start:end]
        start += len(part) - len(part.lstrip(" \n\t,.;:<>-"))
        part = text[start:end].rstrip(" \n\t,;:<>-")
        title = _TITLE.match(part)
        if title:
            start += title.end()
        end = start + len(part) - (title.end() if title else 0)
        start, end = _capitalised(text, *_without_running(text, start, end))
        said = text[start:end]
        if len(said.split()) < 2 or any(c.isdigit() for c in said) or any(_running(w) for w in said.split()) or _PLACE.match(said) or _WITHIN_PLACE.search(said):
            return None
        before = html.unescape(text[max(0, start - _MARGIN) : start])
        return None if _OF_PLACE.search(before) or _PLACE_OF.match(text, end) else (start, end)
    low, high = max(0, start - _MARGIN), min(len(text), end + _MARGIN)
    if kind in ("phone", "identity") and _THING.search(html.unescape(text[low:start])):
        return None
    for form in _FORMS[kind]:
        best = None
        for m in form.finditer(text, low, high, overlapped=kind == "email"):
            a, b = m.span()
            if kind == "phone":
                a += len(m.group(0)) - len(m.group(0).lstrip(" .-"))
                said = text[a:b]
                most = 15 if said.startswith(("+", "00")) else _NATIONAL_DIGITS + said.startswith("0")
                if not 7 <= sum(c.isdigit() for c in said) <= most or _FOURS.fullmatch(said):
                    continue
            elif kind == "identity" and sum(c.isdigit() for c in m.group(0)) < 5:
                continue
            shared = min(b, end) - max(a, start)
            if shared > 0 and (best is None or shared > best[0]):
                best = (shared, a, b)
        if best and best[0] * 2 > end - start:
            return best[1:]
    return None


def _running(word: str) -> bool:
    """A word of running text; a letter with a full stop is an initial."""
    return word.strip(",;").lower() in _RUNNING or (len(word) > 2 and word.strip(".,;").lower() in _RUNNING)


def _without_running(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the running words it begins and ends with."""
    parts = list(regex.finditer(r"\S+", text[start:end]))
    while parts and _running(parts[0].group(0)):
        parts.pop(0)
    while parts and _running(parts[-1].group(0)):
        parts.pop()
    return (start + parts[0].start(), start + parts[-1].end()) if parts else (start, start)


def _capitalised(text: str, start: int, end: int) -> tuple[int, int]:
    """A name with capitals neither begins nor ends with a word in lower case."""
    parts = list(regex.finditer(r"\S+", text[start:end]))
    if any(p.group(0)[0].isupper() for p in parts):
        parts = parts[next(i for i, p in enumerate(parts) if p.group(0)[0].isupper()) :]
        while not parts[-1].group(0)[0].isupper():
            parts.pop()
        start, end = start + parts[0].start(), start + parts[-1].end()
    return start, end


def spread(df: DataFrame, key: str) -> DataFrame:
    """More partitions for CPU-heavy Python where the input has few; inputs with
    enough partitions are not shuffled."""
    wanted = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def blocks_of(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with about `chars` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _mentions(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    out = []
    for text, spans in zip(texts, tag_texts(model, texts)):
        good, last = [], 0
        for a, b, kind in spans:
            fit = checked(text, a, b, kind)
            if fit and fit[0] >= last:
                good.append((*fit, "identity" if kind == "phone" and _GROUPED.fullmatch(text, *fit) else kind))
                last = fit[1]
        out.append(good)
    return out


def _different(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of all rows and (digest, text) of the different texts. Copies
    of a text are folded task by task before the texts are shuffled, so a text that
    makes up a third of all rows is one row afterwards."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.md5(F.col(text)).alias("digest"))
    return rows.select("doc_id", "digest"), rows.where("text is not null").groupBy("digest").agg(F.first("text").alias("text"))


def tag_mentions(df: DataFrame, key: str, text: str, model: Tagger | None = None) -> DataFrame:
    """(doc_id, kind, start, stop, mention), one row per mention in the whole text.

    kind is email, phone, identity, address or name; start and stop count
    characters; `mention` is the exact text. Null and empty texts have no rows. Equal
    texts are tagged once and their rows come out under each id, by a join on the
    text's digest (two shuffles: the different texts, and ids with their digests; a
    hot digest is split by the adaptive skew join).
    """
    tagger = model or Tagger.load()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks_of(texts, BLOCK_CHARS):
                row, kinds, starts, stops, said = [], [], [], [], []
                here = texts[a:b]
                for i, (t, spans) in enumerate(zip(here, _mentions(tagger, here))):
                    for s, e, k in spans:
                        row.append(a + i)
                        kinds.append(k)
                        starts.append(s)
                        stops.append(e)
                        said.append(t[s:e])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(said, pa.string())],
                    names=["digest", "kind", "start", "stop", "mention"],
                )

    rows, texts = _different(df, key, text)
    spans = texts.mapInArrow(tag, "digest string, kind string, start int, stop int, mention string")
    return rows.join(spans, "digest").select("doc_id", "kind", "start", "stop", "mention")


def redact(df: DataFrame, key: str, text: str, model: Tagger | None = None) -> DataFrame:
    """(doc_id, redacted, n_mentions): each mention replaced by its kind in
    brackets, as [EMAIL]; everything else is left as it is. Null stays null, with 0
    mentions. Equal texts are tagged once, as in `tag_mentions`."""
    tagger = model or Tagger.load()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks_of(texts, BLOCK_CHARS):
                here, out, count = texts[a:b], [], []
                for t, spans in zip(here, _mentions(tagger, here)):
                    parts, last = [], 0
                    for s, e, k in spans:
                        parts += [t[last:s], f"[{k.upper()}]"]
                        last = e
                    out.append("".join([*parts, t[last:]]))
                    count.append(len(spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(out, pa.string()), pa.array(count, pa.int32())], names=["digest", "redacted", "n_mentions"]
                )

    rows, texts = _different(df, key, text)
    done = texts.mapInArrow(replace, "digest string, redacted string, n_mentions int")
    return rows.join(done, "digest", "left").select("doc_id", "redacted", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))
