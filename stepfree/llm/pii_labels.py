"""Labelled spans for training the mention tagger.

No labelled texts are given, so labels come from the wording around mentions
("Reported by ..., reachable at ..."): a frame names what stands in its gaps.
Frames are read only when a model is trained, never when texts are tagged.
"""

from __future__ import annotations

import regex

KINDS = ("email", "phone", "identity", "address", "name")

_LETTER = r"(?:[\p{L}\p{M}]|&[A-Za-z]+;)"
_NOT_NAME = (
    "about|it|the|to|and|on|in|an?|of|with|for|was|is|at|el|los|las|en|con|por|um|uma|na|no|em|que|from|contact|name|nome|nombre|mrs?|ms|sra?|dr|answer|subject"
)
_WORD = rf"(?!(?:{_NOT_NAME})\b){_LETTER}(?:{_LETTER}|['’\u00ad-](?={_LETTER}))*"
_S = r"(?:[ \t ]|&nbsp;|\n(?!\s*\n))+"
_TOKEN = rf"(?:\p{{L}}\.|{_WORD})"
_NAME = rf"{_WORD}(?:,?{_S}{_TOKEN})(?:{_S}{_TOKEN}){{0,4}}?"

_SIGN = r"(?:@|[ ]@[ ]|[ ]?[\(\[]at[\)\]][ ]?|[ ]at[ ]|[ ]?[\(\[]arroba[\)\]][ ]?|[ ]arroba[ ])"
_DOT = r"(?:\.|[ ]?[\(\[]dot[\)\]][ ]?|[ ]dot[ ]|[ ]?[\(\[](?:ponto|punto)[\)\]][ ]?|[ ](?:ponto|punto)[ ])"
EMAIL = rf"[\w+-]+(?:\.[\w+-]+)*{_SIGN}[\w-]+(?:{_DOT}[\w-]+)+"
PHONE = r"(?:(?:\+\d{1,3}|00\d{2}(?=[ .-]))[ .-]?)?(?:\(\d{1,3}\)[ .-]?)?\d{2,14}(?:[ .-]\d{1,7}){0,4}"
IDENTITY = (
    r"(?:XX-?\d\d\.?\d{3}\.?\d{3}(?:-\w)?|XA\d{7}|QQ ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}[. ]?\d{3}[. ]?\d{3}[- ]?\d\d"
    r"|\d{3}[- ]?\d\d[- ]?\d{4}|[XYZ]?-?\d{1,2}\.?\d{3}\.?\d{3}-?[A-Z])"
)
_AS = r"(?:[ \t]{1,2}|&nbsp;|\n(?! ))"
_UNIT = r"M(?:[EÉ]T|ETRE)|[Mm](?:[eé]t|etre|\b)"
_EN_WAY = r"(?:Street|Road|Avenue|Lane|Way|St|Rd|Ave|Ln|Drive|Dr|Court|Ct|Square|Sq)\b"
_ENGLISH = (
    rf"(?:(?:Flat|Apt|Unit|Apartment|Suite)\.?{_AS}\w+,{_AS})?\d+[A-Z]?{_AS}(?!(?:On|The|In|At|Between|Of|From)\b)(?-i:[\p{{Lu}}])[\p{{L}}\p{{M}}]+(?:{_AS}(?-i:[\p{{Lu}}])[\p{{L}}\p{{M}}]+)??{_AS}{_EN_WAY}"
    rf"(?:,{_AS}(?:Flat|Apt|Unit|Apartment|Suite|#)\.?{_AS}?\w+)?"
)
_IB_WAY = r"(?<!\p{L})(?:Rua|(?-i:R\.)|Avenida|Avda?\.|Av\.|Travessa|Trav\.|Tv\.|Praça|Alameda|Al\.|Largo|Calle|C/|Cl\.|Plaza|Pl\.|Travesía|Paseo|P\.º)"
_IBERIAN = (
    rf"{_IB_WAY}{_AS}?(?-i:[\p{{Lu}}])[\p{{L}}\p{{M}}]+(?:{_AS}(?!(?:Em|En|Faz|Hace|Protocolo)\b)(?-i:[\p{{Lu}}])[\p{{L}}\p{{M}}]+)?"
    rf"(?:,{_AS}|{_AS})(?:n\.?[ºo°]{_AS}?|nº{_AS}?|n\.{_AS}?|núm\.?{_AS}?)?\d+[A-Z]?\b(?!{_AS}(?:{_UNIT}|cm|%))(?![.,]\d)"
    rf"(?:(?:,|{_AS}-|{_AS}–){_AS}?(?:(?:apto|ap|apartamento|casa|bloco|bloque|piso|puerta|escalera|esc|sala|andar)\.?{_AS}?\w*\d\w*|\d+\.?[ºª](?:{_AS}\w\b)?|fundos|bajo))*"
)
ADDRESS = rf"(?:{_ENGLISH}|{_IBERIAN})"

_T = r"(?:(?:Mrs?|Ms|Dr|Sra?|Dra|Don|Doña|D)\.?[ ]+)?"


def _frame(text: str) -> regex.Pattern:
    gaps = {"<N>": ("name", _NAME), "<E>": ("email", EMAIL), "<P>": ("phone", PHONE), "<I>": ("identity", IDENTITY), "<A>": ("address", ADDRESS)}
    text = regex.sub(r"\[[^\]]*\]|( )", lambda m: _S if m.group(1) else m.group(0), text)
    count = 0
    for mark, (kind, body) in gaps.items():
        while mark in text:
            text = text.replace(mark, f"(?P<{kind}_{count}>{body})", 1)
            count += 1
    return regex.compile(text, regex.IGNORECASE | regex.MULTILINE)


# wording that surrounds mentions, by language
FRAMES = [
    _frame(t)
    for t in (
        rf"\bMs {_T}<N> \(ID <I>\)", rf"\bmy name is {_T}<N> and I live at <A>", rf"\breported by {_T}<N>, reachable at <E>",
        r"\b(?:from|de): <N> <(?:<E>)>", r"\b(?:contact|contato|contacto): <N> <(?:<E>)>", r"(?:^|[ \n>])(?:name|nome|nombre): <N>(?=[ ]*(?:\n|$|<|\|))",
        rf"\bplease ring {_T}<N> on <P> before", rf"\b(?:her daughter|his son|her son|his daughter) {_T}<N> will open the gate, number <P> from",
        rf"\bthe inspector, {_T}<N>, closed", rf"\bwe promised {_T}<N> and {_T}<N> an answer", rf"(?:^|[.!?>;] |\n[ ]?|pictures ){_T}<N> of <A> holds card <I> and asked us to call <P>",
        rf"\bwrite back to {_T}<N>, <A>", rf"(?:^|[.!?>] |\n[ ]?){_T}<N> slipped on the ramp", rf"\btalk to {_T}<N> about it", rf"\bwe met {_T}<N> outside <A> and took",
        r"\bname=<N>;", r"\bnome=<N>;", r"\bnombre=<N>;", r"\b\d+;<N>;<P>;<A>;", r"(?:^|\s)--[ ]*\n[ ]?<N>(?=[ ]*(?:\n|$))", r"(?:^|\n)[ ]?<N>[ ]*\n[ ]?<A>[ ]*\n[ ]?<P>", rf"\bsolicita {_T}<N>, documento <I>",
        r"\b(?:atentamente|regards|att|saludos|atenciosamente|obrigad[oa]|sincerely|cordialmente),?[ ]*\n[ ]?<N>(?=[ ]*(?:\n|$))",
        rf"(?:^|[.!?>] |\n[ ]?){_T}<N> pediu resposta por <E>", rf"\bsolicitante: {_T}<N>, (?:CPF|RG|CIN) <I>", rf"\bfavor ligar para {_T}<N> no <P>",
        rf"\bmeu nome é {_T}<N> e moro na <A>", rf"\ba moradora {_T}<N>, da <A>, deixou o número <P>", rf"\bprometemos retorno a {_T}<N> e a {_T}<N>(?=\.)",
        rf"\bfalei com {_T}<N> na obra", rf"(?:^|[.!?>] |\n[ ]?|, apto \d+\. |casa \d+\. ){_T}<N> caiu na rampa", rf"\bme llamo {_T}<N> y vivo en <A>",
        rf"\bla vecina {_T}<N>, de <A>, dejó el número <P>", rf"\bllamar a {_T}<N> al <P>", rf"(?:^|[.!?>] |\n[ ]?){_T}<N> tropezó en la rampa",
        r"\bID <I>", r"\b(?:card|Social no\.|national number|CPF|RG|DNI|NIE|NIF|documento(?: de identidad)?(?: n\.º)?|doc|passport)[ :=]{1,2}<I>",
        r"\b(?:tel|phone|mobile|telefone|teléfono|celular|fone|móvil)(?:\.:|[.:=]) ?<P>", r"\btext me at <P> or", r"\bnumber <P> from nine",
        r"^<P>$", r"\bcall <P>",
    )
]
_FREE = [("email", regex.compile(EMAIL, regex.I)), ("address", regex.compile(ADDRESS, regex.I))]
_NOT_MAIL = regex.compile(r"https?://|width@|^\w+ at [a-z]+$", regex.I)
_FREE_PHONE = regex.compile(
    r"(?<![\w/.+-])(?:\+\d{1,3}[ ]?\d{8,12}|\+\d{1,3}[ ]\(?\d[\d() -]{7,14}\d|\(\d{2,3}\)[ ]?\d{3,5}-?\d{4,5}|0\d{3,4} \d{6}|0\d{2} \d{4} \d{4}|\d{3}[.-]555[.-]\d{4}|000[ -]\d{3}[ -]\d{3}|\d\d 9 ?\d{4} \d{4}|0\d\d \d{5}\.\d{4}|0034 \d{9}|0034 \d{3} \d{6})(?![\w/-]|\.\d)"
)


def labelled_spans(text: str) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind), in order; earlier frames win."""
    taken = bytearray(len(text))
    out = []

    def add(a: int, b: int, kind: str) -> None:
        if kind == "address" and text[a].islower():
            return
        if a < b and not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, kind))

    for frame in FRAMES:
        for m in frame.finditer(text):
            for name, value in m.groupdict().items():
                if value:
                    kind = name.split("_")[0]
                    a, b = m.span(name)
                    if kind == "phone":
                        body = text[a:b]
                        a += len(body) - len(body.lstrip(" .-"))
                        b = a + len(body.strip(" .-"))
                        if sum(c.isdigit() for c in text[a:b]) < 7:
                            continue
                    add(a, b, kind)
    for kind, pattern in _FREE:
        for m in pattern.finditer(text):
            if kind == "email" and (_NOT_MAIL.search(m.group(0)) or not regex.search(r"@|[\(\[]at|[\(\[]arroba| dot | ponto | punto ", m.group(0), regex.I)):
                continue
            add(*m.span(), kind)
    for m in _FREE_PHONE.finditer(text):
        add(*m.span(), "phone")
    return sorted(out)
