"""Made-up labelled text for training the mention tagger.

Mentions of many forms are drawn at random and put into wording that is drawn at
random as well: openings, cues and tails in three languages that combine freely,
gaps anywhere in running text of a corpus, lists, forms and signatures. Beside
them stand look-alikes that are no mentions (streets without a number, schools,
foundations, tickets, serials, dates, amounts, handles). Names come from open
syllable generators and from short lists of common names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Piece = tuple[str, str | None]

# fixed values: common given and family names of the three languages
GIVEN = (
    "James Mary John Linda Robert Susan Michael Karen David Nancy Emma Oliver Sarah Thomas Grace Peter Alice Hannah George Ruth Daniel Laura Kevin Megan Priya Ahmed Wei Fatima "
    "João Maria José Ana Pedro Beatriz Rafael Camila Luís Mariana Antônio Juliana Tiago Inês Gonçalo Fernanda Marcelo Letícia Vinícius Patrícia Bruno Sílvia "
    "Carlos Lucía Javier Carmen Miguel Elena Sofía Andrés Raúl Marta Álvaro Pilar Diego Inmaculada Jesús Rocío Iván Nuria Óscar Begoña Hugo Paula"
).split()
FAMILY = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Patel Wright Walker White Thompson Green Hall Clarke Hughes Edwards Murphy O'Brien McDonald Fitzgerald Khan Nguyen Chen Young "
    "Silva Santos Oliveira Souza Pereira Lima Carvalho Ferreira Rodrigues Almeida Costa Gomes Martins Araújo Melo Barbosa Ribeiro Nogueira Teixeira Moreira Cardoso "
    "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Navarro Torres Ibáñez Castillo"
).split()
# beginnings and endings that make family and given names by rule
_FAMILY_PARTS = {
    "en": ("Har Black White Lang Ash Whit Pem Rother Lock Arm Daven Cart Wood Strat Hol Brad Kings Thorn Mar Wins Gold Stan Per Fair Haw Mid Lin Dun Cald Wal Don Mac".split(),
           "wood field ton worth ley ford greaves combe well hart bury ham man son ridge stone port berton shaw low kins nelly bridge mond sett ey er by land".split()),
    "pt": ("Bran Men Fig Vasc Quei Sequ Pei Tav Andr Mont Noguei Cout Mac Guim Bitten Nasc Prat Falc Vil Amor Bast Lob Mour Pint Rang Saldan Vel Brit Camp Farr".split(),
           "dão ezes ueira oncelos roz eira xoto ares ade eiro inho ira court imento es ão ela im os ato ado oso elho ana ova edo al osa eda".split()),
    "es": ("Robl Carr Olm Arr Pedr Villan Cifu Baez Tej Ledesm Piz Lar Och Ques Rued Sant Ferr Mont Figu Urr Esc Vid Sald Cort Mend Alarc Zamb Ib Bust Gall".split(),
           "edo asco ibas aza ueva entes ada esma arro ara oa ada amaría er oya eroa utia udero al ano és oza ón arra amante ego illo eda ena ández".split()),
}
_GIVEN_PARTS = {
    "en": ("Ab Ow Na Tre Fi Ga Yv Des In Ro Har Be Gi Mar Ed Lou Pri An Kei Al Do Jo Mi Vic Phi Sam Gwe Nor Ruf Cla Eli".split(), "igail en omi vor ona reth onne mond grid salind old atrice llian tha ward is scilla thony ra an ris nas riam tor lip uel n bert us ire za".split()),
    "pt": ("Clau Otá Ren Seb He Wag Adr Mu Zil Le Ter Uli Fab Ev So Íca Mar Da Ros Jur Edu Gil Nel Ve Már Cél Rai Osv Dal Iv".split(), "dia vio ata astião loísa ner iana rilo da andro eza sses iana erton nia ro li vi ângela andir arda berto son ra cia io munda aldo va one".split()),
    "es": ("Enc Gin Mac Fer Aur Nés Ade Joa Rem Sat Can Eug Mer Leo Bal Nie Gon Alb Rod Teó Car Sam Iné Mat Est Ram Cel Bern Pur Ama".split(), "arna és arena mín ora tor la quín edios urnino dela enio cedes nor tasar ves zalo a rigo filo lota ir s eo rella iro ia arda ificación dor".split()),
}
_ONSET = "b br c ch d dr f fl g gr h j k l ll m n p pr r s st t tr v w y z".split()
_NUCLEUS = "a e i o u a e i o ai ei ia io á é í ó ã".split()
_CODA = "   l n r s m".split(" ")
_ENDS = "a o e is as os ez in an on ar er el ik ek wick ert vald belle dra tano linn sen mann ães eiro inho ito".split()
_WAYS = {
    "en": "Street Road Avenue Lane Way St Rd Ave Ln Drive Dr Court Ct Square Sq Close Terrace Boulevard Blvd Place Crescent".split(),
    "pt": ["Rua", "R.", "Avenida", "Av.", "Travessa", "Trav.", "Tv.", "Praça", "Alameda", "Al.", "Largo", "Estrada", "Rodovia"],
    "es": ["Calle", "C/", "C/ ", "Cl.", "Avenida", "Avda.", "Av.", "Plaza", "Pl.", "Travesía", "Paseo", "P.º", "Ronda", "Camino"],
}


class Maker:
    def __init__(self, seed: int, corpus: list[str], parts: list[str] | None = None):
        self.r = np.random.default_rng(seed)
        self.corpus = corpus
        self.parts = parts or []

    def one(self, of):  # noqa: ANN001, ANN201
        return of[int(self.r.integers(len(of)))]

    def p(self, share: float) -> bool:
        return self.r.random() < share

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    # --- mentions ----------------------------------------------------------------

    def syllables(self) -> str:
        out = "".join(self.one(_ONSET) + self.one(_NUCLEUS) + self.one(_CODA) for _ in range(int(self.r.integers(1, 3))))
        out += self.one(_ENDS) if self.p(0.6) else self.one(_ONSET) + self.one(_NUCLEUS)
        return out[0].upper() + out[1:]

    def part(self, common: list[str]) -> str:
        x = self.r.random()
        if x < 0.25:
            return self.syllables()
        if x < 0.55:
            heads, tails = (_GIVEN_PARTS if common is GIVEN else _FAMILY_PARTS)[self.one(["en", "pt", "es"])]
            return self.one(heads) + self.one(tails)
        if x < 0.8 or not self.parts:
            return self.one(common)
        return self.one(self.parts)

    def name(self) -> str:
        given, family = self.part(GIVEN), self.part(FAMILY)
        if self.p(0.06):
            family = self.one(["O'", "Mc", "D'", "Mac", "Fitz"]) + family
        if self.p(0.08):
            family += self.one("-- ") + self.part(FAMILY)
        if self.p(0.05):
            given += self.one("- ") + self.part(GIVEN)
        link = self.one([" de ", " da ", " dos ", " do ", " e ", " van ", " del ", " de la ", " y "]) if self.p(0.12) else " "
        x = self.r.random()
        if x < 0.12:
            out = f"{family}, {given}" + (f" {self.one('ABCDEFGJLMNPRST')}." if self.p(0.2) else "")
        elif x < 0.3:
            out = f"{given} {self.one('ABCDEFGJLMNPRST')}.{' ' + self.one('ABCDEGM') + '.' if self.p(0.15) else ''} {family}"
        elif x < 0.36:
            out = f"{self.one('ABCDEFGJLMNPRST')}. {family}"
        elif x < 0.5:
            out = f"{given} {self.part(GIVEN)} {family}"
        elif x < 0.6:
            out = f"{given}{link}{family} {self.part(FAMILY)}"
        else:
            out = f"{given}{link}{family}"
        y = self.r.random()
        return out.upper() if y < 0.05 else out.lower() if y < 0.09 else out

    def email(self) -> str:
        word = lambda: self.part(GIVEN).lower().replace("'", "").replace(" ", "")
        user = word() + (self.one(["", ".", "_", "-"]) + self.part(FAMILY).lower().replace("'", "").replace(" ", "") if self.p(0.7) else "")
        user += self.digits(int(self.r.integers(1, 5))) if self.p(0.3) else ""
        user += "+" + word() if self.p(0.1) else ""
        host = self.one(["mail", "post", "correio", "uni", "city", "webmail", "gmail", "outlook", "council", "empresa", self.syllables().lower(), self.syllables().lower() + "-" + self.one(["net", "web", "log"])])
        top = [self.one(["example", "test", "com", "org", "net", "gov", "edu", "invalid", "com", "co", "info"])] + ([self.one(["br", "es", "uk", "pt", "mx", "ar"])] if self.p(0.3) else [])
        x = self.r.random()
        if x < 0.72:
            out = f"{user}@{'.'.join([host, *top])}"
        else:
            at, dot = self.one([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" arroba ", " ponto "), (" arroba ", " punto "), ("(arroba)", "(punto)"), ("[arroba]", "[ponto]"), (" @ ", "."), (" @ ", " . ")])
            at, dot = (at, ".") if self.p(0.3) else (at, dot)
            out = f"{user}{at}{dot.join([host, *top])}"
        return out.upper() if self.p(0.05) else out

    def phone(self) -> str:
        d, gap = self.digits, self.one([" ", "-", ".", " "])
        forms: list[Callable[[], str]] = [
            lambda: f"+{self.one(['1', '44', '55', '34', '351', '52', '54', '49', '33'])}{self.one([' ', '-', '', ' '])}{d(2)}{gap}{d(4)}{gap}{d(4)}",
            lambda: f"+{self.one(['44', '55', '34', '351', '1'])}{self.one(['', ' '])}{d(int(self.r.integers(8, 12)))}",
            lambda: f"({d(2)}) {self.one(['9', ''])}{d(4)}-{d(4)}", lambda: f"+55 ({d(2)}) 9{d(4)}-{d(4)}", lambda: f"{d(2)} 9{self.one(['', ' '])}{d(4)}{self.one(['-', ' '])}{d(4)}",
            lambda: f"{d(3)}{gap}{d(3)}{gap}{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(4)}",
            lambda: f"0{d(3)} {d(6)}", lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"07{d(3)} {d(6)}",
            lambda: f"6{d(2)} {d(3)} {d(3)}", lambda: f"6{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"9{d(2)}-{d(3)}-{d(3)}", lambda: f"00{self.one(['34', '44', '55', '351'])} {d(3)} {d(3)} {d(3)}",
            lambda: f"+34 {d(3)} {d(3)} {d(3)}", lambda: f"+44 (0){d(2)} {d(4)} {d(4)}", lambda: f"000{self.one(['-', ' '])}{d(3)}{self.one(['-', ' '])}{d(3)}", lambda: d(int(self.r.integers(8, 12))),
            lambda: f"{d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)}.{d(4)}.{d(4)}", lambda: f"0{d(2)} {d(5)}.{d(4)}",
        ]
        return self.one(forms)()

    def identity(self) -> str:
        d, letter = self.digits, lambda n=1: "".join(self.one("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        gap = self.one(["", " ", "-", "."])
        forms: list[Callable[[], str]] = [
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: d(11), lambda: f"{d(3)} {d(3)} {d(3)} {d(2)}",
            lambda: f"{d(2)}.{d(3)}.{d(3)}-{self.one('0123456789X')}", lambda: f"{d(8)}{letter()}", lambda: f"{d(8)}-{letter()}", lambda: f"{d(2)}.{d(3)}.{d(3)}-{letter()}",
            lambda: f"{self.one('XYZ')}{d(7)}{letter()}", lambda: f"{self.one('XYZ')}-{d(7)}-{letter()}", lambda: f"{self.one('XYZ')}{d(1)}.{d(3)}.{d(3)}-{letter()}",
            lambda: f"{letter(2)}{gap}{d(2)}{gap}{d(2)}{gap}{d(2)}{gap}{self.one('ABCD')}", lambda: f"QQ {d(2)} {d(2)} {d(2)} {self.one('ABCD')}", lambda: f"{letter(2)}{d(6)}", lambda: f"{letter(2)}{d(7)}",
            lambda: f"{letter(3)}{d(6)}", lambda: f"{letter()}{d(8)}", lambda: d(9), lambda: f"XX-{d(2)}.{d(3)}.{d(3)}", lambda: f"XX{d(2)}{d(3)}{d(3)}-{letter()}", lambda: f"XA{d(7)}",
            lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{d(3)}{d(2)}{d(4)}",
        ]
        return self.one(forms)()

    def way(self, lang: str) -> str:
        """A street's name without a house number."""
        plain = [self.syllables(), self.one(FAMILY), self.one(["Oak", "Church", "High", "Park", "Mill", "Station", "Victoria", "King"])] if lang == "en" else [self.syllables(), self.one(FAMILY), self.one(GIVEN), self.one(["das Flores", "do Sol", "da Paz", "Mayor", "del Carmen", "Quinze de Novembro", "de Alcalá", "São Bento", "Real"])]
        word = self.one(plain) + (" " + self.syllables() if self.p(0.25) else "")
        kind = self.one(_WAYS[lang])
        return f"{word} {kind}" if lang == "en" else f"{kind}{'' if kind.endswith(' ') else ' '}{word}"

    def address(self, lang: str) -> str:
        n = str(self.r.integers(1, self.one([30, 300, 3000]))) + (self.one("ABC") if self.p(0.1) else "")
        if lang == "en":
            flat = self.one(["Flat", "Apt", "Unit", "Apartment", "Suite", "Apt.", "Flat"])
            unit = f"{self.r.integers(1, 60)}{self.one(['', 'A', 'B', ''])}"
            out = f"{n} {self.way(lang)}"
            x = self.r.random()
            return f"{flat} {unit}, {out}" if x < 0.15 else f"{out}, {flat} {unit}" if x < 0.3 else f"{out}, #{unit}" if x < 0.33 else out
        mark = self.one(["", "", "", "n.º ", "nº ", "n° ", "n. ", "núm. ", "número "])
        out = f"{self.way(lang)}{self.one([', ', ', ', ' '])}{mark}{n}"
        x = self.r.random()
        if x < 0.18:
            words = ["apto", "ap.", "apartamento", "casa", "bloco", "sala", "andar"] if lang == "pt" else ["piso", "puerta", "esc.", "bloque", "escalera", "apto", "apartamento"]
            out += f"{self.one([', ', ' - '])}{self.one(words)} {self.r.integers(1, 200)}{self.one(['', '', 'A'])}"
        elif x < 0.28:
            out += f", {self.r.integers(1, 9)}.º {self.one('ABCD')}" if lang == "es" else f", {self.one(['fundos', 'casa 2', '3º andar'])}"
        elif x < 0.31:
            out += ", bajo" if lang == "es" else " - fundos"
        return out

    def mention(self, kind: str, lang: str) -> str:
        return self.address(lang) if kind == "address" else getattr(self, kind)()

    # --- what only looks like one --------------------------------------------------

    def decoy(self, lang: str) -> str:
        d, w = self.digits, self.syllables
        return self.one([
            lambda: self.way(lang), lambda: f"{self.one(['Escola', 'Escuela', 'Colégio', 'Colegio', 'Hospital', 'Fundação', 'Fundación', 'Biblioteca', 'Parque', 'Ponte'])} {self.name().title()}",
            lambda: f"{w()} {self.one(['School', 'Foundation', 'Hospital', 'Library', 'Park', 'Bridge', 'Station', 'College', 'Trust', 'Ltd', 'Council'])}",
            lambda: f"{w()} {w()} {self.one(['School', 'Foundation', 'Hospital', 'Library', 'Primary School', 'Centre', 'Community Centre'])}",
            lambda: f"{self.one(['protocol', 'ticket', 'protocolo', 'ticket n.º', 'case', 'reference', 'pedido', 'expediente', 'TK', 'serial', 'invoice', 'factura', 'fatura', 'order', 'nota', 'changeset', 'segment', 'Kennzeichen'])}{self.one([' ', ': ', ' #', '-', ' no. '])}{self.one([d(6), d(4) + '-' + d(5), d(4) + '/' + d(4) + '/' + d(2), d(9) + '_' + d(9) + '_0', d(3) + '-' + d(2) + '-' + d(4), self.one('ABCKTX') + d(7), d(11), d(8)])}",
            lambda: f"{self.r.integers(1, 31)}/{self.r.integers(1, 13)}/20{d(2)}", lambda: f"20{d(2)}-0{self.r.integers(1, 10)}-{self.r.integers(10, 29)} {self.r.integers(0, 24)}:{self.r.integers(10, 60)}",
            lambda: f"{d(2)}.{d(5)}, -{d(1)}.{d(6)}", lambda: f"{self.one(['R$ ', '€', '£', '$'])}{self.r.integers(1, 999)}{self.one(['', '.', ',', '.000'])}{d(2)}", lambda: f"@{w().lower()}_{w().lower()}",
            lambda: f"https://{w().lower()}.example/{d(4)}", lambda: f"{self.r.integers(2, 900)} {self.one(['cm', 'm', 'metros', '%', 'minutes', 'minutos', 'días', 'dias', 'photos', 'steps', 'degraus', 'bicycles', 'votes'])}",
            lambda: f"{w()}", lambda: self.one(GIVEN), lambda: f"{self.one(['line', 'bus', 'linha', 'línea', 'room', 'sala', 'article', 'km', 'version', 'platform'])} {self.r.integers(1, 900)}",
            lambda: f"node_id={d(9)}", lambda: f"{w()} {self.one(['council', 'district', 'market', 'estate'])}", lambda: f"{self.one(['Praça', 'Plaza', 'Largo'])} {w()}", lambda: f"{d(3)} x {d(3)} px",
            lambda: f"entre {self.way(lang)} e {self.way(lang)}" if lang != "en" else f"between {self.way(lang)} and {self.way(lang)}",
        ])()

    # --- wording -----------------------------------------------------------------------

    def cued(self, kind: str, lang: str) -> tuple[str, str]:
        """(words that lead up to a mention, mention): often no words, but plain
        digits could be anything and never stand without."""
        said = self.mention(kind, lang)
        bare = all(c.isdigit() or c in " -." for c in said)
        return ("" if self.p(0.05 if bare else 0.55) else self.one(_CUES[kind][lang])), said

    def title(self, lang: str) -> str:
        return self.one({"en": ["Mr ", "Mrs ", "Ms ", "Dr ", "Mr. ", "Prof. ", "Miss "], "pt": ["Sr. ", "Sra. ", "Dr. ", "Dra. ", "o senhor ", "a dona ", "D. "], "es": ["Sr. ", "Sra. ", "don ", "doña ", "D. ", "Dra. ", "el señor "]}[lang]) if self.p(0.25) else ""

    def sentence(self, lang: str) -> list[Piece]:
        """Chunks in random order: fillers, cues with mentions, look-alikes."""
        out: list[Piece] = []
        add = lambda t: out.append((t, None))
        opening = self.r.random()
        if opening < 0.25:
            out += [(self.title(lang), None), (self.name(), "name")]
            add(" " + self.one(_VERBS[lang]))
        elif opening < 0.8:
            add(self.one(_FILL[lang]).capitalize())
        else:
            add(self.words(int(self.r.integers(2, 7))).capitalize())
        for _ in range(int(self.r.integers(1, 5))):
            x = self.r.random()
            gap = self.one([" ", " ", " ", ", ", " - ", ": ", "; ", " (", " " + self.one(_LINKS[lang]) + " "])
            if x < 0.62:
                kind = self.one(["name", "name", "email", "phone", "identity", "address"])
                cue, said = self.cued(kind, lang)
                add(gap + cue)
                if kind == "name":
                    add(self.title(lang))
                out.append((said, kind))
            elif x < 0.78:
                add(gap + self.decoy(lang))
            else:
                add(gap + (self.one(_FILL[lang]) if self.p(0.6) else self.words(int(self.r.integers(1, 6)))))
            if gap == " (":
                add(")")
        if self.p(0.5):
            add(self.one([" ", ", "]) + (self.one(_TAILS[lang]) if self.p(0.6) else self.words(int(self.r.integers(1, 6)))))
        add(self.one([". ", ". ", ".", "! ", "? ", "\n", "\n\n", "; ", " "]))
        return out

    def words(self, n: int) -> str:
        text = self.one(self.corpus) if self.corpus else "the ramp is closed and the kerb is high"
        said = [w for w in text.split()[:400] if w.isalpha() and w.islower()] or ["the"]
        at = int(self.r.integers(len(said)))
        return " ".join(said[at : at + n])

    def lines(self, lang: str) -> list[Piece]:
        """A signature, a form or a record with separators."""
        kinds = [self.one(["name", "email", "phone", "identity", "address"]) for _ in range(int(self.r.integers(2, 6)))]
        out: list[Piece] = []
        style = self.r.random()
        sep = "\n" if style < 0.6 else self.one([";", " | ", ", ", "\t", " / ", ";"])
        for k in kinds:
            said = self.mention(k, lang)
            bare = all(c.isdigit() or c in " -." for c in said)
            label = self.one(_LABELS[k][lang]) + self.one([": ", ":", " = ", "=", " - ", ". ", " "]) if self.p(0.9 if bare else 0.5) else ""
            if self.p(0.15):
                out.append((self.decoy(lang) + sep, None))
            out += [(label, None), (said, k), (sep, None)]
        return [(self.one(["", "-- \n", "\n"]), None), *out, ("\n", None)]

    def planted(self, lang: str, carrier: str) -> list[Piece]:
        """A mention anywhere between two words of running text."""
        spots = [i for i, c in enumerate(carrier) if c == " "]
        if not spots:
            return [(carrier, None)]
        at = int(self.one(spots))
        kind = self.one(["name", "name", "email", "phone", "identity", "address"])
        before = self.one([" ", " ", " ", " ", ", ", " (", ": ", " " + self.one(_LINKS[lang]) + " "])
        after = ") " if before == " (" else self.one([" ", " ", " ", " ", ", ", ". ", "; ", " " + self.one(_LINKS[lang]) + " "])
        cue, said = self.cued(kind, lang)
        return [(carrier[:at] + before + cue, None), (said, kind), (after + carrier[at + 1 :], None)]

    def salad(self, lang: str) -> list[Piece]:
        """Common words in any order around one or two mentions, like a short sentence."""
        pool = _SMALL[lang]
        few = lambda low, high: " ".join(self.one(pool) for _ in range(int(self.r.integers(low, high))))
        out: list[Piece] = [(few(0, 6), None)]
        for _ in range(int(self.r.integers(1, 3))):
            kind = self.one(["name", "name", "name", "email", "phone", "identity", "address"])
            cue, said = self.cued(kind, lang)
            lead = "" if out[-1][0] == "" else self.one([" ", " ", " ", ", ", ": "])
            out += [(lead + cue, None), (said, kind), (self.one([" ", " ", ", ", ", ", ": ", "; "]) + few(1, 6), None)]
        text, _ = out[0]
        out[0] = (text[:1].upper() + text[1:], None)
        return [*out, (self.one([". ", ".", "\n", "? ", "! "]), None)]

    def text(self, carriers: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of some sentences, records and carriers, with its spans."""
        lang = self.one(["en", "pt", "es"])
        pieces: list[Piece] = []
        for _ in range(int(self.r.integers(2, 6))):
            x = self.r.random()
            if x < 0.45:
                pieces += self.sentence(lang)
            elif x < 0.55:
                pieces += self.lines(lang)
            elif x < 0.7:
                pieces += self.salad(lang)
            elif carriers:
                tongue, carrier = self.one(carriers)
                pieces += self.planted(tongue, carrier) + [(self.one([" ", "\n"]), None)]
            else:
                pieces.append((self.one(_FILL[lang]).capitalize() + ". ", None))
        return join(pieces, self.one([None, None, None, " ", "  ", "\n"]) if self.p(0.3) else None, self.r)


def join(pieces: list[Piece], space: str | None = None, r: np.random.Generator | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text of the pieces and the spans of the labelled ones; `space` stands for some of the blanks."""
    parts, spans, at = [], [], 0
    for text, kind in pieces:
        if space is not None and r is not None and r.random() < 0.2:
            text = text.replace(" ", space, 1)
        if kind and text:
            spans.append((at, at + len(text), kind))
        parts.append(text)
        at += len(text)
    return "".join(parts), spans


_LINKS = {"en": ["and", "or", "with", "for", "to", "of", "by", "from", "at", "then"], "pt": ["e", "ou", "com", "para", "de", "por", "no", "da", "ao"], "es": ["y", "o", "con", "para", "de", "por", "en", "al", "del"]}
_FILL = {
    "en": ["the lift has been broken since spring", "please fix the pavement", "we measured the slope twice", "nobody answered our letter", "thanks for the quick reply", "the crossing is far too short", "I use a wheelchair every day", "the meeting was moved", "a van blocks the dropped kerb", "records show", "according to the register", "a resident", "the tenant", "this morning", "last week", "our volunteer", "the form was filled in", "payment is due", "hello", "dear team", "as discussed", "the witness", "my neighbour", "the patient", "an applicant", "this account belongs", "the parcel should go", "for the appointment"],
    "pt": ["a calçada está quebrada", "o elevador não funciona desde março", "ninguém respondeu à carta", "obrigada pela resposta", "uso cadeira de rodas", "a reunião foi adiada", "um carro bloqueia a rampa", "segundo o cadastro", "um morador", "a inquilina", "hoje de manhã", "na semana passada", "a voluntária", "o formulário foi preenchido", "bom dia", "prezados", "conforme combinado", "a testemunha", "meu vizinho", "o paciente", "a conta pertence", "a encomenda deve ir", "para o agendamento", "esta travessia é curta"],
    "es": ["la acera está rota", "el ascensor no funciona desde marzo", "nadie respondió a la carta", "gracias por la respuesta", "uso silla de ruedas", "la reunión se aplazó", "un coche bloquea la rampa", "según el registro", "un vecino", "la inquilina", "esta mañana", "la semana pasada", "nuestra voluntaria", "el formulario se rellenó", "buenos días", "estimados señores", "como acordamos", "la testigo", "mi vecino", "el paciente", "la cuenta pertenece", "el paquete debe ir", "para la cita", "el cruce es demasiado corto"],
}
_SMALL = {
    "en": "the a our my your this that who was is has had will did not never only also with from for to by and or but then again yesterday today tomorrow key door bus stop step hall form list note letter works man woman owner driver clerk asked told gave took left met saw sent paid signed lost found waits knows says reads brought called spoke at on in under before after since while because please thank see tell".split(),
    "pt": "o a os as um uma meu minha seu sua este essa quem foi é tem tinha vai não nunca só também com de para por e ou mas então hoje ontem amanhã chave porta ônibus parada degrau lista bilhete carta homem mulher dono motorista pediu disse deu pegou deixou viu mandou pagou assinou perdeu achou espera sabe fala trouxe chamou em no na sob antes depois desde porque favor veja avise pela pelo lá aqui".split(),
    "es": "el la los las un una mi su este esa quien fue es tiene tenía va no nunca solo también con de para por y o pero luego hoy ayer mañana llave puerta autobús parada escalón lista nota carta hombre mujer dueño conductor pidió dijo dio cogió dejó vio mandó pagó firmó perdió encontró espera sabe habla trajo llamó en al del bajo antes después desde porque favor vea avise allí aquí lo se nos".split(),
}
_VERBS = {
    "en": ["wrote", "called us", "lives there", "asked for help", "signed", "was present", "complained about the noise", "moved", "is waiting", "will collect the key", "said that the step is too high", "fell", "agreed", "has not paid yet", "sent a photo", "works here"],
    "pt": ["escreveu", "ligou", "mora ali", "pediu ajuda", "assinou", "estava presente", "reclamou do barulho", "mudou-se", "aguarda", "vai buscar a chave", "disse que o degrau é alto", "caiu", "concordou", "ainda não pagou", "enviou uma foto", "trabalha aqui"],
    "es": ["escribió", "llamó", "vive allí", "pidió ayuda", "firmó", "estuvo presente", "se quejó del ruido", "se mudó", "espera", "recogerá la llave", "dijo que el escalón es alto", "se cayó", "aceptó", "todavía no ha pagado", "envió una foto", "trabaja aquí"],
}
_TAILS = {
    "en": ["before noon", "thank you", "as soon as possible", "for further details", "on weekdays only", "and wait for a reply", "was given", "is wrong", "if it rains", "please"],
    "pt": ["antes do meio-dia", "obrigado", "o quanto antes", "para mais detalhes", "só em dias úteis", "e aguarde", "foi informado", "está errado", "se chover", "por favor"],
    "es": ["antes del mediodía", "gracias", "cuanto antes", "para más detalles", "solo entre semana", "y espere", "fue facilitado", "está mal", "si llueve", "por favor"],
}
_LABELS = {
    "name": {"en": ["Name", "Full name", "Contact", "Signed", "From", "To", "Attn"], "pt": ["Nome", "Nome completo", "Contato", "Assinado", "De", "Para"], "es": ["Nombre", "Nombre y apellidos", "Contacto", "Firmado", "De", "Para"]},
    "email": {"en": ["Email", "E-mail", "Mail", "e-mail"], "pt": ["E-mail", "Correio", "email"], "es": ["Correo", "E-mail", "Correo electrónico"]},
    "phone": {"en": ["Phone", "Tel", "Tel.", "Mobile", "Cell", "Fax", "T"], "pt": ["Telefone", "Tel.", "Celular", "Fone", "WhatsApp"], "es": ["Teléfono", "Tel.", "Móvil", "Tfno.", "Fax"]},
    "identity": {"en": ["ID", "SSN", "Passport", "National ID", "NI number", "ID no.", "card"], "pt": ["CPF", "RG", "Documento", "Identidade", "Passaporte", "CIN"], "es": ["DNI", "NIE", "NIF", "Documento", "Pasaporte", "CURP"]},
    "address": {"en": ["Address", "Addr.", "Home address", "Delivery"], "pt": ["Endereço", "End.", "Residência", "Morada"], "es": ["Dirección", "Domicilio", "Dir."]},
}
_CUES = {
    "name": {
        "en": ["my colleague ", "ask for ", "signed by ", "I am ", "this is ", "on behalf of ", "the owner is ", "written by ", "speak to ", "thanks, ", "regards, ", "Dear ", "according to ", "her husband ", "tenant ", "engineer ", "nurse ", "witness "],
        "pt": ["minha colega ", "procure ", "assinado por ", "eu sou ", "aqui é ", "em nome de ", "o dono é ", "escrito por ", "fale com ", "abraços, ", "Caro ", "segundo ", "o marido dela, ", "inquilino ", "engenheira ", "a enfermeira "],
        "es": ["mi compañera ", "pregunte por ", "firmado por ", "soy ", "le habla ", "en nombre de ", "el dueño es ", "escrito por ", "hable con ", "saludos, ", "Estimado ", "según ", "su marido ", "inquilino ", "la ingeniera ", "la enfermera "],
    },
    "email": {
        "en": ["write to ", "email ", "my address is ", "reply to ", "mail ", "send it to ", "via ", "contact "], "pt": ["escreva para ", "meu e-mail é ", "responda a ", "mande para ", "pelo e-mail ", "contato "], "es": ["escriba a ", "mi correo es ", "responda a ", "envíelo a ", "por correo a ", "contacto "],
    },
    "phone": {
        "en": ["call ", "phone ", "ring ", "my number is ", "text ", "reach me on ", "dial ", "tel ", "at "], "pt": ["ligue ", "telefone ", "meu número é ", "chame no ", "whatsapp ", "pelo ", "tel ", "disque "], "es": ["llame al ", "teléfono ", "mi número es ", "marque ", "whatsapp ", "al ", "tel "],
    },
    "identity": {
        "en": ["SSN ", "SSN is ", "passport ", "ID ", "identity card ", "national insurance ", "with document ", "social security number ", "her ID number is ", "NHS ", "licence holder "], "pt": ["CPF ", "RG ", "documento ", "identidade ", "portador do CPF ", "o CPF dele é ", "passaporte ", "inscrito sob o "], "es": ["DNI ", "NIE ", "con DNI ", "documento ", "su DNI es ", "pasaporte ", "identificado con ", "NIF "],
    },
    "address": {
        "en": ["at ", "lives at ", "to ", "from ", "my house is ", "deliver to ", "near ", "opposite ", "outside ", "the flat at "], "pt": ["na ", "mora na ", "para a ", "da ", "em frente à ", "minha casa fica na ", "entregar na ", "perto da "], "es": ["en ", "vive en ", "a ", "de ", "frente a ", "mi casa está en ", "entregar en ", "cerca de "],
    },
}
