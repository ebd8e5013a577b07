"""Personal information inside free text: its places, and the text with typed placeholders in their stead.

High-recall generators propose overlapping spans of five types. Every capitalised word that is no function word begins candidates
for a name, alone and with the words that follow it. Boosted trees, one model a type, score each span by its format and its
context; scores are calibrated, and of overlapping spans above their thresholds the most probable stays. One feature of words is
their place in public tokenizers' vocabularies (``LEXICON``), once in lower case and once as written: a name is rarely frequent in
lower case. The models are fitted by ``pii_training`` on sentences of a grammar and kept in ``pii_models.json``; without that file
they are fitted anew.

Scale: texts are independent; one pass without a shuffle, scores for a whole batch at a time. Models and lexicon (at most the
vocabularies' size) travel with the tasks.

Defined results: null and empty texts have no mentions and stay as they are. Positions count Unicode code points. Repeated rows
count once in the list of mentions.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from math import log2
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.boosting import Boosted

TYPES = ("email", "phone", "id_number", "address", "name")

# Common given names of several languages.
GIVEN = frozenset(
    "Adam Adele Ahmed Aisha Albert Alejandro Alex Alice Amina Ana Anders Andrea Andrei Anna Antonio Aoife Arjun Astrid Aylin Beatriz Bruno Camille Carla Carlos Carmen Cem Charlotte Chen Chloe Chloé Clara Claire Daniel David Diego Dmitri Elena "
    "Elias Elif Elise Elsa Emil Emma Erik Eva Fatima Felix Fernando Fiona Francesca Frank Frida Gabriel Giulia Greta Hanna Hannah Hans Hassan Helena Henrik Hugo Ibrahim Ines Ingrid Irina Iris Isabel Ivan Ivo Jack James Jan Jana Javier Jean Jens Joana "
    "Johan John Jonas José Jose Julia Jürgen Juan Karim Karin Katarina Keiko Kenji Kofi Lars Laura Lea Leila Lena Leon Liam Lina Linda Lucas Lucia Luis Lukas Magnus Maja Marco Maria Marie Mario Marta Martin Mateo Matteo Max Mei Mia Michael Miguel Mina Mohammed Nadia "
    "Natalia Nina Noah Noor Nora Olga Oliver Olivia Omar Oscar Otto Pablo Patrick Paul Paula Pavel Pedro Peter Petra Pierre Priya Rafael Ravi Robert Rosa Samir Samuel Sara Sarah Simon Sofia Sophie Stefan Sven Tariq Thomas Tomas Tomás Viktor Wei Yuki Yusuf Zoe Zoë".split()
)
_GIVEN_LOWER = frozenset(x.lower() for x in GIVEN)
LEXICON = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
MODELS = Path(__file__).with_name("pii_models.json")

# Classes of words around names, several languages together.
_FUNCTION = frozenset(
    "the a an this that these those and or but if when while where who what why how our your their his her its my we you they he she it i in on at by to from for of with about after before under over as is are was were be been has have had do does did not no nothing so then than there here also only even just still yet"
    " please thanks cheers regards hi hello hey dear best kind warm see fixed each every any some one two both all another such into since until between through because although however therefore maybe perhaps today yesterday tomorrow can could should would shall must may might let ok yes"
    " der die das ein eine einen einem einer des dem den im in bitte und oder wenn frau herr ist sind war wird nicht auch mit von zu bei für auf aus nach liebe lieber hallo viele grüße ich wir sie er es unser mein"
    " le la les l un une des du de et ou il elle nous vous ils je est sont dans sur avec pour par qui que ce cette bonjour merci cordialement mon ma mes notre"
    " el los las una unos y o hay lo del al en con por para que se su sus mi nuestro es son hola gracias saludos esta este señor señora don doña monsieur madame mr mrs ms dr prof mme mlle sr sra".split()
)
_PERSON = frozenset(
    "by from to cc bcc with and und et y for reporter reported author authors owner assignee assigned name names user users contact contacts signed-off-by co-authored-by reviewed-by acked-by tested-by reviewer approver manager lead colleague customer client caller employee patient teacher friend boss engineer maintainer attn attention attendees participants spoke speak talk talked ask asked tell told met meet call called ping thank according"
    " escalated handed between sister brother wife husband mother father daughter son von an bei mit kollege kollegin kontakt ansprechpartner gemeldet par signalé auteur collègue nom nombre por con autor informó llamar fullname full_name customer_name first_name created_by updated_by approved-by cher chère estimado estimada liebe lieber dear hi hello hey hallo hola bonjour thanks cheers regards best grüße saludos cordialement sincerely atentamente".split()
)
_GREET = frozenset("hi hello hey dear hallo hola bonjour liebe lieber cher chère estimado estimada thanks cheers regards best grüße saludos cordialement sincerely atentamente wishes merci gracias danke".split())
_TITLES = frozenset("dr prof mr mrs ms miss mx sir herr herrn frau m mme mlle monsieur madame sr sra srta señor señora don doña signor signora sig".split())
_PARTICLE = frozenset("van von de da der den del di la le du bin al el ibn ter ten zu dos".split())
_THING = frozenset(
    "class classes codename release version cluster rename branch host server node project product module package helper bot type struct interface job jobs model table schema called named batch build service store pool database queue pipeline runner manual filter guide chapter section page ticket rule file files library framework plugin driver engine app team company"
    " method function field enum variable object instance topic channel repo repository tag image container pod namespace stage environment api sdk tool editor city town country region river airport storm hurricane law theorem algorithm loop cache router reader writer client handler session parser scanner index planner broker inc gmbh ltd corp llc ag sa university institute".split()
)
_COMMUNICATION = frozenset(
    "wrote writes said says asked asks reported mentioned will would has thinks suggested approved merged opened filed confirmed told prüft schrieb meldet bittet sagt fragt relit écrit demande signale dit revisa escribió pide dice signe agrees disagrees noticed explained wants needs knows believes can could did and und et y is was from".split()
)
_AND = frozenset(("and", "und", "et", "y"))
_DATES = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember lundi mardi mercredi jeudi vendredi".split())

_CAP = r"(?:[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[\w’']*(?:-[A-ZÀ-ÖØ-Þ][\w’']*)*)"
_EMAIL = re.compile(
    r"(?P<plain>[A-Za-z0-9À-ÿ](?:[\w.+'-]*[\w+-])?(?:@|%40|&#64;|&commat;)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*)"
    r"|(?P<marked>[A-Za-z0-9À-ÿ][\w.+-]*\s?[\[({<]\s?(?:at|AT|At|@|ät)\s?[\])}>]\s?[A-Za-z0-9-]+(?:(?:\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|\.)\s?[\])}>]\s?|\.)[A-Za-z0-9-]+)+)"
    r"|(?P<worded>[A-Za-z0-9À-ÿ][\w.+-]*\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)+)"
)
_AT = re.compile(r"@|%40|&#64;|&commat;|\[\s?(?:at|AT|At|@|ät)\s?\]|\(\s?(?:at|AT|At|@|ät)\s?\)|\{\s?(?:at|AT|At|@|ät)\s?\}|<\s?(?:at|AT|At|@|ät)\s?>| (?:at|AT) (?=[\w-]+ (?:dot|DOT) )")
#: A run of digits with what may stand between them; numbers and identity numbers hold one, or part of one.
_RUN = re.compile(r"\d[\dA-Z ./()+-]*")
_RUN_LEAD, _CUE_LEAD, _WAY_LEAD, _WAY_TAIL = 12, 64, 96, 160
#: Digits in a run from which it can hold a number of a person.
_RUN_DIGITS = 5
_NUMBER = re.compile(r"(?<![\w@#+])(?!\d{4}-\d\d-\d\d(?!\d))(?:\+ ?|\(\+)?\(?\d{1,12}\)?(?:(?:[ .\-/]| ?[-/–] )\(?\d{1,10}\)?){0,8}(?![\w@%])(?!\.\d)")
_ID = re.compile(
    r"(?<![\w@#/.-])(?:(?P<dashed>\d{3}-\d{2}-\d{4})|(?P<spaced>\d{3} \d{2} \d{4})|(?P<insee>[1-478] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?)|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d{2})|(?P<fours>\d{4} \d{4} \d{4}(?! ?\d))|(?P<birth>\d{6}[-+A]\d{3}[\dA-Z])|(?P<threes>\d{3}[ -]\d{3}[ -]\d{3,4}(?![ -]?\d))|(?P<ein>\d{2}-\d{7})|(?P<twos>\d{2} \d{3} \d{3} \d{3})|(?P<licence>[A-Z]{5}\d{6}[A-Z]{2}\d?[A-Z]{1,2}\d?)"
    r"|(?P<pan>[A-Z]{5}\d{4}[A-Z])|(?P<fiscal>[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])|(?P<mixed>[CFGHJKLMNPRTVWXYZ]\d[CFGHJKLMNPRTVWXYZ\d]{7})|(?P<letter>[A-Z]{1,2}\d{6,12}[A-Z]?)|(?P<nie>[XYZ]-?\d{7}-?[A-Z])|(?P<dni>\d{8}-?[A-Z])|(?P<tail>\d{2,3}[ /]\d{3}[ /]\d{4,5})|(?P<long>\d{9,12}))(?![\w@-])"
)
_ID_GROUPS = tuple(_ID.groupindex)
_ID_CUE = r"passport|passeport|pasaporte|reisepass\w*|pass-?nr|ssn|social security|social insurance|national insurance|national id|id card|identity|identification|tax id|tax number|taxpayer|tin|nif|nie|dni|cpf|pan|aadhaar|bsn|pesel|nino|sin|nhs|insee|nir|sozialversicherung\w*|steuer\w*|ausweis\w*|personalausweis\w*|numéro|documento|document no|cédula|carné|codice fiscale|licen[cs]e|driver'?s licen[cs]e|driving licen[cs]e|personnummer|id no|sécurité sociale|seguridad social|resident permit|visa number"
#: The cue as a word of the text in lower case (what comes before is looked at apart), and the number that may follow it.
_ID_WORD = re.compile(rf"(?:{_ID_CUE})(?![^\W_])")
_ID_OPEN = re.compile(r"(?:'s)?(?: (?:card|id|ID|permit))?[\s:=#.\"',]*(?i:no\.?|nr\.?|number|nummer|num|is|ist|est|es)?(?: (?:is|ist|est|es))?[\s:=#\"',]*([A-Z0-9](?:[A-Z0-9]|[ ./-](?=[A-Z0-9]*\d|[A-Z]\b)){4,18})(?!\w)")
_TOWN = rf"(?:\d{{4,5}}(?:-\d{{4}})?\s+)?{_CAP}(?:[ -](?:{_CAP}|am|an|der|de|la|le|sur|upon|del))*(?:[ ,]+(?:[A-Z]{{2}} )?\d{{4,5}}(?:-\d{{4}})?\b)?"
_UNIT = r"(?:(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Room|Piso|Appt|Bât|Etage|OG|Top)\.? ?#?\w+|\d+\s?º(?: ?[A-Z])?|#\d+)"
_WAY = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Terrace|Ter|Place|Pl|Square|Sq|Close|Crescent|Parkway|Pkwy|Highway|Hwy|Row|Walk|Gardens|Grove|Mews|Circle|Trail)\b\.?"
_RUE = r"rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route"
_STRASSE = r"straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|Straße|Weg|Allee|Platz"
_CALLE = r"Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Travesía|Via|Viale|Piazza|Rua"
_BOX = r"P\.? ?O\.? ?Box|Post Office Box|Postfach|Apartado(?: de correos)?|Apdo\.?|Boîte postale|BP|Casella postale"
_ADDRESS = re.compile(
    rf"(?:(?P<number>(?:{_UNIT},? )?\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\. ?)?(?:{_CAP} ){{1,3}}{_WAY})"
    rf"|(?P<french>\d{{1,4}}(?: ?bis| ?ter)?,? (?:{_RUE})(?: (?:de la|des|du|de|d['’]|l['’]))? ?{_CAP}(?:[ -]{_CAP})*)"
    rf"|(?P<german>(?:(?:Am|Im|Zum|Zur|(?:An|Auf|Bei|Hinter|In|Unter|Vor) de[rmn]|{_CAP}) )?[A-ZÄÖÜ][\w-]*?(?:{_STRASSE}) ?\d{{1,4}} ?[a-z]?\b)"
    rf"|(?P<spanish>(?:{_CALLE})(?: (?:de la|de los|de las|del|de|da|do))? ?{_CAP}(?: {_CAP})*,? \d{{1,4}})"
    rf"|(?P<box>(?:{_BOX}) \d{{1,6}}))"
    rf"(?P<unit>(?:,? {_UNIT})?)(?P<town>(?:(?:,\s*|\s*\n[ \t]*|, ?\n\s*){_TOWN})?)"
)
#: The word that every alternative of the pattern holds, as ``_WORD`` cuts it; patterns run around such words only.
_WAY_WORD = re.compile(rf"{_WAY}|{_RUE.replace(chr(92) + '.', '')}|[\w-]*(?:{_STRASSE.replace(chr(92) + '.', '')})\d*[a-z]?|{_CALLE.replace('C/', 'C')}|Box|Postfach|Apartado|correos|Apdo|postale|BP|Avda")
_CUES = {
    "phone": re.compile(r"(?i)\b(?:phones?|tel|telephone|telefono|teléfono|téléphone|telefon|call(?:s|ed|ing)?|caller|mobile|mobil|móvil|portable|cell|fax|reach|ring|dial|whatsapp|signal|sms|text me|text|hotline|on-call|joignable|erreichbar|appel\w*|llam\w+|anruf\w*|rufnummer|handy|contact|owner|numéro|number is|my number|ask)\b"),
    "id": re.compile(rf"(?i)\b(?:{_ID_CUE}|record|identity number|citizen)\b"),
    "address": re.compile(r"(?i)\b(?:address|adresse|anschrift|dirección|domicile|lives?|living|reside\w*|wohn\w+|habite|vive|ship|shipped|deliver\w*|send|mail it|office|invoice|street|located|moved|parcel|package to|liefer\w+|livr\w+|enviar|envíe|zu hause|home|record|visit|meet)\b"),
    "number": re.compile(r"(?i)\b(?:tickets?|builds?|orders?|offsets?|pages?|lines?|versions?|release|trace|sha|commit|revision|fixed in|ports?|pid|jobs?|rows?|issues?|cwe|items?|bytes|files?|bug|run|serial|part|sku|invoice no|batch|ms|hash|id=|seq|uuid|isbn|account no|rule|at|range|from|offset|count|total|size|timestamp|tracking|case|reference|ref|model|catalog|block|request|error|code)\b[\s:#=.-]*"),
}


class Word(NamedTuple):
    """What a word is by itself."""

    cap: bool
    function: bool
    given: bool
    kinds: tuple[float, ...]
    #: Places in the lexicon, in lower case and as written, as 0 (absent) to 16 (most frequent).
    lower: float
    written: float
    low: str
    #: Whether it may begin a name, and whether it may name a way or a box.
    begins: bool
    way: bool


class Lexicon:
    """The words of a vocabulary by their rank, and what is derived of them for a word; derived entries are bounded."""

    def __init__(self, ranks: dict[str, int], most: int = 200_000) -> None:
        self.ranks, self.most = ranks, most
        self._known: dict[str, Word] = {}

    def __reduce__(self):
        return Lexicon, (self.ranks, self.most)

    def word(self, w: str) -> Word:
        got = self._known.get(w)
        if got is None:
            if len(self._known) >= self.most:
                self._known.clear()
            got = self._known[w] = self._make(w)
        return got

    def _make(self, w: str) -> Word:
        low = w.lower()
        core = low.replace("’", "'")
        cap = w[0].isupper() or w[:2] in ("o'", "d'") and w[2:3].isupper()
        written = w.capitalize() if w.isupper() and len(w) > 1 else w
        rank = lambda x: 16 - log2(2 + self.ranks[x]) if x in self.ranks else 0.0
        body = re.sub(r"^(?:Mc|Mac|De|Van|O['’]|D['’])", "", w)
        kinds = (
            float(core in _PERSON), float(core in _THING), float(core in _COMMUNICATION), float(core in _DATES), float(w.isupper() and len(w) > 1), float(bool(re.search(r"[a-zß-ÿ][A-ZÀ-Þ]", body))),
            float(not cap and core.endswith(("ed", "te"))), float(not cap and core.endswith("s")), float("'" in core), float("-" in core), float(len(w)),
        )
        return Word(cap, core in _FUNCTION, low in _GIVEN_LOWER, kinds, max(rank(low), max((rank(x) for x in low.split("-")), default=0) if "-" in low else 0), rank(written), core, cap or low in _GIVEN_LOWER or (not core in _FUNCTION and rank(low) == 0), bool(_WAY_WORD.fullmatch(w)))


@lru_cache(maxsize=2)
def lexicon(paths: tuple[str, ...] = LEXICON) -> Lexicon:
    """The words of byte-level BPE vocabularies, those that follow a blank, by their lowest rank."""
    ranks: dict[str, int] = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            for line in f:
                token, _, rank = line.partition(" ")
                try:
                    word = base64.b64decode(token).decode()
                except UnicodeDecodeError:
                    continue
                if word[:1] == " " and word[1:].isalpha():
                    ranks[word[1:]] = min(int(rank), ranks.get(word[1:], 1 << 17))
    return Lexicon(ranks)


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    form: int


def _near(cue: re.Pattern[str], text: str) -> tuple[float, float]:
    """How near a cue stands before the end of the text: 1 next to it, towards 0 farther off, 0 for none; and the same within 16 characters."""
    n, end = len(text), -1
    for m in cue.finditer(text):
        end = m.end()
    if end < 0:
        return 0.0, 0.0
    return 1 - (n - end) / (n + 8), max(0.0, 1 - (n - end) / 16)


def _windows(text: str, marks: Iterable[tuple[int, int]], lead: int, tail: int) -> list[tuple[int, int]]:
    """The places around the marks, joined where they touch, cut between words."""
    out: list[list[int]] = []
    for s, e in marks:
        s, e = max(0, s - lead), min(len(text), e + tail)
        while s and (text[s - 1].isalnum() or text[s - 1] == "_"):
            s -= 1
        while e < len(text) and (text[e].isalnum() or text[e] == "_"):
            e += 1
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def candidates(t: Text) -> list[Candidate]:
    """Spans that may be mentions of the other types; they overlap, within and across types.

    Patterns run in windows around what each of their matches holds: an at sign, a run of digits, a word for a way.
    """
    text = t.text
    out: list[Candidate] = []
    last = 0
    for a in _AT.finditer(text):
        s = a.start()
        if s and a.group()[0] in "[({<" and text[s - 1].isspace():
            s -= 1
        end = s
        while s > last and (text[s - 1].isalnum() or text[s - 1] in "._+'-"):
            s -= 1
        while s < end and not text[s].isalnum():
            s += 1
        m = _EMAIL.match(text, s) if s < end else None
        if m:
            last = m.end()
            out.append(Candidate(0, m.start(), m.end(), ("plain", "marked", "worded").index(m.lastgroup)))
    runs = [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= _RUN_DIGITS and sum(map(str.isdigit, m.group())) >= _RUN_DIGITS]
    for a, b in _windows(text, runs, _RUN_LEAD, 2):
        for m in _NUMBER.finditer(text, a, b):
            s, e = m.span()
            digits = sum(map(str.isdigit, m.group()))
            if digits < 7 or digits > 15:
                continue
            if text[s] == "(" and not re.match(r"\(\+?\d{2,5}\)", text[s:e]):
                s += 1
            while e > s and text[e - 1] in " ).-/" and not (text[e - 1] == ")" and text.count("(", s, e) >= text.count(")", s, e)):
                e -= 1
            out.append(Candidate(1, s, e, 0))
        for m in _ID.finditer(text, a, b):
            out.append(Candidate(2, m.start(), m.end(), _ID_GROUPS.index(m.lastgroup)))
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(c.lower()[:1] for c in text)
    for a, b in _windows(text, runs, _CUE_LEAD, 2):
        at = a
        while cue := _ID_WORD.search(low, at, b):
            at = cue.end()
            if cue.start() and text[cue.start() - 1].isalnum():
                at = cue.start() + 1
                continue
            m = _ID_OPEN.match(text, at, b)
            if m and sum(map(str.isdigit, m.group(1))) >= _RUN_DIGITS:
                out.append(Candidate(2, m.start(1), m.end(1), len(_ID_GROUPS)))
                at = m.end()
    ways = [(t.places[2 * i], t.places[2 * i + 1]) for i, w in enumerate(t.words) if w.way]
    for a, b in _windows(text, ways, _WAY_LEAD, _WAY_TAIL):
        for m in _ADDRESS.finditer(text, a, b) if _DIGIT(text, a, b) else ():
            kind = next(i for i, g in enumerate(("number", "french", "german", "spanish", "box")) if m.group(g))
            out.append(Candidate(3, m.start(), m.end(), kind))
    return out


_WORD = re.compile(r"([^\W\d_](?:[^\W_]|['’](?=[^\W\d_]{2,}))*(?:-[^\W\d_][^\W_]*(?:['’][^\W\d_]{2,})?)*)")
_DIGIT = re.compile(r"\d").search
_FORMS = ("one", "two", "three", "initials", "short", "turned", "particle", "lower")
_NO_WORD = Word(False, True, False, (0.0,) * 11, 0.0, 0.0, "", False, False)
#: What stands between words, as a number: nothing special first, then by how much it parts them.
_GAPS = {" ": 1.0, ", ": 2.0, ": ": 3.0, ":": 3.0, "=": 4.0, "\n": 5.0, ",\n": 5.0, "\n\n": 6.0, ". ": 7.0, ".\n": 7.0, ' "': 8.0, '": "': 9.0, ' <': 10.0, " (": 11.0, "-": 12.0, ".": 13.0, "/": 14.0, "_": 14.0, "": 15.0, "; ": 16.0, ";": 16.0, ",": 17.0, ") ": 18.0, '", ': 19.0, "> ": 18.0}


class Text:
    """A text's words with what they are, and what stands between them."""

    __slots__ = ("text", "places", "words", "gaps", "n")

    def __init__(self, text: str, lex: Lexicon) -> None:
        parts = _WORD.split(text)
        self.text, self.gaps = text, parts[::2]
        #: Word i begins at places[2 i] and ends at places[2 i + 1].
        self.places = list(accumulate(map(len, parts)))
        known = lex._known
        self.words = list(map(known.get, parts[1::2]))
        if None in self.words:
            self.words = [w or lex.word(p) for w, p in zip(self.words, parts[1::2], strict=True)]
        self.n = len(self.words)

    def gap(self, i: int) -> str:
        """The text before word i, back to the word before it."""
        return self.gaps[i]


def name_candidates(t: Text) -> list[tuple[int, int, int, int, int]]:
    """``(first word, last word, start, end, form)`` of the spans that may be names."""
    out: list[tuple[int, int, int, int, int]] = []
    text, places, words, n = t.text, t.places, t.words, t.n
    for i, w in enumerate(words):
        if not w.begins:
            continue
        s, e = places[2 * i], places[2 * i + 1]
        before = text[s - 1] if s else " "
        if before.isalnum() or before in "_@#\\$./" and not (before == "." and s > 1 and text[s - 2].isalpha() and i and places[2 * i - 1] == s - 1 and words[i - 1].kinds[10] == 1):
            continue
        if not w.cap:
            # in lower case: a listed given name, or a word the lexicon lacks as the value of a key for persons or behind a greeting
            if w.function or i + 1 >= n or not (w.given or (i and words[i - 1].kinds[0] and (t.gaps[i] != " " or words[i - 1].low in _GREET))):
                continue
            j = i + 1
            if words[j].kinds[10] == 1 and j + 1 < n and t.gap(j + 1) == ". ":
                j += 1
            if t.gap(i + 1) == " " and not words[j].cap and not words[j].function and words[j].lower < 9 and words[j].kinds[10] > 2 and text[places[2 * j + 1] : places[2 * j + 1] + 1] not in ("_", "@", "="):
                out.append((i, j, s, places[2 * j + 1], 7))
            continue
        after = text[e : e + 2]
        if w.function and not (i and words[i - 1].kinds[0] and w.written > w.lower) and not (e - s == 1 and after[:1] == "."):
            continue
        if after[:1] == "-" and after[1:].isdigit():
            continue
        if after[:1] in ("_", "(", "@", "\\", "/") or after[:1] == "." and after[1:].isalnum() and w.kinds[10] > 1 or after[:1].isdigit():
            continue
        single = w.kinds[10] == 1
        if not single:
            out.append((i, i, s, e, 0))
        j, caps, form, particle = i, 1, 0, False
        while j + 1 < n and caps < 4:
            gap, nxt = t.gaps[j + 1], words[j + 1]
            if words[j].kinds[10] == 1 and gap in (". ", ".", " ") and nxt.cap:
                if nxt.kinds[10] > 1:
                    form = 3 if caps == 1 or form == 3 else 2
            elif gap == " " and nxt.cap:
                pass
            elif gap == " " and not nxt.cap and nxt.low in _PARTICLE and caps < 3 and not particle:
                particle = True
                j += 1
                if j + 1 < n and words[j + 1].low in _PARTICLE and t.gap(j + 1) == " ":
                    j += 1
                continue
            else:
                break
            if nxt.function and nxt.kinds[10] != 1:
                break
            j += 1
            caps += 1
            end = places[2 * j + 1]
            if text[end : end + 1] in ("_", "(", "@", "/") or text[end : end + 1] == "-" and text[end + 1 : end + 2].isdigit() or text[end : end + 1] == "." and text[end + 1 : end + 2].isalpha() and nxt.kinds[10] > 1:
                break
            if nxt.kinds[10] == 1:
                if text[end : end + 1] == "." and not single:
                    out.append((i, j, s, end + 1, 4))
                continue
            out.append((i, j, s, end, 6 if particle else 3 if form == 3 else min(2, caps - 1)))
        if not single and text[e : e + 2] == ", " and i + 1 < n and places[2 * i + 2] == e + 2 and words[i + 1].cap and words[i + 1].kinds[10] > 1 and not words[i + 1].function:
            end = places[2 * i + 3]
            out.append((i, i + 1, s, end, 5))
        elif j > i and text[places[2 * j + 1] : places[2 * j + 1] + 2] == ", " and j == i + 1 and j + 1 < n and words[j + 1].cap and words[j + 1].kinds[10] > 1 and not words[j + 1].function:
            out.append((i, j + 1, s, places[2 * j + 3], 5))
    return out


def name_features(t: Text, c: tuple[int, int, int, int, int], mails: str) -> list[float]:
    i, j, s, e, form = c
    words, text = t.words, t.text
    first, last = words[i], words[j]
    given, family = (last, first) if form == 5 else (first, last)
    prv, prv2 = (words[i - 1] if i else _NO_WORD), (words[i - 2] if i > 1 else _NO_WORD)
    nxt, nxt2 = (words[j + 1] if j + 1 < t.n else _NO_WORD), (words[j + 2] if j + 2 < t.n else _NO_WORD)
    left, right = t.gap(i), t.gap(j + 1)
    if form == 4:
        right = right[1:]
    inner = words[i : j + 1]
    one = i == j
    number = (_DIGIT(left) is not None) - 2 * (_DIGIT(right[:6]) is not None)
    pg, ng = _GAPS.get(left), _GAPS.get(right)
    if pg is None:
        pg = 20.0 if left.strip() else 6.0
    if ng is None:
        ng = 6.0 if not right.strip() else 21.0 if right[0] == " " and right[1:2].isdigit() else _GAPS.get(right[:2], 20.0)
    begins = float(i == 0 or "\n" in left or left[:1] in ".!?:" or not left.strip(" ") and not left)
    return [
        form, j - i + 1, e - s, given.given, given.lower, given.written, given.kinds[10], family.given and j > i, family.lower if j > i else -1.0, family.written if j > i else -1.0, family.kinds[10],
        *((first.lower, first.written, first.kinds[1], first.kinds[3], first.kinds[5]) if one else (max([w.lower for w in inner]), max([w.written for w in inner]), max([w.kinds[1] for w in inner]), max([w.kinds[3] for w in inner]), max([w.kinds[5] for w in inner]))),
        first.kinds[4], last.kinds[4], first.function if one else max([w.function for w in inner]),
        pg, ng, begins, prv.kinds[0], prv.low in _GREET, prv.cap and prv.low in _TITLES and pg in (1.0, 7.0), prv.kinds[1], prv.function, prv.cap and not prv.function and pg in (1.0, 7.0), prv.given, prv.lower, prv2.kinds[0], prv2.low in _GREET, prv.low in ("the", "a", "an", "der", "die", "das", "le", "la", "el", "los", "les", "une", "un"),
        nxt.kinds[1], nxt.kinds[2], nxt.cap and not nxt.function and ng == 1.0, nxt.given and ng in (1.0, 2.0), nxt.lower if not nxt.cap else -1.0, nxt.kinds[6], nxt.kinds[7], nxt.function, nxt2.kinds[1], number, float("@" in text[e : e + 34]),
        float(family.kinds[10] > 2 and bool(mails) and (family.low.replace("'", "").replace("-", "") in mails)), family.kinds[8] or family.kinds[9], text[e : e + 2] in ("'s", "’s"),
    ]


def features(text: str, c: Candidate) -> list[float]:
    """Format and context of a span that is no name; unused columns are 0."""
    s, e = c.start, c.end
    span, left, right = text[s:e], text[max(0, s - 44) : s], text[e : e + 36]
    near_left = left[-16:]
    before, after = left[-1:], right[:1]
    groups = re.findall(r"\d+", span)
    sizes = [len(g) for g in groups] or [0]
    out = [
        c.form, e - s, sum(sizes), float(before in "\"'<([{"), float(before in " \t\n" or not before), float(before in "/.-_@#:" and bool(before)), float(before == "="), float(after in "\"'>)]},.;" or after in " \n" or not after), float(after in "-_/@%" and bool(after)),
        float("\n" in left[-2:] or not left), float("\n" in right[:2] or not right.strip()),
        len(sizes), min(sizes), max(sizes), sizes[0], sizes[-1], float(span[0] == "+"), float(span[0] == "("), float(span.startswith("00")), float(span[0] == "0"), float("." in span), float("-" in span), float("/" in span), float(" " in span), float(any(ch.isalpha() for ch in span)),
        float(sizes[-3:] == [3, 3, 4]), float(len(set(sizes)) == 1 and len(sizes) > 2), float(sizes == [4, 4, 4] or sizes[:2] == [4, 4]), float("\n" in span), float("," in span), float(any(len(g) == 5 for g in groups)),
    ]
    if c.kind == 0:
        out += [0.0] * 8
    else:
        follow = _CUES["phone"].search(right)
        out += [*_near(_CUES["phone"], left), *_near(_CUES["number"], left), _near(_CUES["id"], left)[0], _near(_CUES["address"], left)[0], 1 - follow.start() / (len(right) + 8) if follow else 0.0, float(bool(re.match(r"\s*(?:[a-zß-ÿ]+s\b|ms\b|[MGK]B\b|%)", right)))]
    follows = right.split(None, 1)[0] if right.strip() else ""
    out += [
        float(bool(re.match(r"[^@%&\[({]*(?:@|%40|&#64;|[\[({]?\s?(?:at|AT)\s?[\])}]?)\s?[\d.]+$", span))), float(bool(re.search(r"(?i)^(?:no-?reply|do-?not-?reply|postmaster|mailer|daemon|\w*-bot\b|bot|git|root|svn)\b", span))), float(bool(re.search(r"[A-Za-z]{2,}$", span))), float(after == ":" or after == "/"), float(follows[:1].islower()), float(follows[:1].isupper() and right[:1] == " "),
        float(re.search(r"[a-z]", left[-12:]) is not None), float(re.search(r"[a-z]{3,}[ :=#.]{1,3}$", left) is not None),
    ]
    return out + [0.0] * (WIDTH - len(out))


WIDTH = 47


def select(text: str, found: list[Candidate], chances: np.ndarray, thresholds: tuple[float, ...]) -> list[tuple[Candidate, float]]:
    """Of overlapping spans the most probable, by their distance to the threshold; longer ones where equal."""
    margin = [(p - thresholds[c.kind]) / (1 - thresholds[c.kind]) for c, p in zip(found, chances, strict=True)]
    order = sorted((i for i in range(len(found)) if margin[i] >= 0), key=lambda i: (-round(margin[i], 2), found[i].start - found[i].end, found[i].kind))
    kept: list[tuple[int, int, int]] = []  # spans without overlap, by their start
    for i in order:
        s, e = found[i].start, found[i].end
        at = bisect_left(kept, (s,))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            insort(kept, (s, e, i))
    return [(found[i], float(chances[i])) for _, _, i in kept]


def spans_of(text: str, lex: Lexicon) -> tuple[list[Candidate], list[list[float]]]:
    """All candidates of a text with their features."""
    words = Text(text, lex)
    found = candidates(words)
    rows: list[list[float]] = []
    known: dict[tuple[int, int], list[float]] = {}  # spans that are candidates of several types
    for c in found:
        got = known.get((c.start, c.end))
        rows.append([c.form, *got[1:]] if got else features(text, c))
        known[c.start, c.end] = rows[-1]
    mails = " ".join(text[c.start : c.end] for c in found if c.kind == 0).lower()
    for c in name_candidates(words):
        found.append(Candidate(4, c[2], c[3], c[4]))
        rows.append(name_features(words, c, mails))
    return found, rows


class Finder:
    """The five models, applied to texts in bulk."""

    def __init__(self, models: tuple[Boosted, ...], lex: Lexicon | None = None) -> None:
        self.models, self.lex = models, lex or lexicon()
        self.thresholds = tuple(m.threshold for m in models)

    def find(self, texts: list[str | None]) -> list[list[tuple[Candidate, float]]]:
        found: list[list[Candidate]] = []
        rows: list[list[float]] = []
        for t in texts:
            cs, xs = spans_of(t, self.lex) if t else ([], [])
            found.append(cs)
            rows += xs
        if not rows:
            return [[] for _ in texts]
        x = np.array(rows, np.float32)
        kinds = np.array([c.kind for cs in found for c in cs])
        chance = np.zeros(len(rows))
        for k, model in enumerate(self.models):
            if (at := np.flatnonzero(kinds == k)).size:
                chance[at] = model.probability(x[at])
        out, n = [], 0
        for t, cs in zip(texts, found, strict=True):
            out.append(select(t, cs, chance[n : n + len(cs)], self.thresholds) if cs else [])
            n += len(cs)
        return out


def redact(text: str | None, mentions: list[tuple[Candidate, float]]) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for c, _ in mentions:
        out += [text[at : c.start], f"<{TYPES[c.kind].upper()}>"]
        at = c.end
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def trained() -> tuple[Boosted, ...]:
    """The fitted models: as stored, otherwise fitted here."""
    if MODELS.exists():
        return tuple(Boosted.from_json(m) for m in json.loads(MODELS.read_text())["models"])
    from codelattice.llm.pii_training import fit_models

    return fit_models()


def _rows(models: tuple[Boosted, ...], redacted: bool, chunk: int = 256):
    lex = lexicon()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(models, lex)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at, kinds, starts, ends, chances, clean = [], [], [], [], [], []
            for i in range(0, len(texts), chunk):
                part = texts[i : i + chunk]
                for k, mentions in enumerate(finder.find(part)):
                    if redacted:
                        at.append(len(mentions))
                        clean.append(redact(part[k], mentions))
                        continue
                    for c, p in mentions:
                        at.append(i + k)
                        kinds.append(TYPES[c.kind])
                        starts.append(c.start)
                        ends.append(c.end)
                        chances.append(p)
            if redacted:
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(clean, pa.string())], names=["id", "mentions", "redacted"])
            else:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(chances, pa.float64())], names=["id", "pii_type", "start_pos", "end_pos", "probability"])

    return run


def find_pii(docs: DataFrame, id_col: str, text_col: str, models: tuple[Boosted, ...] | None = None) -> DataFrame:
    """``(id_col, pii_type, start_pos, end_pos, probability)``: one row for each mention."""
    got = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL AND text <> ''")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, pii_type string, start_pos bigint, end_pos bigint, probability double"
    return got.mapInArrow(_rows(models or trained(), False), schema).withColumnRenamed("id", id_col)


def redact_pii(docs: DataFrame, id_col: str, text_col: str, models: tuple[Boosted, ...] | None = None) -> DataFrame:
    """``(id_col, mentions, redacted)``: one row for each row, mentions replaced by ``<TYPE>``."""
    got = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, mentions int, redacted string"
    return got.mapInArrow(_rows(models or trained(), True), schema).withColumnRenamed("id", id_col)
