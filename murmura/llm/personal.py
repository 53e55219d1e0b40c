"""Personal information in free text: found by a semi-Markov conditional random field and replaced by placeholders.

Candidate segments of a bounded length - e-mail forms, groups of digits, words with a house number and what may follow
them, two to four words that may be a name - get a score from features of the whole segment and its surroundings, for each type.
Whether a word may begin a name is told by its character n-grams (a small model of given names against other words), its
case, a title before it and what stands around it; whether words before or after a number may be a street, by their case
and endings. Lists of names, streets and cues are features beside others, none is a condition.
Segments may not overlap; what is in none scores zero. Dynamic programming over the ends of candidates finds the best
set of segments and types together. The weights are fitted by gradient ascent on the conditional likelihood (forward
and backward sums over the same candidates) of the annotated sentences in ``personal_examples``; each sentence is also
fitted to with the lists closed, so that the other features learn to do without them.

Results: ``entities`` - one row for each stretch of a message's text or caption (type, start, end, stretch, key); repeated
rows of a message count once. ``redacted`` - text and caption with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in
place of the stretches, all else unchanged; null and empty fields stay as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.personal_examples import EXAMPLES, GIVEN_NAMES, ROUGH

TYPES = ("email", "phone", "id_number", "address", "name")
SP = r"[ \t   ]"
W = r"[^\W\d_]"
_EMAIL = re.compile(rf"(?<![\w@.+\-])[\w.+\-]++{SP}?(?:@|\(at\)|\[at\]){SP}?[\w\-]+(?:(?:\.|{SP}?\(dot\){SP}?|{SP}?\[dot\]{SP}?)[\w\-]+)*(?:\.|{SP}?\(dot\){SP}?|{SP}?\[dot\]{SP}?){W}{{2,}}", re.IGNORECASE)
_DIGITS = re.compile(r"(?<![\w@.,:#/&=\-+])(?:\+{1,2}|\(?\+?)?\(?\d[\d ().\-/ ‑]{4,}\d(?![\w@:])")
_IBAN = re.compile(rf"(?<![\w@]){W}{{2}}\d\d(?: ?[A-Za-z]{{4}})?(?: ?\d{{2,4}}){{2,8}}(?: ?\d{{1,3}})?(?!\w)")
_MIXED = re.compile(r"(?<![\w@#/.?=&\-+])(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d[A-Za-z]*\d[A-Za-z]*\d[A-Za-z]*\d)[A-Za-z0-9]{8,16}(?![\w@])")
_PAIRED = re.compile(r"(?<![\w@])[A-Za-z]{2} ?\d\d ?\d\d ?\d\d ?[A-Za-z](?!\w)")
_TOUCHING = re.compile(r"[A-Za-z] ?\d[\dA-Za-z]")
_NUMERO = re.compile(r"(?<![\w@])\d[\d ]{1,6}№ ?\d{4,8}(?!\w)")
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d\d-\d\d")
_NUMBER = rf"\d{{1,4}}{W}?(?!\w)"
#: A word and the number after it; streets of German and Dutch end so.
_WORD_NUMBER = re.compile(rf"(?<!\w)({W}++(?:-{W}++)*+\.?+){SP}{_NUMBER}")
_SUFFIXES = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "straat", "laan", "kade", "gracht", "plein", "singel", "dijk")
_STREETS = [
    ("english", ("street", "road", "lane", "avenue", "close", "way", "drive", "court", "gardens", "square", "terrace", "hill"), re.compile(rf"(?<![\w.,/:\-])\d{{1,4}}{W}?{SP}(?:{W}+{SP}){{1,2}}(?:street|road|lane|avenue|close|way|drive|court|gardens|square|terrace|hill)(?!\w)", re.IGNORECASE)),
    ("french", ("rue", "avenue", "impasse", "allée", "chemin", "place", "quai", "boulevard", "route"), re.compile(rf"(?<![\w.,/:\-])\d{{1,4}}{W}?(?:{SP}bis|{SP}ter)?,?{SP}(?:rue|avenue|impasse|allée|allee|chemin|place|quai|boulevard|route)(?:{SP}(?:de la|du|des|de|d'))?{SP}{W}+(?:-{W}+)*", re.IGNORECASE)),
    ("spanish", ("calle", "avenida", "plaza", "paseo", "camino", "c/"), re.compile(rf"(?<!\w)(?:calle|avenida|plaza|paseo|camino|c/)(?:{SP}(?:de la|del|de))?{SP}?{W}+,?{SP}{_NUMBER}(?!\d)", re.IGNORECASE)),
    ("russian", ("улица", "ул.", "переулок", "пер.", "проспект", "пр-т", "набережная", "шоссе", "бульвар", "площадь"), re.compile(rf"(?<!\w)(?:улица|ул\.|переулок|пер\.|проспект|пр-т|набережная|шоссе|бульвар|площадь){SP}{W}+,?{SP}(?:(?:д\.|дом){SP}?)?{_NUMBER}(?!\d)", re.IGNORECASE)),
]
#: Words in capitals (small ones between them) and a house number after or before them, of any street.
_CAPITAL = rf"(?:(?-i:[A-ZÀ-ÖØ-ÞА-ЯЁ]){W}*+(?:-{W}++)*+\.?+)"
_NUMBER_AFTER = re.compile(rf"(?<![\w.,/:\-@#])({_CAPITAL}(?:{SP}(?:{W}{{1,4}}{SP}){{0,2}}{_CAPITAL}){{0,2}}),?{SP}\d{{1,3}}{W}?(?![\w:%€$]|[.,\-/]\d)")
_NUMBER_BEFORE = re.compile(rf"(?<![\w.,/:\-])\d{{1,3}}{W}?{SP}(" + rf"{_CAPITAL}(?:{SP}{_CAPITAL}){{1,2}})(?!\w)".replace(r"\.?+", ""))
_FLAT = re.compile(rf",{SP}(?:кв\.|квартира|flat|apt\.?|appt\.?|wohnung|whg\.|piso){SP}?\d+{W}?(?!\w)", re.IGNORECASE)
_TOWN = re.compile(rf",{SP}(?:(\d{{4,6}})(?:{SP}([A-Z]{{2}})(?!\w))?{SP})?(?:г\.{SP}|город{SP})?({W}+(?:-{W}+)*)", re.IGNORECASE)
_POSTCODE = re.compile(rf",{SP}[A-Z]{{1,2}}\d[A-Z\d]?{SP}\d[A-Z]{{2}}(?!\w)", re.IGNORECASE)
_NAME_WORD = re.compile(rf"{W}+(?:[-'’]{W}+)*")
_NEW_SENTENCE = re.compile(r"[.!?…]+\s+(?=[A-ZÄÖÜÀ-ÝА-ЯЁ¿¡«☎])")
_TITLE = re.compile(r"(?:\b(?:dr|prof|herr|frau|mr|mrs|ms|mme|sr|sra|dhr|mevr|ing)\b\.?|г-н|г-жа)\s+$", re.IGNORECASE)
#: Longer groups of digits are no numbers of a person.
MOST_DIGITS = 24
#: Words before a number that tell what it is, by their beginnings.
CUES = {
    "phone": "tel phone handy mobil móvil movil portable nummer number ring call anruf ruf erreichbar reach bereiken joindre llamar звон номеру тел ☎ 📞 fax whatsapp bel contact",
    "id": "ausweis konto account identi persoons rekening compte cuenta счёт счет документ паспорт passport pasaporte paspoort steuer tax bsn dni nif nie инн снилс iban id ssn perso pièce piece kenmerk docum referen sozial insurance nationa versicherung nir",
    "other": "bestell order commande pedido заказ zähler meter compteur contador счётчик счетчик ticket version update linie line ligne línea lijn маршрут antrag motion moción euro preis price process prozess vers antragsnummer rechnung invoice sendung paketnummer build серии",
}
_CUES = {k: tuple(v.split()) for k, v in CUES.items()}
#: Common words that are no family name.
_NO_NAME = frozenset(
    "und and et y en и is ist est es hat has heeft a ha в на the der die das de la le el un une eine ein il ella er sie he she we wir handy telefon mobile móvil movil mobiel portable телефон aus from uit d i von with mit met avec con "
    "sagt says zegt dit dice meint picked gestern yesterday gisteren hier ayer вчера kommt comes geht will wird was war im in am an on at to zu für for pour para voor nicht not niet pas no не schon auch nummer number aan bei by chez "
    "regards cheers lg vg mfg gruß grüße groet groeten groetjes saludos cordialement amitiés bises merci thanks danke dank gracias спасибо hallo hello hi hey hoi bonjour hola привет уважением liebe best kind love"
    .split()
)


def words_before(text: str, at: int, n: int = 6) -> list[str]:
    """The last words before a place, within its sentence, the nearest first."""
    line = text[max(0, at - 80) : at].rpartition("\n")[2]
    return re.findall(r"[^\W\d_]+|[☎📞]", _NEW_SENTENCE.split(line)[-1].lower())[-n:][::-1]


def _shape(groups: list[str]) -> str:
    return "-".join(str(min(len(g), 6)) for g in groups[:6])


def _number_features(text: str, a: int, b: int, kind: str) -> list[str]:
    s = text[a:b]
    groups = re.findall(r"[A-Za-z0-9]+", s)
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    size = next(x for x, top in (("7", 7), ("9", 9), ("11", 11), ("13", 13), ("15", 15), ("18", 18), ("24", 24), ("more", 10**9)) if digits <= top)
    start = "plus" if "+" in s[:2] else "paren" if s[0] == "(" else "00" if s.startswith("00") else "0" if s[0] == "0" else "8" if s[0] == "8" else "letter" if s[0].isalpha() else "digit"
    out = [f"{kind}:size={size}", f"{kind}:start={start}", f"{kind}:letters={min(letters, 5)}", f"{kind}:from={start}:{size}", kind]
    out += [f"{kind}:has={c}" for c in ("(", ".", "/", "-", " ") if c in s]
    if len(groups) > 1 and all(len(g) <= 4 for g in groups) and [len(g) for g in groups][:2] == [4, 4]:
        out.append(f"{kind}:fours")
    if len(groups) == 3 and [len(g) for g in groups] == [3, 2, 4]:
        out.append(f"{kind}:3-2-4")
    if _IBAN.fullmatch(s):
        out.append(f"{kind}:iban")
    if _DATE.search(s):
        out.append(f"{kind}:date")
    if "." in s:
        out.append(f"{kind}:dots={_shape(groups)}")
    found = set()
    for distance, w in enumerate(words_before(text, a)):
        for cue, heads in _CUES.items():
            if cue not in found and w.startswith(heads):
                out += [f"{kind}:cue={cue}", f"{kind}:cue={cue}:{'near' if distance < 2 else 'far'}"]
                found.add(cue)
    if len(found) > 1:
        out.append(f"{kind}:cues={'+'.join(sorted(found))}")
    if not found:
        out.append(f"{kind}:no cue")
        out.append(f"{kind}:no cue:start={start}")
    before = text[max(0, a - 2) : a]
    if "☎" in before or "📞" in before or "·" in before:
        out.append(f"{kind}:mark")
    if re.match(r"\s*(?:euro|€|\$|рубл|stück|%)", text[b : b + 9].lower()):
        out.append(f"{kind}:price")
    return out


def _case(s: str) -> str:
    return "upper" if s.isupper() else "lower" if s.islower() else "title" if s[:1].isupper() else "mixed"


_BEGINS = re.compile(rf"(?<!{W})(?<!-)[A-ZÀ-ÖØ-ÞА-ЯЁ]")


def _street_features(text: str, a: int, b: int, name: str, kind: str) -> list[str]:
    """Of a street that no list of endings knows: its words' endings, its size, what stands before and after it."""
    words = name.lower().split()
    end = words[-1].rstrip(".")
    out = [f"{kind}:words={min(len(words), 4)}", f"{kind}:end={end[-4:]}", f"{kind}:first=" + (words[0] if len(words[0]) < 6 else "long")]
    before = text[max(0, a - 2) : a]
    out.append(f"{kind}:before=" + ("start" if not before.strip() or "\n" in before else before.strip()[-1] if not before.strip()[-1].isalnum() else "word"))
    if found := words_before(text, a, 1):
        out.append(f"{kind}:after " + ("article" if found[0] in _ARTICLES else "word"))
    after = text[b : b + 3]
    out.append(f"{kind}:then=" + ("end" if not after.strip() or after[0] == "\n" else after[0] if after[0] != " " else "word" if after[1:2].islower() else "cap"))
    return out


def _address(text: str) -> Iterator[tuple[int, int, list[str]]]:
    if not re.search(r"\d", text):
        return
    low = text.lower()
    streets = [("suffix", m) for m in _WORD_NUMBER.finditer(text) if m[1].lower().endswith(_SUFFIXES)]
    streets += [(kind, m) for kind, heads, pattern in _STREETS if any(h in low for h in heads) for m in pattern.finditer(text)]
    taken = {m.span() for _, m in streets}
    for kind, pattern in (("open after", _NUMBER_AFTER), ("open before", _NUMBER_BEFORE)):
        streets += [(kind, m) for m in pattern.finditer(text) if m.span() not in taken]
    for kind, m in streets:
        a, b = m.span()
        starts = [a]
        forms: dict[int, list[str]] = {}
        if kind.startswith("open"):
            # A street may begin with any of the words in capitals.
            starts = [a] if kind == "open before" else [x.start() for x in _BEGINS.finditer(text, a, m.end(1))]
            forms = {x: _street_features(text, x, b, text[max(x, m.start(1)) : m.end(1)], kind) for x in starts}
        if kind == "suffix" and (x := re.search(rf"(?<!\w){W}+{SP}$", text[max(0, a - 30) : a])):
            starts.append(a - len(x[0]))  # a street of two words
        ends = [(b, [])]
        long = ["address:long number"] if re.search(r"(?<!\d)\d{4}(?!\d)", m[0]) else []
        at, have = b, []
        for name, tail in (("flat", _FLAT), ("town", _TOWN), ("code", _POSTCODE), ("flat", _FLAT)):
            if name == "code" and "town" not in " ".join(have):
                continue
            if t := tail.match(text, at):
                at = t.end()
                label = name if name != "town" else "town+post" if t[1] else "town"
                have = [*have, f"address:{label}"]
                if name == "town":
                    have.append(f"address:town:{_case(t[3])}:{'cap' if text[starts[0]].isupper() or text[starts[0]].isdigit() else 'low'}")
                    if t[3].lower() in _NO_NAME:
                        have.append("address:town is a common word")
                ends.append((at, have))
        for s in starts:
            for e, tails in ends:
                extra = ["address:longer start"] if s != starts[0] and not forms else []
                more = ["address:cut short"] if e != ends[-1][0] else []
                yield s, e, ["address", f"address:{kind}", *forms.get(s, ()), *tails, *extra, *more, *long]


class GivenNames:
    """Log-odds of a word being a given name, from its character n-grams: two models, each fitted to half of the names and words.

    A word of the lists is judged by the model that did not see it. Words are kept with their score.
    """

    def __init__(self, names: list[str], others: list[str]):
        self.half = {w: k % 2 for group in (sorted(names), sorted(others)) for k, w in enumerate(group)}
        self.tables = []
        for f in (0, 1):
            counts: list[dict[str, int]] = [{}, {}]
            for kind, group in enumerate((sorted(names), sorted(others))):
                for w in group:
                    if self.half[w] != f:
                        for g in self._grams(w):
                            counts[kind][g] = counts[kind].get(g, 0) + 1
            total = [sum(c.values()) for c in counts]
            self.tables.append({g: log((counts[0].get(g, 0) + 0.3) / total[0]) - log((counts[1].get(g, 0) + 0.3) / total[1]) for g in {*counts[0], *counts[1]}})
        self.known: dict[str, float] = {}
        self.others = frozenset(others)

    @staticmethod
    def _grams(word: str) -> list[str]:
        framed = f"<{word}>"
        return [framed[i : i + n] for n in (2, 3, 4) for i in range(len(framed) - n + 1)]

    def __call__(self, word: str) -> float:
        """The mean over the n-grams (unseen ones say nothing); ``word`` in small letters."""
        score = self.known.get(word)
        if score is None:
            grams = self._grams(word.split("-")[0])
            tables = [self.tables[self.half[word]]] if word in self.half else self.tables
            score = sum(t.get(g, 0.0) for t in tables for g in grams) / len(tables) / max(1, len(grams))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = score
        return score


@lru_cache(maxsize=1)
def given_names() -> GivenNames:
    """Given names against the words of the example frames that are none."""
    from murmura.llm.personal_examples import FRAMES

    others = {w for frames in FRAMES.values() for w in re.findall(rf"{W}{{2,}}", re.sub(r"\{{.*?\}}", " ", frames).lower())}
    return GivenNames(sorted(GIVEN_NAMES), sorted(others - GIVEN_NAMES))


#: Words before a name, or before something else in capitals: features, by class.
_ARTICLES = frozenset("mein meine meinem meiner dein deine sein seine ihr ihre euer eure my your his her their mi tu su mon ma ton ta son sa mijn jouw je мой моя наш наша der die das dem den des ein eine einen einem einer im am zum zur vom beim ins the a an el la los las del al un una le les du des une l het de een unser unsere unserem unseren our notre nuestro nuestra onze".split())
_PLACES = frozenset("in nach aus auf zu at to from near over à en chez dans hacia desde в из до на".split())
_GREETINGS = frozenset("lg vg mfg gruß grüße groet groeten gr regards cheers best saludo saludos abrazos cordialement bises amitiés доброго уважением привет".split())


def _level(score: float) -> str:
    return "high" if score > 1.0 else "good" if score > 0.5 else "some" if score > 0 else "low" if score > -0.5 else "none"


def _names(text: str, given: frozenset[str] = GIVEN_NAMES) -> Iterator[tuple[int, int, list[str]]]:
    low = text.lower()
    words = [m.span() for m in _NAME_WORD.finditer(text)]
    lows = [low[a:b] for a, b in words] if len(low) == len(text) else [text[a:b].lower() for a, b in words]
    caps = [text[a].isupper() and not (b - a > 1 and text[a:b].isupper()) for a, b in words]
    score = given_names()
    seen = set()

    def joined(i: int, j: int) -> bool:
        gap = text[words[i][1] : words[j][0]]
        return 0 < len(gap) <= 2 and gap.isspace() and "\n" not in gap

    def listed(w: str) -> bool:
        return w in given or ("-" in w and w.split("-")[0] in given)

    for i, w in enumerate(lows):
        known = w in given or ("-" in w and w.split("-")[0] in given)
        if not known and not text[words[i][0]].isupper():
            continue
        titled = not known and bool(_TITLE.search(text[max(0, words[i][0] - 8) : words[i][0]]))
        cap = caps[i]
        if not known and not titled:
            # Two words in capitals; the first of a sentence, which always has one, only if it has the form of a name.
            after = cap and i + 1 < len(words) and caps[i + 1] and joined(i, i + 1)
            before = cap and i and caps[i - 1] and text[words[i - 1][1] : words[i][0]] == ", " and score(w) > 0.1
            if not (after or before) or w in _NO_NAME or w in _ARTICLES or len(w) < 3:
                continue
            gap = text[words[i - 1][1] : words[i][0]] if i else "\n"
            starts = bool(gap.strip(" ,«„“\"(·")) or "\n" in gap
            if starts and score(w) <= 0.6:
                continue
            if not starts and after and not before and gap == " ":
                # Within a longer run of capitals, or after an article, two words in capitals are a thing or a place.
                long = caps[i - 1] and i > 1 and not text[words[i - 2][1] : words[i - 1][0]].strip(" ") and "\n" not in text[words[i - 2][1] : words[i - 1][0]]
                if lows[i - 1] in _ARTICLES or (long and lows[i - 1] not in _GREETINGS):
                    continue
        spans = []
        j = i
        while j + 1 < len(words) and j < i + 3 and joined(j, j + 1) and (known or (words[j + 1][0] - words[j][1] == 1 and (titled or caps[j + 1]))):
            j += 1
            spans.append((i, j, False))
        if i and (known or score(w) > 0.1) and text[words[i - 1][1] : words[i][0]] == ", ":
            spans.append((i - 1, i, True))
            if i + 1 < len(words) and joined(i, i + 1) and (listed(lows[i + 1]) or caps[i + 1]):
                spans.append((i - 1, i + 1, True))
        for p, q, comma in spans:
            if (p, q) in seen:
                continue
            seen.add((p, q))
            a, b = words[p][0], words[q][1]
            parts, shown = lows[p : q + 1], [text[x:y] for x, y in words[p : q + 1]]
            n, cases = q - p + 1, {_case(x) for x in shown}
            family = parts[0] if comma else parts[-1]
            case = cases.pop() if len(cases) == 1 else "mixed"
            out = ["name", f"name:{n}:{'comma' if comma else 'plain'}", f"name:case={case}"]
            out.append(f"name:given={sum(map(listed, parts))}of{n}{'c' if comma else ''}")
            out.append(f"name:form={_level(score(w))}:{case}")
            out.append(f"name:family form={_level(score(family))}")
            if family in given:
                out.append("name:family is given")
            if any(x in _NO_NAME for x in parts):
                out.append("name:common word")
            elif any(x in score.others for x in parts):
                out.append("name:frame word")
            if len(family) < 4:
                out.append("name:short family")
            if n > 2 and not comma and not all(map(listed, parts[:-1])):
                out.append("name:strange middle")
            if titled:
                out.append("name:titled")
            before = text[max(0, a - 8) : a]
            if _TITLE.search(before):
                out.append("name:after title")
            elif before.endswith((", ", "@")):
                out.append("name:after comma or at")
            if not before.strip() or before.rstrip(" ")[-1] in ".!?…\n\r":
                out.append("name:at start")
            elif p and lows[p - 1] in _ARTICLES:
                out.append("name:after article")
            elif p and lows[p - 1] in _PLACES:
                out.append("name:after place word")
            if p and lows[p - 1] in _GREETINGS:
                out.append("name:after greeting")
            elif p and caps[p - 1] and joined(p - 1, p):
                out.append("name:after capital")
            after = text[b : b + 3]
            then = "end" if not after.strip() or after[0] == "\n" else after[0] if not after[0].isalnum() and after[0] != " " else "word" if after[:1] == " " and after[1:2].islower() else "cap" if after[1:2].isupper() else "other"
            out.append(f"name:then={then}")
            if then not in ("word", "cap", "end") and (follow := text[b : b + 4].lstrip(" ,(·:").strip()):
                out.append(f"name:then={then}:" + ("digit" if follow[0] in "+0123456789" else "cap" if follow[0].isupper() else "small"))
            if q + 1 < len(words) and words[q + 1][0] - b <= 3 and lows[q + 1].startswith(_CUES["phone"]):
                out.append("name:then phone")
            if after.startswith(", ") and (m := _NAME_WORD.match(text, b + 2)) and listed(m[0].lower()):
                out.append("name:then given")
            yield a, b, out


def candidates(text: str, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, type, features) of every candidate segment, by end."""
    out: dict[tuple[int, int, str], list[str]] = {}
    if "@" in text or "at)" in text.lower() or "at]" in text.lower():
        for m in _EMAIL.finditer(text):
            out[(*m.span(), "email")] = ["email", "email:" + ("plain" if "@" in m[0] and " " not in m[0] else "disguised")]
    numbers: set[tuple[int, int]] = set()
    for m in _DIGITS.finditer(text):
        if not _DATE.fullmatch(m[0].strip(" .")):
            # White space of more than one sign and ends of sentences part numbers.
            at = m.start()
            for piece in re.split(r"([  ]{2,}|\.[  ])", m[0]):
                if piece and 6 <= sum(c.isdigit() for c in piece) <= MOST_DIGITS and not piece.isspace():
                    core = piece.strip(" .-/ ")
                    core = core if core.count("(") == core.count(")") else core.strip("()")
                    start = text.index(core, at)
                    numbers.add((start, start + len(core)))
                at += len(piece)
    for a, b in numbers:
        for kind in ("phone", "id_number"):
            out[(a, b, kind)] = _number_features(text, a, b, kind)
        # A letter may close the number (check letters of identity numbers).
        if m := re.compile(r"[A-Za-z](?!\w)").match(text, b):
            out[(a, m.end(), "id_number")] = [*_number_features(text, a, m.end(), "id_number"), "id_number:closing letter"]
    for pattern in (*((_IBAN, _MIXED, _PAIRED) if _TOUCHING.search(text) else ()), *((_NUMERO,) if "№" in text else ())):
        for m in pattern.finditer(text):
            if (key := (*m.span(), "id_number")) not in out:
                out[key] = [*_number_features(text, *m.span(), "id_number"), "id_number:form"]
    for a, b, found in _address(text):
        out[(a, b, "address")] = found
    for a, b, found in _names(text, given):
        out[(a, b, "name")] = found
    return sorted(((a, b, k, f) for (a, b, k), f in out.items()), key=lambda c: (c[1], c[0], c[2]))


def best(found: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The segments of the highest total score that do not overlap."""
    ends = [b for _, b, _, _ in found]
    total, take = [0.0], [None]
    for n, (a, _, _, features) in enumerate(found):
        score = sum(weights.get(f, 0.0) for f in features)
        before = bisect_right(ends, a, 0, n)
        if score > 0 and total[before] + score > total[-1]:
            total.append(total[before] + score)
            take.append((n, before))
        else:
            total.append(total[-1])
            take.append(None)
    out, n = [], len(found)
    while n:
        if take[n] is None:
            n -= 1
        else:
            k, n = take[n]
            out.append(found[k][:3])
    return out[::-1]


def _expected(found: list, weights: dict[str, float]) -> list[float]:
    """The probability of each candidate, by forward and backward sums."""
    n = len(found)
    ends = [b for _, b, _, _ in found]
    score = [min(30.0, sum(weights.get(f, 0.0) for f in c[3])) for c in found]
    before = [bisect_right(ends, c[0], 0, k) for k, c in enumerate(found)]
    forward = [0.0] * (n + 1)

    def add(x: float, y: float) -> float:
        return max(x, y) + log(1 + exp(-abs(x - y)))

    for k in range(n):
        forward[k + 1] = add(forward[k], forward[before[k]] + score[k])
    backward = [-1e9] * n + [0.0]
    for k in range(n - 1, -1, -1):
        backward[k] = add(backward[k], backward[k + 1])
        backward[before[k]] = add(backward[before[k]], backward[k + 1] + score[k])
    # backward[k] sums what can follow once the first k candidates are decided.
    z = forward[n]
    return [exp(min(0.0, forward[before[k]] + score[k] + backward[k + 1] - z)) for k in range(n)]


_MARK = re.compile(r"\{(email|phone|id_number|address|name)\|([^}]*)\}")


def read_example(line: str) -> tuple[str, set[tuple[int, int, str]]]:
    """Text and segments of an annotated line."""
    text, gold, at = "", set(), 0
    for m in _MARK.finditer(line):
        text += line[at : m.start()]
        gold.add((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + line[at:], gold


@lru_cache(maxsize=1)
def fitted(rounds: int = 25, rate: float = 0.5, decay: float = 0.002) -> dict[str, float]:
    """Weights fitted to the annotated examples, each also in small and in capital letters."""
    data = []
    for k, line in enumerate(EXAMPLES):
        text, gold = read_example(line)
        # Small and capital letters for a third each; with the lists of names closed as often as open.
        for variant in (text, *([text.lower()] if k % 3 == 0 else [text.upper()] if k % 3 == 1 else [])):
            for given in (GIVEN_NAMES, frozenset()):
                if len(variant) == len(text):
                    found = candidates(variant, given)
                    data.append((found, [c[:3] in gold for c in found]))
    data += [(found, [False] * len(found)) for found in map(candidates, ROUGH) if found]
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    for _ in range(rounds):
        for found, gold in data:
            gradient: dict[str, float] = {}
            for c, g, p in zip(found, gold, _expected(found, weights), strict=True):
                if abs(g - p) > 1e-4:
                    for f in c[3]:
                        gradient[f] = gradient.get(f, 0.0) + g - p
            for f, g in gradient.items():
                g -= decay * weights.get(f, 0.0)
                square[f] = square.get(f, 0.1) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / square[f] ** 0.5
    return weights


def find(text: str | None, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal stretches of a text, in order."""
    return best(candidates(text), weights) if text else []


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def key(stretch: str) -> str:
    """The stretch lower-cased, with its letters and digits only."""
    return "".join(c for c in stretch.lower() if c.isalnum())


ENTITIES = "source_field string, pii_type string, start int, end int, stretch string, pii_key string"


def _entities(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    names = ["message_id", "source_field", "pii_type", "start", "end", "stretch", "pii_key"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        at = []
        for k, (text, caption) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for field, t in (("text", text), ("caption", caption)):
                for a, b, kind in find(t, weights):
                    at.append(k)
                    for column, v in zip(rows[1:], (field, kind, a, b, t[a:b], key(t[a:b])), strict=True):
                        column.append(v)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], kinds, strict=True))], names=names)


def _redacted(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [pa.array([redact(t, find(t, weights)) for t in batch.column(c).to_pylist()], pa.string()) for c in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["message_id", "text", "caption"])


def _rows(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("id").alias("message_id"), "text", "caption").where("message_id is not null")


def entities(messages: DataFrame) -> DataFrame:
    """(message_id, source_field, pii_type, start, end, stretch, pii_key) of every stretch."""
    rows = _rows(messages)
    return rows.mapInArrow(partial(_entities, weights=fitted()), f"message_id {dict(rows.dtypes)['message_id']}, {ENTITIES}").distinct()


def redacted(messages: DataFrame) -> DataFrame:
    """(message_id, text, caption) with placeholders, one row for each message id."""
    rows = _rows(messages)
    return rows.dropDuplicates(["message_id"]).mapInArrow(partial(_redacted, weights=fitted()), f"message_id {dict(rows.dtypes)['message_id']}, text string, caption string")
