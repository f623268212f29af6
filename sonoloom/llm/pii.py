"""Personal data in free text (problem 2): e-mail, phone, id number, address and name.

Regular expressions propose spans with a base score. Validators (date digits of a health
number, Luhn, the mod-97 key) and context words near the span raise or lower the score;
spans at or above THRESHOLD stay, overlaps go to the higher score and then the longer
span. Each span is replaced by a placeholder of its type; all else is unchanged. In a
JSON field only the string values that hold personal data change.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.skew import spread
from sonoloom.llm.frames import frame

THRESHOLD = 0.5
PLACEHOLDER = "[{}]"
# Characters before a span in which its caption and context words are sought.
CONTEXT = 48


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---- validators ---------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Luhn check digit, as in a Canadian social insurance number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """Key of a French social security number: the last two digits are 97 - number mod 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def health_date(digits: str) -> bool:
    """Year, month (plus 50 for women) and day of a Quebec health insurance number."""
    return int(digits[2:4]) % 50 in range(1, 13) and 1 <= int(digits[4:6]) <= 31


# ---- patterns -----------------------------------------------------------------

_B = "[   ]"
_UP = "A-ZÀ-ÖØ-ÞŒŠŽŸ"
_LO = "a-zß-öø-ÿœšžāăąćčęěğīłńňōőřśşţťūůűź"
_L = _UP + _LO

_AT = rf"(?:{_B}?[@＠]{_B}?|{_B}?[\[({{<]{_B}?(?:at|AT|At|arobase|AROBASE|à|@){_B}?[\])}}>]{_B}?)"
_DOT = rf"(?:\.|{_B}?[\[({{<]{_B}?(?:dot|DOT|Dot|point|POINT|\.){_B}?[\])}}>]{_B}?)"
_LOCAL = rf"[{_L}0-9](?:[{_L}0-9_%+'-]|{_DOT}(?=[{_L}0-9]))*"
_LABEL = rf"[{_L}0-9](?:[{_L}0-9-]*[{_L}0-9])?"
EMAIL = re.compile(rf"(?<![{_L}0-9._%+-])(?:mailto:)?({_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[{_L}]{{2,}})(?![{_L}0-9])")
# Signs written as plain words need both the word for @ and one for the dot.
EMAIL_WORDS = re.compile(
    rf"(?<![{_L}0-9._%+-])({_LOCAL}(?:{_B}(?:dot|point|plus){_B}[{_L}0-9]+)*{_B}(?:at|arobase|chez){_B}{_LABEL}(?:(?:{_B}(?:dot|point){_B}|\.){_LABEL})*{_B}(?:dot|point){_B}[{_L}]{{2,}})(?![{_L}0-9])", re.I
)

# What every address holds; texts without it are not searched for one.
_AT_SIGN = re.compile(rf"[@＠]|[\[({{<]{_B}?(?:at|AT|At|arobase|AROBASE|à){_B}?[\])}}>]")
_DOT_WORD = re.compile(rf"{_B}(?:dot|point){_B}", re.I)
# What every phone and identity number holds: five digits with at most three other signs between two of them.
_FIVE_DIGITS = re.compile(r"\d(?:[^\w\n]{0,3}\d){4}")

_SEP = r"[   .\-–/]"
_EXT = rf"(?:{_B}?,?{_B}?(?:extension|ext\.?|poste|p\.|x|#){_B}?\d{{1,6}}(?!\d))?"
_NOT_IN = r"(?<![\w+.])(?<!\d[-/])"
_END = r"(?![\w])(?![-.,/]\d)"
PHONES = [
    # country code, then groups
    (re.compile(rf"{_NOT_IN}(?:\+|00)(?:33|32|41|44|49|34|39|352|351|1){_SEP}?(?:\(0\){_SEP}?)?(?:\(\d{{2,4}}\){_SEP}?)?\d{{1,4}}(?:{_SEP}?\d{{2,4}}){{1,5}}{_EXT}{_END}", re.I), 0.8),
    (re.compile(rf"{_NOT_IN}\+\d{{1,3}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d{{1,4}}(?:{_SEP}\d{{2,4}}){{2,5}}{_EXT}{_END}", re.I), 0.7),
    # North America
    (re.compile(rf"(?:(?<![\w+.])|(?<=\())(?<!\d[-/])(?:1{_SEP}?)?(?:\([2-9]\d\d\){_B}?|[2-9]\d\d{_SEP})\d{{3}}{_SEP}\d{{4}}{_EXT}{_END}", re.I), 0.6),
    (re.compile(rf"{_NOT_IN}1[2-9]\d\d[2-9]\d{{6}}{_EXT}{_END}", re.I), 0.5),
    (re.compile(rf"{_NOT_IN}[2-9]\d\d[2-9]\d{{6}}{_EXT}{_END}", re.I), 0.3),
    # France: ten digits in pairs; United Kingdom: area code and groups
    (re.compile(rf"{_NOT_IN}0[1-9](?:{_SEP}?\d\d){{4}}{_EXT}{_END}", re.I), 0.6),
    (re.compile(rf"{_NOT_IN}(?:\(0\d{{2,4}}\)|0\d{{2,4}}){_B}\d{{3,4}}{_B}?\d{{3,4}}{_EXT}{_END}", re.I), 0.6),
    # local number without area code, only beside a phone word
    (re.compile(rf"{_NOT_IN}[2-9]\d\d-\d{{4}}{_EXT}{_END}", re.I), 0.1),
]
# Words near a span that speak for or against a phone number.
PHONE_WORDS = re.compile(r"(?i)\b(?:t[ée]l(?:[ée]phone)?|phone|fax|cell(?:ulaire)?|mobile|portable|call(?:back)?|rappel(?:er)?|joindre|appeler|contact|num[ée]ro|reach|famil(?:y|le)|discut[ée]|discussed|voir|ask|pager)\b")
OTHER_NUMBER = re.compile(r"(?i)(?:\b(?:accession|s/n|serial|s[ée]rie|lot|uid|series|image|dicom|batch|sn|ref|r[ée]f)\b\.?(?:\s*(?:n[o°]\.?|number|num[ée]ro))?\s*[:#]?\s*)$")

_ID_CAPTION = re.compile(
    r"(?i)(?:\b(?:NAM|RAMQ|NAS|NIR|NIA|SSN|SIN|MRN|IPP|NHS|NISS|AVS)\b|\bassurance(?:[- ]maladie)?|\b(?:health|medicare|insurance|hospital)[ -]?(?:card|insurance|number|no\.?|id|n°)?|\bcarte (?:vitale|soleil|maladie)|\bs[ée]cu(?:rit[ée] sociale)?|\bsocial (?:security|insurance)|\bdossier|\b(?:medical |patient )?(?:record|chart)|\bpatient id|\bid patient)"
    r"(?:[  ]*(?:n[o°ºr]\.?|number|num[ée]ro|#|id))?[  ]*[:#=]?[  ]*(?:is |est )?$"
)
IDS = [
    (re.compile(rf"(?<![\w-])[A-Za-z]{{4}}[  -]?\d{{4}}[  -]?\d{{4}}(?![\w])(?!-\d)"), "ramq", 0.3),
    (re.compile(rf"(?<![\w.-])[1-478](?:[  .]?\d\d){{2}}[  .]?(?:\d\d|2[ABab])[  .]?\d{{3}}[  .]?\d{{3}}[  .]?\d\d(?![\w])(?!-\d)"), "nir", 0.4),
    (re.compile(r"(?<![\w.-])(?<!\d )\d{3}-\d{2}-\d{4}(?![\w])(?!-\d)"), "ssn", 0.5),
    (re.compile(r"(?<![\w.-])(?<!\d )\d{3}[  -]\d{3}[  -]\d{3}(?![\w])(?![- ]\d)"), "sin", 0.2),
    (re.compile(r"(?<![\w.-])(?:[A-Z]{1,3}[- ]?)?\d{5,12}(?![\w])(?!-\d)(?!\.\d)"), "record", 0.0),
    (re.compile(r"(?<![\w.-])\d{3}[  -]\d{3}[  -]\d{4}(?![\w])(?![- ]\d)"), "nhs", 0.0),
]

# Street words, in French before the name and in English after it.
_FR_STREET = r"(?:rue|avenue|av\.|ave\.?|boulevard|boul\.?|bd\.?|blvd\.?|chemin|ch\.|rang|place|pl\.|all[ée]e|impasse|quai|route|rte\.?|cours|mont[ée]e|c[ôo]te|square|passage|ruelle|sentier|voie|faubourg|esplanade|terrasse|croissant|promenade|cit[ée]|villa|venelle|mail|rond-point)"
_EN_STREET = r"(?:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|mews|court|ct\.?|crescent|cres\.?|close|way|place|pl\.?|terrace|boulevard|blvd\.?|square|sq\.?|gardens?|grove|hill|row|walk|yard|park|parkway|pkwy\.?|circle|highway|hwy\.?|trail|alley|quay|green)"
_UNIT_WORD = r"(?:app(?:t|artement)?\.?|apt\.?|apartment|flat|unit[ée]?|suite|ste\.?|bureau|bur\.?|porte|[ée]tage|room|no\.?|n°|#)"
_TOWN_WORD = rf"[{_UP}][{_L}'’]*(?:-[{_L}'’]+)*"
_TOWN = rf"{_TOWN_WORD}(?:{_B}{_TOWN_WORD}){{0,3}}"
_POST = rf"(?:[A-Za-z]\d[A-Za-z]{_B}?\d[A-Za-z]\d|\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?{_B}\d[A-Z]{{2}})(?![\w])"
_UNIT = rf"(?:,?{_B}(?i:{_UNIT_WORD}){_B}?\d{{1,5}}[A-Za-z]?(?![\w]))?"
_TAIL = rf"{_UNIT}(?:,{_B}(?:{_POST}{_B})?{_TOWN}(?:{_B}\([A-Z]{{2}}\)|,{_B}[A-Z]{{2}}(?![\w]))?(?:,?{_B}{_POST})?)?"
_NUMBER = rf"(?<![\w.,/-])(?:(?i:{_UNIT_WORD}){_B}?\d{{1,5}}[A-Za-z]?,?{_B})?\d{{1,5}}(?:-\d{{1,5}})?{_B}?(?i:bis|ter|quater|[a-d](?![\w']))?,?{_B}"
_NAME_WORD = rf"[{_L}][{_L}'’.-]*[{_L}]"
ADDRESSES = [
    (re.compile(rf"{_NUMBER}(?i:{_FR_STREET}){_B}(?:(?:de|du|des|d'|la|le|les|l'|d’|l’|DE|DU|DES|LA|LE|LES){_B}?){{0,3}}{_NAME_WORD}(?:{_B}(?:de|du|des|la|le|les|DE|DU|DES|LA|LE|LES|[{_UP}][{_L}'’-]*)(?![\w.])){{0,4}}{_TAIL}"), 0.9),
    (re.compile(rf"{_NUMBER}(?:[NSEWnsew]\.{_B}|(?:North|South|East|West|NORTH|SOUTH|EAST|WEST){_B})?(?:[{_UP}0-9][{_L}0-9'’-]*{_B}){{1,4}}(?i:{_EN_STREET})(?![{_L}0-9]){_TAIL}"), 0.9),
]

# ---- names --------------------------------------------------------------------

# Titles and captions that announce a person; a title is no part of the name.
_TITLE = r"(?:Dre|DRE|Dr|DR|Docteure?|Doctor|Prof|PROF|Professeure?|Pr|Pre|Mrs|MRS|Mr|MR|Ms|MS|Miss|Mme|MME|Mlle|MLLE|Madame|Monsieur|Mademoiselle|Me|Inf|Sr)\.?"
_ANNOUNCE = (
    r"(?:Patiente?{b}?:?|PATIENTE?{b}?:?|[Nn]om{b}?:|[Nn]ame{b}?:|[Rr]elue?s? par|[Ll]ue? par|[Rr]évisée? par|[Vv]alidée? par|[Ss]ignée? par|[Dd]ictée? par|[Dd]emandée? par|[Oo]ver-?read by|[Rr]ead by|[Rr]eviewed by|[Ss]igned by|[Dd]ictated by|[Oo]rdered by|[Rr]eferred by|[Rr]eported by|[Dd]iscussed with|[Ss]een with|[Ss]een by|[Dd]iscutée? avec|[Vv]ue? avec|[Vv]ue? par"
    r"|\([Vv]oir|\([Aa]sk|\([Cc]f\.?|(?:[Ss]on|[Ss]a|[Hh]er|[Hh]is|[Tt]he){b}(?:conjointe?|époux|épouse|fille|fils|mère|père|sœur|soeur|frère|wife|husband|partner|daughter|son|mother|father|sister|brother)|(?:Daughter|Son|Wife|Husband|Mother|Father|Sister|Brother|Partner|Conjointe?|Fille|Fils|Épouse|Époux|Mère|Père|Sœur|Frère))"
).replace("{b}", _B)
# Words that follow a name or open a sentence and are no part of a name.
_NO_NAME = frozenset(
    "mr mrs ms miss m mme mlle dr dre prof pr patient patiente daughter son sa her his wife husband conjointe flat apt app unit suite rappel callback call joindre report rapport copie cc"
    " dossier nam mrn ramq nas nir ssn sin insurance health no uid accession sonde probe lot batch contrast contraste room salle série series voir see score signe sign méthode method gain suivi"
    " domicile lives relu over ordered seen discussed discuté demandé tél tel phone et and le la les un une the a an in on at l d du de des il elle he she it we nous q r ta bp hr fc"
    " habite demeure vue vu lives prefers préfère the same this ce cet cette pour for with avec par by from to is est was a été has"
    " frame frames images image peak vitesse strain loss every step étape note à absence jet surface orifice cadence fenêtre window ejection fraction compared comparé comparée regurgitant left right"
    " ventricule oreillette valve paroi racine aorte veine septum pilier chambre espace apex apical suprasternal subcostal parasternal papillary lateral inferior ascending aortic mitral tricuspid"
    " pulmonic pericardial interatrial outflow kept gardons conclusion indication commentaire".split()
)
_CAPTOK = rf"[{_UP}](?:[{_L}'’]*[{_L}])?(?:-[{_UP}][{_L}'’]*)*"
_FULLTOK = rf"[{_UP}][{_L}'’]*[{_L}](?:-[{_UP}][{_L}'’]*[{_L}])*"
_LOWTOK = rf"[{_LO}][{_LO}'’]*[{_LO}](?:-[{_LO}]+)*"
_INIT = rf"[{_UP}]\.(?:-[{_UP}]\.)?{_B}?"
_PARTICLE = r"(?:de|du|des|la|le|van|von|der|den|di|da|el|al|ben|bin|d'|d’|O'|Mc)"
_NAME = re.compile(
    rf"(?P<caret>{_FULLTOK}\^{_FULLTOK}(?:\^{_FULLTOK})?)"
    rf"|(?P<init>(?:{_INIT}){{1,2}})(?P<isur>{_FULLTOK})(?P<isur2>{_B}{_FULLTOK})?"
    rf"|(?P<one>{_FULLTOK})(?:(?P<comma>,{_B}(?P<given>{_FULLTOK})(?![{_L}])(?!{_B}?\d))|(?P<more>(?:{_B}(?:{_PARTICLE}{_B}?)?{_FULLTOK}|{_B}[{_UP}]\.(?={_B}{_FULLTOK})){{1,3}}))?"
    rf"|(?P<low>{_LOWTOK})(?P<low2>{_B}{_LOWTOK})?"
)
_DIGIT = re.compile(r"\d")
# Stands for each character of an e-mail address while names are sought.
_MAIL = "\ue000"
_AFTER_TRIGGER = re.compile(rf"(?<![\w]){_ANNOUNCE}{_B}+(?:{_TITLE}{_B}+)?(?=[{_L}])")
_AFTER_TITLE = re.compile(rf"(?<![\w]){_TITLE}{_B}+(?=[{_L}])")
_AFTER_M = re.compile(rf"(?<![\w])M\.{_B}+(?=[{_L}])")
_SIGN_OFF = re.compile(rf"(?:(?<=^)|(?<=[.?!:;)\]»\"'’\w%{_MAIL}] )|(?<=\n))[-–—]{_B}(?=[{_L}])")
_SENTENCE_GOES_ON = re.compile(rf"{_B}*(?!(?:cc|copie|copy){_B}?:)(?:[{_LO}0-9:;=+%/]|\((?!voir|ask|Voir|Ask))")
_NEXT_SENTENCE = re.compile(rf"\s*(?:$|[.,;]|\n|[{_UP}`\[\-–—{_MAIL}]|\((?:voir|ask)|(?:cc|copie|copy){_B}?:)")


def _is_word(token: str) -> bool:
    return token.strip(" ,. ").lower() in _NO_NAME


def _name_at(text: str, at: int, lower: bool, sign_off: bool) -> tuple[int, int] | None:
    """Span of the name that starts at ``at``, or None."""
    m = _NAME.match(text, at)
    if not m:
        return None
    if m["caret"]:
        return m.span("caret")
    if m["init"]:
        if _is_word(m["isur"]):
            return None
        end = m.end("isur")
        if m["isur2"] and not sign_off and not _is_word(m["isur2"]) and not _SENTENCE_GOES_ON.match(text, m.end("isur2")) and m["isur"].isupper() == m["isur2"].strip().isupper():
            end = m.end("isur2")
        return at, end
    if m["one"]:
        if _is_word(m["one"]):
            return None
        if m["comma"] and not _is_word(m["given"]) and (not sign_off or not _SENTENCE_GOES_ON.match(text, m.end("given"))):
            return at, m.end("given")
        ends, previous = [m.end("one")], m["one"]
        if m["more"]:
            for t in re.finditer(rf"{_B}(?:{_PARTICLE}{_B}?)?(?P<t>{_FULLTOK}|[{_UP}]\.)", m["more"]):
                token = t["t"]
                if _is_word(token) or token.isupper() and len(token) > 2 and not previous.isupper() or token == "M.":
                    break
                ends.append(m.start("more") + t.end())
                previous = token
        ends = ends[:2] if sign_off else ends[:3]
        while sign_off and len(ends) > 1 and _SENTENCE_GOES_ON.match(text, ends[-1]):
            ends.pop()
        if sign_off and not _NEXT_SENTENCE.match(text, ends[-1]):
            return None
        return at, ends[-1]
    if lower and m["low"] and not _is_word(m["low"]):
        if m["low2"] and not _is_word(m["low2"]):
            end = m.end("low2")
            return (at, end) if not sign_off or _NEXT_SENTENCE.match(text, end) else None
        return None if sign_off else (at, m.end("low"))
    return None


def _names(text: str) -> Iterator[Span]:
    for m in _AFTER_TRIGGER.finditer(text):
        title = bool(_AFTER_TITLE.search(m[0]))
        if span := _name_at(text, m.end(), True, False):
            if text[span[0]].islower() and " " not in text[slice(*span)] and not title:
                continue
            yield Span(*span, "name", 0.8)
    for m in _AFTER_TITLE.finditer(text):
        if span := _name_at(text, m.end(), True, False):
            yield Span(*span, "name", 0.7)
    for m in _AFTER_M.finditer(text):
        if span := _name_at(text, m.end(), True, False):
            if not text[span[0]].islower() or " " in text[slice(*span)]:
                yield Span(*span, "name", 0.65)
    for m in _SIGN_OFF.finditer(text):
        if span := _name_at(text, m.end(), True, True):
            yield Span(*span, "name", 0.6)


def _phones(text: str) -> Iterator[Span]:
    for pattern, base in PHONES:
        for m in pattern.finditer(text):
            before = text[max(0, m.start() - CONTEXT) : m.start()]
            start = m.start()
            digits = sum(c.isdigit() for c in m[0])
            if digits < 7:
                continue
            score = base + 0.3 * bool(PHONE_WORDS.search(before)) - 0.6 * bool(OTHER_NUMBER.search(before)) - 0.5 * bool(_ID_CAPTION.search(before))
            yield Span(start, m.end(), "phone", score)


def _ids(text: str) -> Iterator[Span]:
    for pattern, kind, base in IDS:
        for m in pattern.finditer(text):
            before = text[max(0, m.start() - CONTEXT) : m.start()]
            digits = re.sub(r"\D", "", m[0])
            caption = bool(_ID_CAPTION.search(before))
            # A number that carries a check and passes it needs no caption; one that fails it needs more than its form.
            check = _CHECKS.get(kind)
            proof = 0.0 if check is None else 0.3 if check(digits) else -0.2
            score = base + 0.6 * caption + proof - 0.6 * bool(OTHER_NUMBER.search(before))
            yield Span(m.start(), m.end(), "id_number", score)


_CHECKS = {"ramq": health_date, "nir": lambda d: len(d) != 15 or mod97(d), "sin": luhn}


def find_spans(text: str) -> list[Span]:
    """Personal data of one text, in order, without overlaps."""
    found = []
    if _AT_SIGN.search(text):
        found += [Span(*m.span(1), "email", 1.0) for m in EMAIL.finditer(text)]
    if _DOT_WORD.search(text):
        found += [Span(*m.span(1), "email", 1.0) for m in EMAIL_WORDS.finditer(text)]
    parts, at = [], 0
    for e in sorted(found):
        if e.start >= at:
            parts += [text[at : e.start], _MAIL * (e.end - e.start)]
            at = e.end
    masked = "".join([*parts, text[at:]])
    if _DIGIT.search(text):
        found += [Span(m.start(), m.end(), "address", base) for p, base in ADDRESSES for m in p.finditer(text)]
        if _FIVE_DIGITS.search(text):
            found += _phones(text)
            found += _ids(text)
    found += _names(masked)
    # Kept spans do not overlap, so only the neighbours of a new one can.
    kept: list[Span] = []
    for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (-s.score, s.start - s.end, s.start)):
        k = bisect_left(kept, s.start, key=lambda x: x.start)
        if (k == 0 or kept[k - 1].end <= s.start) and (k == len(kept) or kept[k].start >= s.end):
            kept.insert(k, s)
    return kept


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its placeholder."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDER.format(s.kind)]
        at = s.end
    return "".join([*out, text[at:]])


_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
_JSON_UNIT = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)


def scan_json(source: str) -> tuple[str, list[tuple[str, str]]]:
    """Redacted JSON text and (type, text) of the personal data in its string values.

    Only the characters of the pieces change. A text that is not valid JSON is scanned as plain text.
    """
    try:
        json.loads(source)
    except ValueError:
        spans = find_spans(source)
        return redact(source, spans), [(s.kind, source[s.start : s.end]) for s in spans]
    out, at, pieces = [], 0, []
    for m in _JSON_STRING.finditer(source):
        if re.match(r"\s*:", source[m.end() : m.end() + 16]):
            continue
        raw = m[0][1:-1]
        value = json.loads(m[0])
        if not (spans := find_spans(value)):
            continue
        pieces += [(s.kind, value[s.start : s.end]) for s in spans]
        if raw == value:
            changed = redact(raw, spans)
        else:
            units, place = [], []
            for u in _JSON_UNIT.finditer(raw):
                units.append(u[0])
                place += [len(units) - 1] * len(json.loads(f'"{u[0]}"'))
            place.append(len(units))
            parts, k = [], 0
            for s in spans:
                parts += ["".join(units[k : place[s.start]]), PLACEHOLDER.format(s.kind)]
                k = place[s.end]
            changed = "".join([*parts, *units[k:]])
        out += [source[at : m.start()], f'"{changed}"']
        at = m.end()
    return "".join([*out, source[at:]]), pieces


def scan_text(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Redacted text and (type, text) of its personal data."""
    spans = find_spans(text)
    return redact(text, spans), [(s.kind, text[s.start : s.end]) for s in spans]


_RESULT = "redacted string, pieces array<struct<pii_type:string,pii_text:string>>"


def _scanner(scan):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(None, []) if t is None else scan(t) for t in s]
            yield frame([(r[0], [{"pii_type": k, "pii_text": x} for k, x in r[1]]) for r in rows], ["redacted", "pieces"])

    return F.pandas_udf(run, _RESULT)


def redact_columns(df: DataFrame, text_columns: list[str], json_columns: list[str] = ()) -> DataFrame:
    """``df`` with each named column redacted in place and ``<column>_pii``: its personal data.

    Defined cases: null stays null with an empty list; empty texts stay; texts of any
    length are scanned whole; repeated rows give repeated results; other columns pass
    through. Map-only: no shuffle, one Arrow batch at a time.
    """
    for c, scan in [*((c, scan_text) for c in text_columns), *((c, scan_json) for c in json_columns)]:
        got = df.withColumn("_scan", _scanner(scan)(F.col(c).cast("string")))
        df = got.withColumn(c, F.col("_scan.redacted")).withColumn(f"{c}_pii", F.col("_scan.pieces")).drop("_scan")
    return df


def found_pieces(reviews: DataFrame, row_id: str = "review_id") -> DataFrame:
    """Distinct (review_id, field, pii_type, pii_text) of the two text fields."""
    scanned = redact_columns(spread(reviews.select(row_id, "source_text", "report_context"), row_id), ["source_text"], ["report_context"])
    rows = scanned.select(F.col(row_id).alias("review_id"), F.explode(F.array(
        F.struct(F.lit("source_text").alias("field"), F.col("source_text_pii").alias("pieces")),
        F.struct(F.lit("report_context").alias("field"), F.col("report_context_pii").alias("pieces")),
    )).alias("x")).select("review_id", "x.field", F.explode("x.pieces").alias("p"))
    return rows.select("review_id", "field", "p.pii_type", "p.pii_text").distinct()
