"""Character rules behind the one consistent text form.

All tables come from the Unicode database by rule; only the look-alike letters are a
fixed list. ``prepare`` applies the rules that need no model: compatibility forms
(width, ligatures, blanks), deletion of ignorable characters, decomposition.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters and signs of other scripts with the shape of a Latin one.
LOOKALIKES = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "o": "оοօ", "p": "р",
    "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫͿ",
    "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ",
    "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    ":": "∶꞉", "/": "∕⁄", "|": "∣ǀ", "*": "∗", "~": "∼",
}
# Characters that draw nothing beside those of category Cf.
_IGNORABLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)]
# Characters of category Cf that are drawn.
_DRAWN = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
# Compatibility letters whose shape differs from their plain form.
_OTHER_SHAPE = [0x017F, 0x1E9B, *range(0x03D0, 0x03D7), *range(0x03F0, 0x03F3), 0x03F4, 0x03F5, 0x03F9]


@lru_cache(maxsize=1)
def compat_table() -> dict[int, str | None]:
    """Code point -> replacement (None: deleted) of the forms that look the same."""
    out: dict[int, str | None] = {c: None for c in _IGNORABLE}
    drawn, other = set(_DRAWN), set(_OTHER_SHAPE)
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" and cp not in drawn:
            out[cp] = None
        elif kind == "Zs":
            out[cp] = " "
        elif cp in (0x2028, 0x2029, 0x85):
            out[cp] = "\n"
        elif decomposition := unicodedata.decomposition(ch):
            if decomposition[0] != "<" or cp in other or cp in out:
                continue
            tag, *codes = decomposition.split()
            letters = kind[0] == "L" or kind == "Nl"
            if tag in ("<wide>", "<narrow>") or tag in ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>") and letters:
                out[cp] = "".join(chr(int(c, 16)) for c in codes)
    for cp in [*range(0x00, 0x20), 0x7F, *range(0x80, 0xA0)]:
        if cp not in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85):
            out[cp] = None
    out[0x09] = " "
    return out


PROTOTYPE = {other: latin for latin, others in LOOKALIKES.items() for other in others}
_SPECIAL_ASCII = re.compile("[\x00-\x09\x0b-\x1f\x7f]")
_RETURNS = re.compile("\r\n?")


class Filled(dict):
    """Translation table that works a code point out when it first meets it; a plain dict is slow on every miss."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, cp: int) -> str | None:
        self[cp] = out = self.rule(chr(cp))
        return out


def _decomposed(ch: str) -> str | None:
    form = compat_table().get(ord(ch), ch)
    return None if form is None else unicodedata.normalize("NFD", form)


_PREPARE = Filled(_decomposed)
TO_PROTOTYPE = Filled(lambda ch: PROTOTYPE.get(ch, ch))
SIGNS_TO_PROTOTYPE = Filled(lambda ch: plain if (plain := PROTOTYPE.get(ch, ch)) and not plain.isalpha() else ch)


def prepare(text: str) -> str:
    """Decomposed text after compatibility forms are folded and ignorable characters are gone."""
    if text.isascii() and not _SPECIAL_ASCII.search(text):
        return text
    t = _RETURNS.sub("\n", text).translate(_PREPARE)
    return t if t.isascii() else unicodedata.normalize("NFD", t)


def skeleton(text: str) -> str:
    """``prepare`` with every look-alike replaced by its Latin shape: equal for texts that look the same."""
    t = prepare(text)
    return t if t.isascii() else t.translate(TO_PROTOTYPE)


def _folded(ch: str) -> str | None:
    """What is left of a character when words are compared."""
    form = _decomposed(ch)
    if form is None:
        return None
    plain = "".join(PROTOTYPE.get(c, c) for c in form)
    return unicodedata.normalize("NFC", "".join(c for c in plain if unicodedata.category(c) != "Mn"))


_FOLD = Filled(_folded)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits; case, accents, punctuation and look-alikes do not count."""
    if not text.isascii() or _SPECIAL_ASCII.search(text):
        text = _RETURNS.sub("\n", text).translate(_FOLD)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())
