"""One consistent form for texts that look the same (problem 8).

After the model-free rules of :mod:`chars`, each token is a lattice: every position may
be read as any member of its look-alike class. Viterbi picks the reading that is most
likely under character bigrams of one script, with a penalty for a change of script.
The lattice depends only on the classes and not on which member was written, so texts
that look the same get the same form; classes are disjoint and every path stays within
them, so texts that look different keep different forms.

Letters that only resemble a Latin one (a Greek alpha, a Cyrillic ka) belong to no class:
whether a text with one looks like another text is ambiguous, and the Viterbi score decides
it. Among Latin letters the reading as the Latin letter saves two changes of script and
wins; in a Greek word the letter stays what it is.

The bigram counts cover the tokens of all documents that are written in one of SCRIPTS
beyond doubt (Latin letters only, or another script with at least one letter without a look-alike).
The model holds one number per pair of letters of these scripts, a bound that does not
grow with the corpus; letters of other scripts have no look-alike and are not counted.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.skew import spread
from sonoloom.llm.chars import LOOKALIKES, PROTOTYPE, SIGNS_TO_PROTOTYPE, TO_PROTOTYPE, compat_table, prepare
from sonoloom.llm.frames import frame
from sonoloom.llm.pairs import pairs_across_classes

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")
SWITCH_PENALTY = 12.0
RESEMBLES_COST = 8.0
# Letters of other scripts that resemble a Latin one without having its shape.
RESEMBLING = {"a": "α", "i": "ι", "k": "κк", "m": "м", "n": "пη", "o": "σ", "p": "ρ", "r": "г", "t": "τт", "u": "υ", "w": "ω", "x": "χ", "y": "γ", "b": "ь", "h": "ћ", "g": "ց"}
CACHE_TOKENS = 200_000
COUNT_CHARS = 2_000_000
_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_TOKEN = re.compile(rf"([^\W\d_][^\W\d_{_MARKS}]*(?:[{_MARKS}]+[^\W\d_]*)*)")
_AMBIGUOUS = {m for latin, others in LOOKALIKES.items() for m in latin + others}


def script_of(ch: str) -> str | None:
    """Script of a letter by its Unicode name; None for marks and scripts outside SCRIPTS."""
    first = unicodedata.name(ch, "").split(" ", 1)[0]
    return first if first in SCRIPTS else "OTHER" if ch.isalpha() else None


_MEMBERS = {latin: [(m, script_of(m), 0.0) for m in latin + others] for latin, others in LOOKALIKES.items() if latin.isalpha()}
_WEAK = {other: latin for latin, others in RESEMBLING.items() for other in others}


@lru_cache(maxsize=None)
def options(ch: str) -> list[tuple[str, str | None, float]]:
    """(letter, script, cost) of every reading of a letter.

    A letter of a look-alike class may be read as any member at no cost, so the form does
    not depend on the member written. One that only resembles a class may be read as a
    member at RESEMBLES_COST; the rest of the token decides.
    """
    own = PROTOTYPE.get(ch, ch)
    if own in _MEMBERS:
        return _MEMBERS[own]
    plain = _WEAK.get(ch)
    return [(ch, script_of(ch), 0.0)] + [(m, of, RESEMBLES_COST) for m, of, _ in _MEMBERS.get(plain, [(plain, script_of(plain), 0.0)] if plain else [])]


class PairCounts:
    """Letter pairs of many texts at once, over arrays of code points.

    A token counts if its letters are Latin, or all of one other script of SCRIPTS with at
    least one that has no look-alike. Accents and invisible characters are passed over, as
    in :func:`chars.prepare`.
    """

    def __init__(self):
        self.base = np.full(0x110000, -2, dtype=np.int32)  # -2: not met yet, -1: passed over, 0: no letter
        self.total: Counter = Counter()

    def _learn(self, codes: np.ndarray) -> None:
        met = np.flatnonzero(np.bincount(codes, minlength=0x110000))
        for cp in met[self.base[met] == -2].tolist():
            form = [c for c in prepare(chr(cp)) if unicodedata.combining(c) == 0]
            # What stands for several letters is written out before (SEVERAL).
            self.base[cp] = -1 if not form else ord(form[0]) if form[0].isalpha() else 0

    def add(self, texts: list[str]) -> None:
        text = _SEVERAL.sub(lambda m: prepare(m[0]), "\n".join(texts))
        codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._learn(codes)
        letters = self.base[codes]
        letters = letters[letters != -1]
        kinds = np.unique(letters)
        kinds = kinds[kinds > 0]
        if not len(kinds):
            return
        dense = np.zeros(0x110000, dtype=np.int32)
        dense[kinds] = np.arange(1, len(kinds) + 1)
        ids = dense[letters]
        of = [script_of(chr(c)) for c in kinds.tolist()]
        number = {s: k + 1 for k, s in enumerate(SCRIPTS)}
        script = np.array([0] + [number.get(s, 99) for s in of], dtype=np.int8)[ids]
        plain = np.array([True] + [chr(c) not in _AMBIGUOUS or s == "LATIN" for c, s in zip(kinds.tolist(), of)])[ids]
        inside = np.flatnonzero(ids)
        starts = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
        low, high = np.minimum.reduceat(script[inside], starts), np.maximum.reduceat(script[inside], starts)
        good = (low == high) & (high < 99) & np.maximum.reduceat(plain[inside], starts)
        keep = np.repeat(good, np.diff(starts, append=len(inside)))
        ids[inside[~keep]] = 0
        size = len(kinds) + 1
        counts = np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
        name = ["", *map(chr, kinds.tolist())]
        for k in np.flatnonzero(counts).tolist():
            if k:
                x, y = divmod(k, size)
                self.total[(name[x] or "^") + (name[y] or "$")] += int(counts[k])


def _several() -> re.Pattern:
    """Characters whose plain form has more than one letter, such as ligatures."""
    many = [chr(cp) for cp, form in compat_table().items() if form and len(form) > 1]
    return re.compile("[" + re.escape("".join(sorted(many))) + "]")


_SEVERAL = _several()


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs = PairCounts()
    for pdf in batches:
        texts, size = [], 0
        for text in pdf["text"]:
            if text:
                texts.append(text)
                size += len(text)
                if size >= COUNT_CHARS:
                    pairs.add(texts)
                    texts, size = [], 0
        if texts:
            pairs.add(texts)
    yield frame(list(pairs.total.items()), ["pair", "n"])


def script_model(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Bigram counts over all documents: letter pair -> count. At most one entry per pair of letters."""
    counts = spread(docs.select(F.col(text).cast("string").alias("text"))).mapInPandas(_count_batches, "pair string, n long")
    return {r.pair: r.n for r in counts.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


class Reader:
    """Viterbi over token lattices under one script model."""

    def __init__(self, model: dict[str, int]):
        self.pairs = model
        self.letters: Counter = Counter()
        for pair, n in model.items():
            self.letters[pair[1]] += n
        self.total = sum(self.letters.values()) + 1
        self.cache: OrderedDict[str, str] = OrderedDict()

    def _step(self, a: str, b: str) -> float:
        chance = (self.letters.get(a, 0) + 0.01) * (self.letters.get(b, 0) + 0.01) / self.total
        return math.log(self.pairs.get(a + b, 0) + 0.1 * chance + 1e-6)

    def token(self, token: str) -> str:
        """Best reading of a decomposed token."""
        if (known := self.cache.get(token)) is not None:
            return known
        paths: dict[str, tuple[float, str, str | None]] = {"^": (0.0, "", None)}
        for ch in token:
            if unicodedata.combining(ch):
                paths = {last: (score, done + ch, script) for last, (score, done, script) in paths.items()}
                continue
            paths = {
                m: max(
                    (score + self._step(last, m) - cost - SWITCH_PENALTY * (script is not None and script != of), done + m, of)
                    for last, (score, done, script) in paths.items()
                )
                for m, of, cost in options(ch)
            }
        best = max(((score + self._step(last, "$"), done) for last, (score, done, _) in paths.items()), key=lambda x: x[0])[1]
        if len(self.cache) >= CACHE_TOKENS:
            self.cache.popitem(last=False)
        self.cache[token] = best
        return best

    def text(self, text: str) -> str:
        """The consistent form of a whole text."""
        t = prepare(text)
        if not t.isascii():
            t = t.translate(SIGNS_TO_PROTOTYPE)
        # The reading depends on the classes only, so tokens are looked up by their Latin shape.
        parts, known = _TOKEN.split(t), self.cache
        for k in range(1, len(parts), 2):
            w = parts[k]
            parts[k] = known.get(w) or self.token(w if w.isascii() else w.translate(TO_PROTOTYPE))
        t = "".join(parts)
        return t if t.isascii() else unicodedata.normalize("NFC", t)


def consistent_text(docs: DataFrame, model: dict[str, int] | None = None, text: str = "text", out: str = "form") -> DataFrame:
    """``docs`` with the column ``out``: the consistent form of ``text``, null for null.

    Other columns pass through, whatever their names (an existing ``out`` is replaced).
    Empty and blank texts are normalised like any other; very long texts are processed whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(script_model(docs, text) if model is None else model)

    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(held.value)
        for s in batches:
            yield pd.Series([None if t is None else reader.text(t) for t in s], dtype=object)

    return docs.withColumn(out, F.pandas_udf(form, "string")(F.col(text).cast("string")))


def _digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def form_digests(docs: DataFrame, model: dict[str, int] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, form (digest of the consistent form) and raw (digest of the characters) of every text that is not blank."""
    held = docs.sparkSession.sparkContext.broadcast(script_model(docs, text) if model is None else model)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(held.value)
        for pdf in batches:
            rows = [(i, _digest(f), _digest(t)) for i, t in zip(pdf["id"], pdf["text"]) if t and (f := reader.text(t)) and not f.isspace()]
            yield frame(rows, ["id", "form", "raw"])

    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), "id")
    return rows.mapInPandas(digests, "id long, form string, raw string")


def lookalike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: class of texts that look the same, number of documents and of spellings in it."""
    d = form_digests(docs, None, doc_id, text)
    per_raw = d.groupBy("form", "raw").agg(F.count("*").alias("n"))
    per_form = per_raw.groupBy("form").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_spellings"))
    return d.join(per_form, "form").select(F.col("id").alias("doc_id"), F.col("form").alias("class_id"), "n_docs", "n_spellings")


def lookalike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents that look the same but differ in characters: doc_id_a < doc_id_b."""
    d = form_digests(docs, None, doc_id, text)
    found = pairs_across_classes(d, "form", "raw", "id", label="lookalike")
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))
