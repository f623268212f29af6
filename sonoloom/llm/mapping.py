"""Freely typed values mapped to a reference list (problem 5).

All names of an entry (id, labels, aliases) go into one trie, written without blanks,
separators, case and accents. A value is searched with a Levenshtein automaton (with
transposition) whose transition table is shared by all values: the automaton and the trie
are walked together, so only prefixes within the distance are visited. The distance
allowed depends on the length. All entries within it are returned; the least distance
decides, and a tie between entries means no match. A value cut short by a full stop is
completed: its last word from the words of the list, or the whole from the trie.
"""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.llm.frames import frame

UNMATCHED = "unmatched"
MAX_ENTRIES = 200_000
CACHE_VALUES = 200_000
_CAMEL = re.compile(r"(?<=[a-zà-ÿ0-9])(?=[A-ZÀ-Þ])")
_WORD = re.compile(r"[a-z0-9]+")
_CUT = re.compile(r"[^\W\d_]\.[\s?*]*$")
LEAST_CUT = 8
_GROUP = re.compile(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}")


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c)).lower().replace("œ", "oe").replace("æ", "ae")


def compact(text: str) -> str:
    """Letters and digits only."""
    return "".join(_WORD.findall(fold(text)))


def allowed_distance(length: int) -> int:
    """Edits allowed for a name of this many letters."""
    return 0 if length < 5 else 1 if length < 9 else 2 if length < 18 else 3


class Automaton:
    """Universal Levenshtein automaton for up to ``k`` edits, its transitions made when first used.

    A state is a set of (offset, edits, transposing) relative to a base place in the word;
    a transition depends only on the state, on which of the next letters equal the one
    read, and on how many letters are left.
    """

    def __init__(self, k: int):
        self.k, self.width = k, 2 * k + 2
        self.moves: dict = {}

    def start(self) -> tuple:
        return ((0, 0, 0),)

    def step(self, state: tuple, bits: tuple, left: int) -> tuple[int, tuple] | None:
        """(shift of the base, state) after one letter, or None."""
        key = (state, bits, left)
        if key in self.moves:
            return self.moves[key]
        reached: set[tuple[int, int, int]] = set()
        for i, e, swap in state:
            here = bits[i:]
            if swap:
                if here and here[0]:
                    reached.add((i + 2, e, 0))
                continue
            if here and here[0]:
                reached.add((i + 1, e, 0))
                continue
            if e < self.k:
                reached.add((i, e + 1, 0))
                if i < left:
                    reached.add((i + 1, e + 1, 0))
                if len(here) > 1 and here[1]:
                    reached.add((i, e + 1, 1))
            for j in range(1, min(self.k - e, len(here) - 1) + 1):
                if here[j]:
                    reached.add((i + j + 1, e + j, 0))
                    break
        kept = [p for p in reached if not any(q != p and not q[2] and abs(p[0] - q[0]) <= p[1] - q[1] and (not p[2] or q[1] < p[1]) for q in reached)]
        out = None
        if kept:
            shift = min(p[0] for p in kept)
            out = shift, tuple(sorted((i - shift, e, s) for i, e, s in kept))
        self.moves[key] = out
        return out


class Trie:
    """Names of the entries; a node is a dict of letters, with the entries that end there under ''."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.words: dict[str, list[str]] = {}
        self.automata: dict[int, Automaton] = {}
        vocabulary: set[str] = set()
        for entry, name in names:
            node = self.root
            for c in compact(name):
                node = node.setdefault(c, {})
            if node is not self.root:
                node.setdefault("", set()).add(entry)
            vocabulary.update(w for w in _WORD.findall(fold(_CAMEL.sub(" ", name))) if len(w) > 4)
        for w in sorted(vocabulary):
            for n in range(4, len(w)):
                self.words.setdefault(w[:n], []).append(w)

    def search(self, word: str, k: int) -> dict[str, int]:
        """Every entry with a name within ``k`` edits of ``word``, and its distance."""
        if k == 0:
            node = self.root
            for c in word:
                if (node := node.get(c)) is None:
                    return {}
            return dict.fromkeys(node.get("", ()), 0)
        auto = self.automata.setdefault(k, Automaton(k))
        n, width, found = len(word), auto.width, {}
        stack = [(self.root, 0, auto.start(), 0)]
        while stack:
            node, base, state, depth = stack.pop()
            if ends := node.get(""):
                rest = [n - base - i + e for i, e, swap in state if not swap]
                if rest and (d := min(rest)) <= min(k, allowed_distance(min(n, depth))):
                    for entry in ends:
                        found[entry] = min(d, found.get(entry, d))
            window, left = word[base : base + width], min(n - base, width)
            for c, child in node.items():
                if c and (move := auto.step(state, tuple(x == c for x in window), left)):
                    stack.append((child, base + move[0], move[1], depth + 1))
        return found


    def below(self, word: str) -> dict[str, int]:
        """Entries with a name that begins with ``word``, and how many letters follow at least."""
        node = self.root
        for c in word:
            if (node := node.get(c)) is None:
                return {}
        found: dict[str, int] = {}
        stack = [(node, 0)]
        while stack:
            node, more = stack.pop()
            for c, child in node.items():
                if c:
                    stack.append((child, more + 1))
                else:
                    found |= {e: min(more, found.get(e, more)) for e in child}
        return found


def variants(value: str, trie: Trie) -> list[str]:
    """Readings of a value, the most faithful first, written compactly.

    The value itself; its parts around a comma in the other order; the same without
    bracketed remarks, without a leading caption before a colon, and without a last part
    set off by a comma or dash; words cut by a full stop written out.
    """
    plain = value.strip()
    bare = _GROUP.sub(" ", plain).strip()
    texts = [plain]
    if bare != plain:
        texts.append(bare)
    if ":" in bare:
        texts.append(bare.split(":", 1)[1])
    texts += [t.rsplit(mark, 1)[0] for t in list(texts) for mark in (",", " - ", "_-_", " -- ") if mark in t]
    texts += [t.rsplit(mark, 1)[0] for t in list(texts) for mark in (",", " - ") if mark in t]
    out: OrderedDict[str, None] = OrderedDict()
    for t in texts:
        forms = [t]
        if "," in t:
            parts = [p for p in t.split(",") if p.strip()]
            forms.append(" ".join(reversed(parts)))
            if len(parts) > 2:
                forms += [" ".join([parts[1], parts[0], *parts[2:]]), " ".join([*parts[1:], parts[0]])]
        for f in forms:
            out.setdefault(compact(f))
            folded = fold(_CAMEL.sub(" ", f))
            for m in re.finditer(r"([^\W\d_]{4,})\.", folded):
                for w in trie.words.get(compact(m[1]), ()):
                    out.setdefault(compact(folded[: m.start()] + w + " " + folded[m.end() :]))
    return [v for v in out if v]


class Mapper:
    """Value -> entry id or UNMATCHED, remembering recent values."""

    def __init__(self, names: list[tuple[str, str]]):
        self.trie = Trie(names)
        self.cache: OrderedDict[str, tuple[str, int]] = OrderedDict()

    def candidates(self, value: str) -> dict[str, int]:
        """Every entry within the allowed distance of the value or one of its readings."""
        out: dict[str, int] = {}
        for v in variants(value, self.trie):
            for entry, d in self.trie.search(v, allowed_distance(len(v))).items():
                out[entry] = min(d, out.get(entry, d))
        return out

    def best(self, value: str) -> tuple[str, int]:
        """The entry meant and its distance; (UNMATCHED, -1) if none or if several are as near."""
        if (known := self.cache.get(value)) is not None:
            return known
        readings, answer = variants(value, self.trie), (UNMATCHED, -1)
        for k in range(4):
            hits: dict[str, int] = {}
            for v in readings:
                if k <= allowed_distance(len(v)) and (found := {e for e, d in self.trie.search(v, k).items() if d == k}):
                    hits = dict.fromkeys(found, k)
                    break
            if hits:
                answer = (next(iter(hits)), k) if len(hits) == 1 else (UNMATCHED, -1)
                break
        else:
            # A value cut short by a full stop means the only entry that goes on from it.
            cut = compact(_GROUP.sub(" ", value))
            if _CUT.search(_GROUP.sub(" ", value)) and len(cut) >= LEAST_CUT and len(hits := self.trie.below(cut)) == 1:
                answer = next(iter(hits.items()))
        if len(self.cache) >= CACHE_VALUES:
            self.cache.popitem(last=False)
        self.cache[value] = answer
        return answer


def entry_names(reference: DataFrame, entry_id: str, single: list[str], many: list[str]) -> list[tuple[str, str]]:
    """(entry id, name) of the reference list, taken to the driver; refuses more than MAX_ENTRIES names."""
    names = F.array_compact(F.concat(F.array(F.col(entry_id).cast("string"), *[F.col(c).cast("string") for c in single]), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in many]))
    rows = reference.where(F.col(entry_id).isNotNull()).select(F.col(entry_id).cast("string").alias("e"), F.explode(names).alias("n")).distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has over {MAX_ENTRIES} names; split it by kind")
    return sorted((r.e, r.n) for r in rows)


def map_values(values: DataFrame, names: list[tuple[str, str]], value: str = "value") -> DataFrame:
    """``values`` with concept_id (or ``unmatched``) and distance (-1 if unmatched); null values give null.

    Map-only: each batch looks its distinct values up once, so a value that fills a third
    of the rows costs one search per batch. Other columns pass through.
    """
    held = values.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mapper = Mapper(held.value)
        for s in batches:
            got = {v: mapper.best(v) for v in s.dropna().unique()}
            rows = [got[v] if v is not None else (None, None) for v in s]
            yield frame(rows, ["concept_id", "distance"])

    got = F.pandas_udf(run, "concept_id string, distance int")(F.col(value).cast("string"))
    return values.withColumn("_m", got).withColumn("concept_id", F.col("_m.concept_id")).withColumn("distance", F.col("_m.distance")).drop("_m")


def value_candidates(values: DataFrame, names: list[tuple[str, str]], value: str = "value") -> DataFrame:
    """value, concept_id, distance: every entry within the length-dependent distance of a distinct value or one of its readings, also where several are as near."""
    held = values.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = Mapper(held.value)
        for pdf in batches:
            yield frame([(v, c, d) for v in pdf["value"] for c, d in sorted(mapper.candidates(v).items())], ["value", "concept_id", "distance"])

    distinct = values.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value")).distinct()
    return distinct.mapInPandas(run, "value string, concept_id string, distance int")


def typed_values(mappings: DataFrame, row_id: str = "mapping_id") -> DataFrame:
    """One row per typed value: (mapping_id, field, item_no, value).

    Null and blank values give no row; a null or empty array gives none.
    """
    label = F.array(F.struct(F.lit("label").alias("field"), F.lit(0).alias("item_no"), F.col("label").cast("string").alias("value")))
    items = F.transform(
        F.coalesce(F.col("concepts").cast("array<string>"), F.array().cast("array<string>")),
        lambda c, k: F.struct(F.lit("concepts").alias("field"), (k + 1).alias("item_no"), c.alias("value")),
    )
    rows = mappings.select(F.col(row_id).alias("mapping_id"), F.explode(F.concat(label, items)).alias("x")).select("mapping_id", "x.*")
    return rows.where(F.length(F.trim("value")) > 0)


def mapped_labels(mappings: DataFrame, ontology: DataFrame) -> DataFrame:
    """mapping_id, field, item_no, value, concept_id, distance of every typed value."""
    return map_values(typed_values(mappings), entry_names(ontology, "concept_id", ["label_en", "label_fr"], ["aliases"]))


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """Values without a match and how often they were typed."""
    return mapped.where(F.col("concept_id") == UNMATCHED).groupBy("field", "value").agg(F.count("*").alias("n_rows"))
