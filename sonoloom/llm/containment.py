"""Evaluation passages quoted inside documents (problem 7): size-partitioned MinHash containment search.

A document leaks an item if it holds at least ``run`` consecutive words of it, that is
``run - shingle + 1`` consecutive shingles. Items are cut into query windows of that many
shingles, documents into segments of ``STRIDE - 1`` more, every STRIDE words, so that each
window lies whole inside some segment of a document that quotes it: its containment there
is 1. With m distinct shingles in the window, the Jaccard similarity of the two is then at
least m / (m + STRIDE - 1). The windows are partitioned by m; every partition turns its own
bound into rows per band and bands that must agree (the most that keep the chance of a miss
under MISS), and its band keys of PERMUTATIONS MinHash values are joined with those of the
segments by a shuffle.
A candidate counts only if its words stand in the segment, one after the other.

Before the shuffle, band keys of segments are tested against a bitmap of the band keys of
the windows (a semi-join reduction with a fixed number of bits; a full bitmap lets more rows
pass and loses none). The corpus is read once for any number of items, and nothing of the
items but the bitmap goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.skew import hot_keys, salted_join, spread
from sonoloom.llm.chars import words
from sonoloom.llm.frames import frame
from sonoloom.session import write_scratch

RUN = 13
SHINGLE = 5
STRIDE = 4
PERMUTATIONS = 64
MISS = 1e-6
BITMAP_BITS = 27
# Windows of an item that follow each other share most band keys; so many make up a block.
BLOCK = 32
FLUSH_WORDS = 400_000
WORD_CACHE = 1_000_000
# Upper bounds of the size classes of windows, in distinct shingles.
SIZE_CLASSES = (2, 4, 7, 15, 1 << 30)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


class WordNumbers(dict):
    """64-bit number of a word, remembered for up to WORD_CACHE words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` word numbers."""
    n = len(ids) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n <= 0:
        return out
    for k in range(size):
        out = (out ^ ids[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _permutations() -> list[tuple[np.uint32, np.uint32]]:
    """Odd factor and shift of every permutation of 32-bit numbers."""
    draw = lambda name, k: np.uint32(xxhash.xxh32_intdigest(f"{name}{k}"))
    return [(draw("factor", k) | np.uint32(1), draw("shift", k)) for k in range(PERMUTATIONS)]


_PERMUTATIONS = _permutations()


def signatures(shingles: np.ndarray, width: int, stride: int = 1) -> np.ndarray:
    """PERMUTATIONS MinHash values (a row each) of the runs of ``width`` shingles, every ``stride``."""
    low = ((shingles * _MIX2) >> np.uint64(32)).astype(np.uint32)
    return np.stack([sliding_min(low * a + b, width)[::stride] for a, b in _PERMUTATIONS])


def rows_per_band(distinct: int, stride: int = STRIDE) -> int:
    """Most rows a band may have so that windows of this many distinct shingles are missed with a chance under MISS."""
    similar = distinct / (distinct + stride - 1)
    best = 1
    for r in range(2, 9):
        if (1 - similar**r) ** (PERMUTATIONS // r) <= MISS:
            best = r
    return best


def least_hits(distinct: int, rows: int, stride: int = STRIDE) -> int:
    """Most bands that may be asked to agree so that windows of this many distinct shingles are missed with a chance under MISS."""
    bands, p = PERMUTATIONS // rows, (distinct / (distinct + stride - 1)) ** rows
    hits, below = 1, (1 - p) ** bands
    while hits < bands:
        below += comb(bands, hits) * p**hits * (1 - p) ** (bands - hits)
        if below > MISS:
            break
        hits += 1
    return hits


def size_classes(width: int, stride: int = STRIDE) -> list[tuple[int, int, int, int]]:
    """(least, most distinct shingles, rows per band, bands that must agree) of each size class up to ``width``."""
    out, low = [], 1
    for high in SIZE_CLASSES:
        high = min(high, width)
        if low <= high:
            rows = rows_per_band(low, stride)
            out.append((low, high, rows, least_hits(low, rows, stride)))
            low = high + 1
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """Key of every band (a row each) of signatures; keys of other numbers of rows or bands never meet."""
    out = []
    for band in range(len(values) // rows):
        key = np.full(values.shape[1], band * 16 + rows, dtype=np.uint64)
        for v in values[band * rows : (band + 1) * rows]:
            key = (key ^ v) * _MIX
            key ^= key >> np.uint64(31)
        out.append(key)
    return np.stack(out) if out else np.zeros((0, values.shape[1]), dtype=np.uint64)


def _positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of every key in a bitmap of 2**bits bits."""
    shift = np.uint64(64 - bits)
    return keys >> shift, (keys * _MIX2) >> shift


class KeyFilter:
    """Bitmap of band keys; rows per band that any window uses -> bands that must agree at least."""

    def __init__(self, bits: int, word: np.ndarray, mask: np.ndarray, rows: dict[int, int]):
        packed = np.zeros(1 << (bits - 6), dtype=np.int64)
        packed[word] = mask
        self.n_bits, self.bits, self.rows = bits, packed.view(np.uint8), rows

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True where a key may be one of the windows'."""
        out = None
        for at in _positions(keys, self.n_bits):
            hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def _window_rows(run: int, size: int):
    width = run - size + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, classes = WordNumbers(), size_classes(width)
        for pdf in batches:
            out = []
            for item, text in zip(pdf["id"], pdf["text"]):
                w = words(text) if text else []
                if len(w) < run:
                    continue
                shingles = shingle_hashes(np.array([number[x] for x in w], dtype=np.uint64), size)
                values = signatures(shingles, width)
                keys = {r: band_keys(values, r) for _, _, r, _ in classes}
                last = len(w) - run + 1
                for base in range(0, last, BLOCK):
                    held, used = set(), {}
                    for k in range(base, min(base + BLOCK, last)):
                        m = len(set(shingles[k : k + width].tolist()))
                        r, hits = next((r, hits) for low, high, r, hits in classes if low <= m <= high)
                        held.update(keys[r][:, k].view(np.int64).tolist())
                        used[r] = min(hits, used.get(r, hits))
                    out.append((item, base, last, [" ".join(w[k : k + run]) for k in range(base, min(base + BLOCK, last))], used, sorted(held)))
            yield frame(out, ["item_id", "base", "n", "windows", "bands", "keys"])

    return rows


def _segment_rows(held, run: int, size: int):
    width = run - size + STRIDE

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: KeyFilter = held.value
        number = WordNumbers()

        def flush(tokens: list[str], ends: list[int], docs: list[int]) -> pd.DataFrame:
            out: list[tuple] = []
            # Texts are padded to whole segments, so a segment starts every STRIDE words of the block.
            shingles = shingle_hashes(np.array([number[x] for x in tokens], dtype=np.uint64), size)
            if known.rows and len(shingles) >= width:
                values, owner = signatures(shingles, width, STRIDE), np.array(ends)
                passed: dict[int, list[int]] = {}
                for r, hits in known.rows.items():
                    keys = band_keys(values, r)
                    has = known.has(keys)
                    band, place = np.nonzero(has & (has.sum(axis=0) >= hits))
                    for s, k in zip(place.tolist(), keys[band, place].view(np.int64).tolist()):
                        passed.setdefault(s, []).append(k)
                for s, k in passed.items():
                    at = s * STRIDE
                    out.append((docs[int(np.searchsorted(owner, at, side="right"))], " ".join(tokens[at : at + width + size - 1]).strip(), k))
            return frame(out, ["doc_id", "segment", "keys"])

        for pdf in batches:
            tokens, ends, docs = [], [], []
            for doc, text in zip(pdf["id"], pdf["text"]):
                w = words(text) if text else []
                if len(w) < run:
                    continue
                tokens += w
                # Empty words up to the next start of a segment, and enough of them that no window crosses into the next text.
                tokens += [""] * (STRIDE - len(w) % STRIDE + STRIDE * -(-(width + size) // STRIDE))
                ends.append(len(tokens))
                docs.append(doc)
                if len(tokens) >= FLUSH_WORDS:
                    yield flush(tokens, ends, docs)
                    tokens, ends, docs = [], [], []
            yield flush(tokens, ends, docs)

    return rows


def _filter_of(blocks: DataFrame, bits: int) -> KeyFilter:
    """Bitmap of the band keys of ``blocks``; at most 2**(bits - 6) words of 64 bits come to the driver."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = np.unique(np.concatenate([np.asarray(k, dtype=np.int64) for k in pdf["keys"]] or [np.zeros(0, np.int64)])).view(np.uint64)
            yield pd.DataFrame({"place": np.unique(np.concatenate(_positions(keys, bits))).astype(np.int64)})

    words = blocks.select("keys").mapInPandas(places, "place long").groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).toPandas()
    return KeyFilter(bits, words["word"].to_numpy(dtype=np.int64), words["mask"].to_numpy(dtype=np.int64), {r.key: r.hits for r in blocks.select(F.explode("bands")).groupBy("key").agg(F.min("value").alias("hits")).collect()})


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN, shingle: int = SHINGLE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, item_id, n_shared (windows of the item found in the document), containment (their share of the item's).

    Defined cases: null, blank and shorter texts than ``run`` words hold and leak nothing;
    a document that quotes an item twice gives one row; repeated documents each give
    theirs; other columns are ignored; long texts are searched whole. A window is missed
    with a chance under MISS; a longer quotation has more than one.

    Segments that many documents share are searched once: candidates are made for distinct
    segments and distinct windows, and both are joined back with salts for hot ones.
    """
    size = min(shingle, run)
    texts = lambda df, key: df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    blocks = write_scratch(texts(items, item_id).mapInPandas(_window_rows(run, size), "item_id long, base int, n int, windows array<string>, bands map<int,int>, keys array<long>"), "windows")
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(blocks, bits))
    found = spread(texts(docs, doc_id), "id").mapInPandas(_segment_rows(held, run, size), "doc_id long, segment string, keys array<long>")
    segments = write_scratch(found, "segments")

    # Numbers of distinct segments and of distinct blocks of windows meet on equal band keys; texts are compared once per pair.
    number = F.monotonically_increasing_id()
    segs = write_scratch(segments.groupBy("segment").agg(F.first("keys").alias("keys")).withColumn("sid", number), "distinct-segments")
    asked = F.array_min(F.map_values("bands"))
    blks = write_scratch(blocks.groupBy("windows").agg(F.first("keys").alias("keys"), F.min(asked).alias("hits")).withColumn("bid", number), "distinct-windows")
    seg_keys, blk_keys = segs.select("sid", F.explode("keys").alias("key")), blks.select("bid", "hits", F.explode("keys").alias("key"))
    agree = salted_join(seg_keys, blk_keys, "key", hot_keys(seg_keys, "key"), F.col("sid")).groupBy("sid", "bid").agg(F.count("*").alias("n"), F.min("hits").alias("hits"))
    met = write_scratch(agree.where("n >= hits").select("sid", "bid"), "met")
    both = salted_join(met.join(segs.select("sid", "segment"), "sid"), blks.select("bid", "windows"), "bid", hot_keys(met, "bid"), F.col("sid"))
    text_of = F.concat(F.lit(" "), F.col("segment"), F.lit(" "))
    inside = F.filter(F.transform("windows", lambda w, k: F.when(F.contains(text_of, F.concat(F.lit(" "), w, F.lit(" "))), k)), lambda k: k.isNotNull())
    held_in = both.select("segment", "windows", inside.alias("inside")).where(F.size("inside") > 0)

    members = blocks.select("windows", "item_id", "base", "n").distinct()
    hits = held_in.join(members, "windows").select("segment", "item_id", "base", "n", "inside")
    rows = segments.select("doc_id", "segment")
    pairs = salted_join(rows, hits, "segment", hot_keys(rows, "segment"), F.col("doc_id")).select("doc_id", "item_id", "n", F.explode("inside").alias("k"), "base").select("doc_id", "item_id", "n", (F.col("base") + F.col("k")).alias("place")).distinct()
    counted = pairs.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("n").alias("n"))
    return counted.select("doc_id", "item_id", "n_shared", F.least(F.lit(1.0), F.col("n_shared") / F.col("n")).alias("containment"))
