"""Documents packed into containers of a fixed number of tokens (problem 6).

Each document becomes a point: a hashed vector of its tokens projected to three
dimensions. The points are range-sorted by their Hilbert key, so that neighbours along
the curve have similar words, and every range is packed on its own: windows of WINDOW
neighbours in best-fit decreasing order into the containers still open. What a range leaves
part-filled is packed once more, container by container. The ranges follow from the rows
alone, so the same documents go into the same containers on any cluster.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.skew import spread
from sonoloom.session import write_scratch

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level BPE vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
DIMENSIONS, BITS = 3, 10
WINDOW = 1024
OPEN_BINS = 256
RANGE_ROWS = 25_000
BUCKET_BITS = 15
LOOSE = 0.02


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes):
    """Byte-level BPE from the text of a file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str):
    """Byte-level BPE from a file of ranks."""
    return encoder_of(read_vocabulary(path))


@lru_cache(maxsize=2)
def projection(n: int) -> np.ndarray:
    """One vector of +-1 per token number, from a hash of the number."""
    x = np.arange(n, dtype=np.uint64) + np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.stack([((x >> np.uint64(k)) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(DIMENSIONS)], axis=1)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with coordinates 0 .. 2**bits - 1 (a row each)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _sizes(held):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder_of(held.value)
        vectors = projection(enc.n_vocab)
        for pdf in batches:
            lengths, points = [], np.zeros((len(pdf), DIMENSIONS))
            for k, text in enumerate(pdf["text"]):
                ids = enc.encode_ordinary(text) if text else []
                lengths.append(len(ids))
                if ids:
                    points[k] = vectors[ids].sum(axis=0) / np.sqrt(len(ids))
            # The logistic curve spreads sums of unbounded size over a fixed grid.
            grid = np.minimum((1 / (1 + np.exp(-points / 3)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": pdf["id"], "n_tokens": lengths, "curve": hilbert_key(grid)})

    return rows


def document_sizes(docs: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, curve (Hilbert key) of every document; null and empty texts have 0 tokens.

    The vocabulary is read on the driver and sent along (its size is that of the file), so
    executors need no copy of it.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), "id")
    return rows.mapInPandas(_sizes(held), "doc_id long, n_tokens long, curve long")


class Bins:
    """Open containers, found by room left; closed ones are handed out."""

    def __init__(self, capacity: int):
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0
        self.capacity, self.count = capacity, 0

    def put(self, size: int) -> tuple[int, bool]:
        """Number of the open container with the least room for ``size``, or of a new one."""
        fits = self.some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            number = self.room[r].pop()
            if not self.room[r]:
                self.some &= ~(1 << r)
        else:
            r, number = self.capacity, self.count
            self.count += 1
        if r > size:
            self.room[r - size].append(number)
            self.some |= 1 << (r - size)
        return number

    def close_fullest(self, keep: int) -> None:
        """Only ``keep`` containers, those with most room, stay open."""
        left = keep
        for r in range(self.capacity, 0, -1):
            if self.room[r]:
                self.room[r] = self.room[r][:left]
                left -= len(self.room[r])
                if not self.room[r]:
                    self.some &= ~(1 << r)


def pack_sizes(sizes: np.ndarray, capacity: int, window: int = WINDOW, keep: int = OPEN_BINS) -> np.ndarray:
    """Container number of each item: best fit, the largest of a window first, in the order of the windows."""
    bins, out = Bins(capacity), np.empty(len(sizes), dtype=np.int64)
    for at in range(0, len(sizes), window):
        part = sizes[at : at + window]
        for k in np.argsort(-part, kind="stable"):
            out[at + k] = bins.put(int(part[k]))
        bins.close_fullest(keep)
    return out


def _pack(capacity: int, size: str, prefix: str, order: list[str], columns: list[str]):
    def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        numbers = pack_sizes(pdf[size].to_numpy(), capacity)
        return pdf.assign(container=[f"{prefix}{key[0]}-{n}" for n in numbers], rank=pdf["start"] + np.arange(len(pdf)))[columns]

    return rows


def curve_ranges(rows: DataFrame, tie: list[str]) -> DataFrame:
    """``rows`` with part (number of its range along ``curve``) and start (rows before that range).

    The ranges follow from the rows alone, not from the cluster: the curve is cut into
    2**BUCKET_BITS equal sections, whose counts go to the driver (that many at most);
    neighbouring sections make up a range until it has RANGE_ROWS rows, and a section with
    more is spread over as many ranges as it takes by a hash of ``tie``, so that a third of
    equal texts does not fill one range.
    """
    spark = rows.sparkSession
    section = F.shiftright("curve", DIMENSIONS * BITS - BUCKET_BITS).cast("int")
    counts = sorted((r.section, r["count"]) for r in rows.groupBy(section.alias("section")).count().collect())
    placed, part, held, start, done = [], 0, 0, 0, 0
    for s, n in counts:
        if held and (held >= RANGE_ROWS or n > RANGE_ROWS):
            part, held, start = part + 1, 0, done
        spread_over = -(-n // RANGE_ROWS)
        placed.append((s, part, spread_over, start))
        done += n
        held += n
        if spread_over > 1:
            part, held, start = part + spread_over, 0, done
    known = spark.createDataFrame(placed, "section int, first int, width int, start long")
    # At most 2**BUCKET_BITS rows.
    numbered = rows.withColumn("section", section).join(F.broadcast(known), "section")
    return numbered.withColumn("part", (F.col("first") + F.pmod(F.xxhash64(*tie), F.col("width"))).cast("int")).drop("section", "first", "width")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", with_rank: bool = False) -> DataFrame:
    """doc_id, piece_no, piece_start, piece_length, container, place, offset.

    A document of up to ``capacity`` tokens is one piece; a longer one is cut into full
    pieces, each a container of its own, and a rest that is packed like a document. place
    counts the pieces of a container from 1, offset the tokens before the piece. A null or
    empty text has one row with no container. Repeated ids get a place each. ``with_rank``
    adds the place along the curve (null for pieces that fill a container). Only ids and sizes are shuffled, never texts.
    """
    sizes = write_scratch(document_sizes(docs, tokenizer, doc_id, text), "sizes")
    cap = F.lit(capacity)
    full = F.floor(F.col("n_tokens") / cap).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    whole = sizes.where(F.col("n_tokens") > cap).select("doc_id", "curve", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece_no"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "piece_no").orderBy("curve")).cast("string")
    whole = whole.select(
        "doc_id", "piece_no", (F.col("piece_no") * cap).alias("piece_start"), F.lit(capacity).cast("long").alias("piece_length"),
        F.concat_ws("-", F.lit("d"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string"), copy).alias("container"),
        F.lit(1).cast("long").alias("place"), F.lit(0).cast("long").alias("offset"), none("long").alias("rank"),
    )
    cut = F.col("n_tokens") > cap
    rest = sizes.select(
        "doc_id", F.when(cut, full).otherwise(F.lit(0)).alias("piece_no"), F.when(cut, full * cap).otherwise(F.lit(0)).alias("piece_start"),
        F.when(cut, F.col("n_tokens") % cap).otherwise(F.col("n_tokens")).alias("piece_length"), "curve", "n_tokens",
    )
    empty = rest.where("n_tokens = 0").select("doc_id", "piece_no", "piece_start", "piece_length", none("string").alias("container"), none("long").alias("place"), none("long").alias("offset"), none("long").alias("rank"))
    items = curve_ranges(rest.where("piece_length > 0").drop("n_tokens"), ["doc_id", "piece_no"])
    pieces = ["doc_id", "piece_no", "piece_start", "piece_length", "curve", "rank", "container"]
    packed = write_scratch(items.groupBy("part").applyInPandas(
        _pack(capacity, "piece_length", "c", ["curve", "doc_id", "piece_no", "piece_length"], pieces), "doc_id long, piece_no long, piece_start long, piece_length long, curve long, rank long, container string"
    ), "packed")
    # What is part-filled is packed once more among its neighbours along the curve, container by container.
    fill = packed.groupBy(F.col("container").alias("was")).agg(F.sum("piece_length").alias("fill"), F.min("curve").alias("curve"))
    loose = write_scratch(fill.where(F.col("fill") < int(capacity * (1 - LOOSE))), "loose")
    merged = curve_ranges(loose, ["was"]).groupBy("part").applyInPandas(_pack(capacity, "fill", "m", ["curve", "was"], ["was", "container"]), "was string, container string")
    final = packed.withColumnRenamed("container", "was").join(merged, "was", "left").withColumn("container", F.coalesce("container", "was"))
    order = "row_number() over (partition by container order by rank, doc_id, piece_no)"
    before = "coalesce(sum(piece_length) over (partition by container order by rank, doc_id, piece_no rows between unbounded preceding and 1 preceding), 0)"
    placed = final.select("doc_id", "piece_no", "piece_start", "piece_length", "container", F.expr(order).cast("long").alias("place"), F.expr(before).alias("offset"), "rank")
    out = placed.unionByName(whole).unionByName(empty)
    return out if with_rank else out.drop("rank")


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, and the share of the space that holds tokens; with a column rank also the mean stretch of the curve a shared container spans."""
    shared = [F.when(F.count("rank") > 1, F.max("rank") - F.min("rank")).alias("span")] if "rank" in packed.columns else []
    used = packed.where("container is not null").groupBy("container").agg(F.sum("piece_length").alias("fill"), F.count("*").alias("n"), *shared)
    totals = used.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("fill").alias("n_tokens"), F.max("fill").alias("fullest"), *[F.round(F.avg("span"), 1).alias("mean_span") for _ in shared])
    return totals.withColumn("used_share", F.round(F.col("n_tokens") / (F.col("n_containers") * F.lit(capacity)), 6))
