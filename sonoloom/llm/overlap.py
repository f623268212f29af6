"""Records of evaluation splits that also occur in train, exactly or almost (problem 3).

Every record is a set of normalised fields. A gear rolling hash runs over the characters of
a field and cuts where some of its bits are zero (the end of a field always cuts, so the
chunks of a field do not depend on its neighbours). Chunk digests are joined across splits:
chunks are ordered by how many fields hold them, and a pair of fields meets only on the
rarest chunks of both, as many as it takes so that no pair with the asked share of common
text is lost (all but the rarest are left out when the whole field is asked for). The
lengths of the chunks both fields hold are summed; a pair of fields counts when the sum
reaches ``least`` of the longer one, a pair of records when it has such a pair of fields,
and the sums over a record's fields give its overlap fraction.

A picture fingerprint with flipped bits has no run of characters that a rolling hash could
keep in step with, so fingerprints are cut at fixed bits instead and probed with every
change of a few bits. By the pigeonhole principle two fingerprints that differ in at most 12
of 128 bits agree on a probe of some block; candidates are checked on all 128 bits. Of three
ways to cut, all of them exact, the number of fingerprints picks the cheapest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.ids import patient_key, study_key
from sonoloom.functions.skew import hot_keys, salted_join
from sonoloom.llm.frames import frame
from sonoloom.llm.pairs import expand_members
from sonoloom.session import write_scratch

# Chunks have MIN_CHUNK + 2**CUT_BITS bytes on average, so that ids are cut as well as texts.
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 6, 3, 256
WHOLE = 1.0
MAX_FLIPPED = 12
_MASK64 = (1 << 64) - 1


def _gear() -> list[int]:
    """One 64-bit number per byte, from the hash of the byte."""
    return [xxhash.xxh64_intdigest(bytes([b])) for b in range(256)]


_GEAR = _gear()


def chunks(field: str) -> list[bytes]:
    """Content-defined chunks of one field."""
    data = field.encode("utf-8", "surrogatepass")
    out, start, h, cut = [], 0, 0, ((1 << CUT_BITS) - 1) << 3
    for i, b in enumerate(data):
        h = ((h << 1) + _GEAR[b]) & _MASK64
        size = i + 1 - start
        if size >= MIN_CHUNK and h & cut == 0 or size >= MAX_CHUNK:
            out.append(data[start : i + 1])
            start, h = i + 1, 0
    if start < len(data):
        out.append(data[start:])
    return out


def _chunk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, eval_side, fid, field in zip(pdf["kind"], pdf["eval_side"], pdf["fid"], pdf["field"]):
            seen: Counter = Counter()
            parts = []
            for c in chunks(field):
                # The second of two equal chunks is another one, so that sets stand for repeats too.
                parts.append({"d": xxhash.xxh3_64_intdigest(b"%b\n%d\n%b" % (kind.encode(), seen[c], c)) - (1 << 63), "l": len(c)})
                seen[c] += 1
            rows.append((kind, eval_side, fid, sum(p["l"] for p in parts), parts))
        yield frame(rows, ["kind", "eval_side", "fid", "length", "chunks"])


_CHUNKED = "kind string, eval_side boolean, fid string, length int, chunks array<struct<d:bigint,l:int>>"


def side(split) -> Column:
    """False for train, True for val and test, null for any other split."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", False).when(s.isin("val", "test"), True)


def record_fields(records: DataFrame) -> DataFrame:
    """One row per record and distinct field: kind, eval_side, id, field, fid (digest of the field). records: id, eval_side, kind, fields.

    Null fields and empty texts are no field; a field repeated within a record counts once.
    """
    rows = records.select("kind", "eval_side", "id", F.explode(F.array_distinct("fields")).alias("field")).where(F.length("field") > 0)
    return rows.withColumn("fid", F.md5(F.concat_ws("\n", "kind", "field")))


def chunked_fields(members: DataFrame) -> DataFrame:
    """Distinct fields of either side with their chunks (64-bit digest, length).

    Two chunks with one digest by chance can make a candidate or add to a sum below the
    whole; a field shared whole is compared by its own 128-bit digest.
    """
    return members.select("kind", "eval_side", "fid", "field").distinct().mapInPandas(_chunk_batches, _CHUNKED)


def field_overlaps(fields: DataFrame, least: float = WHOLE) -> DataFrame:
    """kind, fid_t, fid_e, shared, length_t, length_e: fields of train and evaluation whose common chunks cover ``least`` of the longer one.

    fields: result of :func:`chunked_fields`, read three times, so a written table. The
    chunks of a field before which at most 1 - ``least`` of it lies, rarest first, are met;
    two fields that share ``least`` of both have one of these in common.
    """
    parts = fields.select("kind", "eval_side", "fid", "length", F.explode("chunks").alias("c")).select("kind", "eval_side", "fid", "length", "c.d", "c.l")
    held_by = parts.groupBy("d").agg(F.count("*").alias("fields"), F.min("eval_side").alias("lo"), F.max("eval_side").alias("hi")).where("lo <> hi").select("d", "fields")
    known = salted_join(parts, held_by, "d", hot_keys(parts, "d"), F.col("fid"), "left")
    rarest = Window.partitionBy("kind", "eval_side", "fid").orderBy(F.coalesce("fields", F.lit(0)), "d")
    before = F.coalesce(F.sum("l").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A chunk on one side only meets nothing, but it takes up its part of the text.
    prefix = known.withColumn("before", before).where((F.col("before") <= (1 - F.lit(least)) * F.col("length")) & F.col("fields").isNotNull())
    met = write_scratch(prefix.select("kind", "eval_side", "fid", "d"), "rarest")
    train, held = met.where("not eval_side").select("d", "kind", F.col("fid").alias("fid_t")), met.where("eval_side").select("d", F.col("fid").alias("fid_e"))
    pairs = salted_join(train, held, "d", hot_keys(train, "d"), F.col("fid_t")).select("kind", "fid_t", "fid_e").distinct()
    whole = lambda eval_side, tag: fields.where(F.col("eval_side") == eval_side).select("kind", F.col("fid").alias(f"fid_{tag}"), F.col("length").alias(f"length_{tag}"), F.col("chunks").alias(f"chunks_{tag}"))
    both = pairs.join(whole(False, "t"), ["kind", "fid_t"]).join(whole(True, "e"), ["kind", "fid_e"])
    shared = F.aggregate(F.array_intersect("chunks_t", "chunks_e"), F.lit(0), lambda acc, c: acc + c["l"])
    out = both.select("kind", "fid_t", "fid_e", shared.alias("shared"), "length_t", "length_e").where(F.col("shared") >= F.lit(least) * F.greatest("length_t", "length_e"))
    # Chunks all shared, but in another order, are not the same field.
    return out.where("shared < length_t or shared < length_e or fid_t = fid_e")


def record_overlaps(members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """kind, id_t, id_e: one train and one evaluation record with an overlapping field; members of hot fields are spread over salts."""
    cls = F.concat_ws("\n", "kind", "fid").alias("cls")
    classes = overlaps.select(F.concat_ws("\n", "kind", "fid_t").alias("a"), F.concat_ws("\n", "kind", "fid_e").alias("b"))
    live = write_scratch(members.select(cls, "eval_side", "kind", "id").join(classes.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"), "live")
    got = expand_members(classes, live.where("not eval_side").select("cls", F.struct("kind", "id").alias("id")), live.where("eval_side").select("cls", "id"))
    return got.select("id_a.kind", F.col("id_a.id").alias("id_t"), F.col("id_b").alias("id_e")).distinct()


def overlap_fractions(members: DataFrame, fields: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Evaluation records: length, length of the chunks shared with fields of train, and their fraction."""
    best = overlaps.groupBy("kind", F.col("fid_e").alias("fid")).agg(F.max("shared").alias("shared"))
    sized = fields.where("eval_side").select("kind", "fid", "length").join(best, ["kind", "fid"], "left").withColumn("key", F.concat_ws("\n", "kind", "fid"))
    rows = members.where("eval_side").select(F.concat_ws("\n", "kind", "fid").alias("key"), F.col("id"))
    got = salted_join(rows, sized, "key", hot_keys(rows, "key"), F.col("id"))
    return got.groupBy("kind", "id").agg(F.sum("length").alias("length"), F.sum(F.coalesce("shared", F.lit(0))).alias("shared_length")).withColumn("overlap", F.col("shared_length") / F.col("length"))


class Overlap:
    """Fields, chunks and field overlaps of some records; each step is written once and read by all that follows."""

    def __init__(self, records: DataFrame, least: float = WHOLE):
        self.members = write_scratch(record_fields(records), "members")
        self.fields = write_scratch(chunked_fields(self.members), "chunks")
        self.overlaps = write_scratch(field_overlaps(self.fields, least), "overlaps")

    def pairs(self) -> DataFrame:
        """kind, id_a, id_b (id_a < id_b) of overlapping records."""
        got = record_overlaps(self.members, self.overlaps)
        return got.select("kind", F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b")).where("id_a < id_b").distinct()

    def fractions(self) -> DataFrame:
        return overlap_fractions(self.members, self.fields, self.overlaps)


# ---- fingerprints ---------------------------------------------------------------

# (bits, changes probed) of each block; the changes plus one of all blocks add up to more than MAX_FLIPPED.
_CUTS = (((19, 1),) * 6 + ((14, 0),), ((27, 2),) * 3 + ((24, 1), (23, 1)), ((36, 3), (31, 2), (31, 2), (30, 2)))


def masks(bits: int, changes: int) -> list[int]:
    """All numbers of up to ``changes`` one-bits."""
    return [sum(1 << b for b in on) for n in range(changes + 1) for on in combinations(range(bits), n)]


def block_cut(train: int, held: int) -> tuple[tuple[int, int], ...]:
    """The cut with the fewest probes and expected candidates for so many distinct fingerprints."""
    def cost(cut) -> float:
        probes = [(len(masks(bits, changes)), bits) for bits, changes in cut]
        return train * len(cut) + held * sum(n for n, _ in probes) + train * held * sum(n / 2.0**bits for n, bits in probes)

    return min(_CUTS, key=cost)


def _blocks(cut) -> list[tuple[int, int, int, Column]]:
    """(number, bits, changes, value) of each block; hi and lo hold 64 bits each."""
    out, at = [], 0
    for number, (bits, changes) in enumerate(cut):
        low, high = F.shiftrightunsigned("lo", at) if at < 64 else F.lit(0), F.shiftrightunsigned("hi", at - 64) if at >= 64 else F.shiftleft("hi", 64 - at) if at + bits > 64 else F.lit(0)
        out.append((number, bits, changes, low.bitwiseOR(high).bitwiseAND(F.lit((1 << bits) - 1))))
        at += bits
    return out


def _keys(cut, probe: bool) -> Column:
    """Keys of the blocks, with every change for the probing side."""
    arrays = []
    for number, bits, changes, value in _blocks(cut):
        key = value.bitwiseOR(F.lit(number << 48))
        flips = F.expr("array(" + ",".join(f"{m}L" for m in masks(bits, changes if probe else 0)) + ")")
        arrays.append(F.transform(flips, key.bitwiseXOR))
    return F.concat(*arrays)


def fingerprints(stills: DataFrame, row_id: str = "still_row") -> DataFrame:
    """id, eval_side, print (32 hex digits) and its two halves as longs; other texts are no fingerprint."""
    h = F.lower(F.trim("pixel_hash"))
    rows = stills.select(F.col(row_id).cast("long").alias("id"), side(F.col("split")).alias("eval_side"), h.alias("print")).where("eval_side is not null")
    return rows.where(F.col("print").rlike("^[0-9a-f]{32}$")).withColumn("hi", F.conv(F.substring("print", 1, 16), 16, -10).cast("long")).withColumn("lo", F.conv(F.substring("print", 17, 16), 16, -10).cast("long"))


def near_print_pairs(prints: DataFrame, most: int = MAX_FLIPPED, cut=None) -> DataFrame:
    """id_a < id_b: one train and one evaluation row whose fingerprints differ in at most ``most`` (up to 12) bits.

    Distinct fingerprints meet, not rows: copies of a still join its class afterwards.
    """
    if most > MAX_FLIPPED:
        raise ValueError(f"the blocks find pairs of up to {MAX_FLIPPED} flipped bits")
    kinds = write_scratch(prints.select("eval_side", "print", "hi", "lo").distinct(), "prints")
    if cut is None:
        n = {r.eval_side: r["count"] for r in kinds.groupBy("eval_side").count().collect()}
        cut = block_cut(n.get(False, 0), n.get(True, 0))
    train = kinds.where("not eval_side").select(F.explode(_keys(cut, False)).alias("block"), F.col("print").alias("a"), F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"))
    held = kinds.where("eval_side").select(F.explode(_keys(cut, True)).alias("block"), F.col("print").alias("b"), F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"))
    met = salted_join(train, held, "block", hot_keys(train, "block"), F.col("a"))
    flipped = F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b"))) + F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b")))
    classes = write_scratch(met.where(flipped <= most).select("a", "b").distinct(), "near")
    rows = write_scratch(prints.select(F.col("print").alias("cls"), "id", "eval_side").join(classes.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"), "near-rows")
    pairs = expand_members(classes, rows.where("not eval_side").select("cls", "id"), rows.where("eval_side").select("cls", "id"))
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b")


# ---- the project's tables ---------------------------------------------------------


def eval_set_records(eval_sets: DataFrame) -> DataFrame:
    """Two records per shard: its study ids and its patient ids, normalised."""
    ids = lambda c, key: F.array_compact(F.transform(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), key))
    rows = eval_sets.select(F.col("eval_id").cast("long").alias("id"), side(F.col("split")).alias("eval_side"), F.explode(F.array(
        F.struct(F.lit("study").alias("kind"), ids("study_ids", study_key).alias("fields")),
        F.struct(F.lit("patient").alias("kind"), ids("patient_ids", patient_key).alias("fields")),
    )).alias("r"))
    return rows.where("eval_side is not null").select("id", "eval_side", "r.kind", "r.fields")


def still_records(stills: DataFrame) -> DataFrame:
    """One record per still row: its normalised still id."""
    rows = stills.select(F.col("still_row").cast("long").alias("id"), side(F.col("split")).alias("eval_side"), F.lit("still").alias("kind"), F.array_compact(F.array(study_key(F.col("still_id")))).alias("fields"))
    return rows.where("eval_side is not null")


def still_pairs(stills: DataFrame) -> DataFrame:
    """kind ``still``, id_a, id_b: rows with the same still id, or fingerprints at most MAX_FLIPPED bits apart."""
    near = near_print_pairs(fingerprints(stills)).select(F.lit("still").alias("kind"), "id_a", "id_b")
    return Overlap(still_records(stills)).pairs().unionByName(near).distinct()


def cross_split_pairs(eval_sets: DataFrame, stills: DataFrame) -> DataFrame:
    """overlap_kind, key_a, key_b (key_a < key_b) of all overlaps between train and val or test.

    Unknown ids and missing fingerprints overlap with nothing; rows of other splits are
    ignored; repeated rows each count; other columns are ignored.
    """
    shared = Overlap(eval_set_records(eval_sets).unionByName(still_records(stills))).pairs()
    near = near_print_pairs(fingerprints(stills)).select(F.lit("still").alias("kind"), "id_a", "id_b")
    return shared.unionByName(near).distinct().select(F.col("kind").alias("overlap_kind"), F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))


def overlap_report(eval_sets: DataFrame, stills: DataFrame) -> DataFrame:
    """Evaluation records that overlap with train, per kind, split and source.

    kind ``study`` and ``patient`` count shards that name anyone, with the mean share of
    their text that train holds; ``still`` counts stills by id or fingerprint.
    """
    found = Overlap(eval_set_records(eval_sets).unionByName(still_records(stills)))
    sets = found.fractions().where("kind <> 'still'")
    a = sets.join(eval_sets.select(F.col("eval_id").alias("id"), F.lower(F.trim("split")).alias("split"), "source"), "id")
    a = a.groupBy("kind", "split", "source").agg(F.count("*").alias("n_records"), F.count_if(F.col("shared_length") > 0).alias("n_overlapping"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))
    near = near_print_pairs(fingerprints(stills)).select("id_a", "id_b")
    hit = found.pairs().where("kind = 'still'").select("id_a", "id_b").unionByName(near).select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("hit", F.lit(True))
    held = stills.select(F.col("still_row").alias("id"), F.lower(F.trim("split")).alias("held_split"), "source").where(F.col("held_split").isin("val", "test"))
    b = held.join(hit, "id", "left").groupBy(F.lit("still").alias("kind"), F.col("held_split").alias("split"), "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("mean_overlap"))
    return a.unionByName(b)
