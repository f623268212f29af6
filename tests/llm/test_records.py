import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoloom.llm import grouped_split, mapping, overlap, packing, pairs


def osa(a, b):
    """Brute-force edit distance with transposition."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_brute_force():
    rng = random.Random(2)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    names = {word(3, 20) for _ in range(80)}
    trie = mapping.Trie([(n, n) for n in names])
    for k in (1, 2, 3):
        for _ in range(60):
            q = word(3, 20)
            limit = lambda n: min(k, mapping.allowed_distance(min(len(q), len(n))))  # noqa: B023, E731
            assert trie.search(q, k) == {n: d for n in names if (d := osa(n, q)) <= limit(n)}, (q, k)


NAMES = [("lv_clot", "lv_clot"), ("lv_clot", "left ventricle thrombus"), ("lv_clot", "caillot - ventricule gauche"), ("rv_clot", "rv_clot"), ("rv_clot", "right ventricle thrombus"), ("lv_width", "left ventricle cavity width")]


def test_mapping(spark):
    typed = {
        "LV-Clot ?": "lv_clot", "thrombus, left ventrcle": "lv_clot", "Caillot - Ventric. Gauche [v2]": "lv_clot", "echo: LeftVentricleThrombus": "lv_clot",
        "rihgt ventricle trombus, rest": "rv_clot", "liver cavity width": "unmatched", "tbd": "unmatched", "???": "unmatched", "xv_clot": "unmatched",
        "caillotventricu.": "lv_clot", "LeftVentricleCav. ?": "lv_width", "left.": "unmatched",
    }
    rows = [(i, v, ["lv clot", "", None, "nothing"] if i == 0 else None, "zz") for i, v in enumerate([*typed, None, "", "tbd"])]
    df = spark.createDataFrame(rows, "mapping_id long, label string, concepts array<string>, concept_id string")
    onto = spark.createDataFrame([(e, n, None, []) for e, n in NAMES], "concept_id string, label_en string, label_fr string, aliases array<string>")
    got = {(r.mapping_id, r.field, r.item_no): r.concept_id for r in mapping.mapped_labels(df, onto).collect()}
    want = {(i, "label", 0): c for i, c in enumerate(typed.values())} | {(0, "concepts", 1): "lv_clot", (0, "concepts", 4): "unmatched", (14, "label", 0): "unmatched"}
    assert got == want
    assert mapping.mapped_labels(df.limit(0), onto).count() == 0
    report = {r.value: r.n_rows for r in mapping.unmatched_report(mapping.mapped_labels(df, onto)).collect()}
    assert report["tbd"] == 2


def test_all_candidates(spark):
    values = spark.createDataFrame([("zeft thing",), ("zeft thing",), (None,), ("left thing",), ("none at all",)], "value string")
    got = {tuple(r) for r in mapping.value_candidates(values, [("a", "left thing"), ("b", "heft thing")]).collect()}
    assert got == {("zeft thing", "a", 1), ("zeft thing", "b", 1), ("left thing", "a", 0), ("left thing", "b", 1)}


def test_ties_have_no_match():
    m = mapping.Mapper([("a", "left thing"), ("b", "heft thing")])
    assert m.best("zeft thing") == ("unmatched", -1) and m.candidates("zeft thing") == {"a": 1, "b": 1}


def test_hamming_pairs_brute_force(spark):
    rng = random.Random(4)
    rows, prints = [], []
    for i in range(150):
        if prints and rng.random() < 0.6:
            p = rng.choice(prints)
            for b in rng.sample(range(128), rng.choice([0, 1, 6, 11, 12, 13, 14])):
                p ^= 1 << b
        else:
            p = rng.getrandbits(128)
        prints.append(p)
        rows.append((i, f"{p:032x}" if i % 9 else f"{p:032X} ", rng.choice(["train", "val", "Test", "other"]), f"s{i}", "zz"))
    rows += [(900, None, "val", "s1", "zz"), (901, "xyz", "train", None, "zz"), (902, None, "train", "  ", "zz")]
    df = spark.createDataFrame(rows, "still_row long, pixel_hash string, split string, still_id string, block string")
    got = {(r.id_a, r.id_b) for r in overlap.still_pairs(df).collect()}
    side = {r[0]: r[2].lower() for r in rows}
    cross = lambda a, b: (side[a] == "train") != (side[b] == "train") and "other" not in (side[a], side[b])
    want = {(a, b) for a, b in itertools.combinations(range(150), 2) if cross(a, b) and bin(prints[a] ^ prints[b]).count("1") <= 12}
    want |= {(1, 900)} if side[1] == "train" else set()
    assert got == want and len(want) > 5


def test_eval_set_pairs_and_fractions(spark):
    rows = [
        (1, "train", "a", [" 'S1'", "s2"], ["01", None]), (2, "val", "a", ["s1 ", "s9"], ["7", "N/A"]), (3, "test", "b", ["s8", "s8"], ["1.0", "2"]),
        (4, "train", "b", None, []), (5, "val", "b", [], None), (6, "train", "a", ["x" * 500], ["N/A"]), (7, "test", "a", ["x" * 500, "0"], ["unknown", "0"]),
    ]
    df = spark.createDataFrame(rows, "eval_id long, split string, source string, study_ids array<string>, patient_ids array<string>")
    stills = spark.createDataFrame([], "still_row long, still_id string, split string, source string, pixel_hash string")
    got = {tuple(r) for r in overlap.cross_split_pairs(df, stills).collect()}
    assert got == {("study", 1, 2), ("patient", 1, 3), ("study", 6, 7)}
    part = {(r.kind, r.id): round(r.overlap, 3) for r in overlap.Overlap(overlap.eval_set_records(df)).fractions().collect()}
    assert part["study", 2] == 0.5 and part["patient", 3] == 0.5 and part["study", 7] == 1.0 and part["study", 3] == 0.0
    assert overlap.overlap_report(df, stills).count() > 0


def test_chunks_realign_after_an_insertion():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij") for _ in range(6000))
    a, b = overlap.chunks(text), overlap.chunks("zz" + text)
    assert b"".join(a).decode() == text and b"".join(b).decode() == "zz" + text
    assert len(set(a) & set(b)) > 0.8 * len(set(a)) > 10
    assert overlap.chunks("") == [] and overlap.chunks("abc") == [b"abc"] and len(overlap.chunks("9.77.11.20210425.100342741")) > 1


def test_near_same_fields_brute_force(spark):
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefgh 0123") for _ in range(rng.choice([12, 40, 300]))) for _ in range(25)]
    texts = []
    for i in range(120):
        t = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "z", "qq"]) + t[k + 1 :]
        texts.append((i, rng.random() < 0.5, "text", [t, None, ""]))
    df = spark.createDataFrame(texts, "id long, eval_side boolean, kind string, fields array<string>")

    def share(a, b):
        x, y = Counter(overlap.chunks(a)), Counter(overlap.chunks(b))
        return sum(len(c) * n for c, n in (x & y).items()) / max(len(a), len(b))

    for least in (1.0, 0.8, 0.5):
        got = {(r.id_a, r.id_b) for r in overlap.Overlap(df, least).pairs().collect()}
        want = {(a[0], b[0]) for a, b in itertools.combinations(texts, 2) if a[1] != b[1] and (a[3][0] == b[3][0] or 1 > share(a[3][0], b[3][0]) >= least)}
        assert got == want and want, least


def test_every_cut_of_fingerprints_is_exact(spark):
    rng = random.Random(15)
    assert [sum(b for b, _ in cut) for cut in overlap._CUTS] == [128] * 3 and all(sum(c + 1 for _, c in cut) > overlap.MAX_FLIPPED for cut in overlap._CUTS)
    assert [overlap._CUTS.index(overlap.block_cut(10**k, 10**k)) for k in (4, 6, 8, 10)] == [0, 0, 1, 2]
    rows = []
    for i in range(12):
        p = rng.getrandbits(128)
        rows.append((2 * i, f"{p:032x}", "train"))
        for b in rng.sample(range(128), 12 + i % 2):
            p ^= 1 << b
        rows.append((2 * i + 1, f"{p:032x}", "val"))
    df = overlap.fingerprints(spark.createDataFrame(rows, "still_row long, pixel_hash string, split string"))
    for cut in overlap._CUTS:
        keys = [set(r.k) for r in df.where("not eval_side").select(overlap._keys(cut, False).alias("k")).collect()]
        assert all(len(k) == len(cut) for k in keys) and sum(len(a & b) for a, b in itertools.combinations(keys, 2)) <= 1
        assert {tuple(r) for r in overlap.near_print_pairs(df, cut=cut).collect()} == {(2 * i, 2 * i + 1) for i in range(0, 12, 2)}


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_brute_force(spark):
    rng = random.Random(8)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100, 160)] + [(f"n{rng.randrange(90):03}", f"n{rng.randrange(90):03}") for _ in range(60)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, "n001"), ("n002", None)], "a string, b string")
    got = {r.node: r.root for r in grouped_split.components(df).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])
    assert grouped_split.components(df.limit(0)).count() == 0


MANIFEST = "row_id long, patient_id string, study_id string, component string"


def test_split_shares_and_ties(spark):
    rng = random.Random(9)
    rows = [(i, "900" if rng.random() < 0.3 else f"{rng.randrange(400)}" if rng.random() < 0.95 else None, f"s{rng.randrange(900)}" if rng.random() < 0.2 else None, "zz") for i in range(3000)]
    df = spark.createDataFrame(rows, MANIFEST)
    out, table = grouped_split.split_rows(df)
    got = {r.row_id: (r.component, r.split) for r in out.collect()}
    assert len(got) == 3000
    edges = [(f"p{int(p)}" if p and int(p) else f"r{i}", f"s{s}" if s else f"r{i}") for i, p, s, _ in rows]
    comp = brute_components(edges)
    groups = {}
    for (i, *_), (a, _b) in zip(rows, edges):
        groups.setdefault(comp[a], set()).add(got[i])
    assert all(len(g) == 1 for g in groups.values()) and len({g for s in groups.values() for g in s}) == len(groups)
    for name, share in grouped_split.SHARES.items():
        assert abs(sum(s == name for _, s in got.values()) / 3000 - share) < 0.25 if name == "train" else True
    tied = {(r.patient_a, r.patient_b) for r in grouped_split.tied_patients(grouped_split.normalised_rows(df)).collect()}
    people = {}
    for p in {r[1] for r in rows if r[1] and int(r[1])}:
        people.setdefault(comp[f"p{int(p)}"], []).append(str(int(p)))
    assert tied == {(min(a, b), max(a, b)) for g in people.values() for a, b in itertools.combinations(g, 2)}


def test_shares_are_exact_with_small_components(spark):
    df = spark.createDataFrame([(i, str(i + 1), None, "zz") for i in range(1000)], MANIFEST)
    n = {r.split: r["count"] for r in grouped_split.split_rows(df)[0].groupBy("split").count().collect()}
    assert n == {"train": 700, "val": 100, "test": 200}
    assert grouped_split.split_rows(df.limit(0))[0].count() == 0


def test_later_batch_keeps_splits_and_quarantines(spark):
    first = spark.createDataFrame([(i, str(i + 1), f"s{i}", "zz") for i in range(40)], MANIFEST)
    out, table = grouped_split.split_rows(first)
    table = spark.createDataFrame(table.collect(), table.schema)
    old = {r.patient: r.split for r in table.collect()}
    train = [p for p, s in old.items() if s == "train"]
    test = [p for p, s in old.items() if s == "test"]
    rows = [(100, train[0], "x1"), (101, train[1], "x1"), (102, train[2], "x2"), (103, test[0], "x2"), (104, "777", "x3"), (105, train[3], "x3"), (106, "888", None)]
    second = spark.createDataFrame([(*r, "zz") for r in rows], MANIFEST)
    out2, table2 = grouped_split.split_rows(second, table)
    got = {r.row_id: r.split for r in out2.collect()}
    assert got[100] == got[101] == got[104] == got[105] == "train"
    assert got[102] == got[103] == "quarantine" and got[106] in ("train", "val", "test")
    now = {r.patient: (r.component, r.split) for r in table2.collect()}
    assert now[train[2]][1] == now[test[0]][1] == "quarantine" and now["777"][1] == "train"
    assert all(now[p][1] == s for p, s in old.items() if p not in (train[2], test[0])) and len(now) == 42


def test_table_versions(spark, tmp_path):
    one = spark.createDataFrame([(i, str(i + 1), None, "zz") for i in range(20)], MANIFEST)
    two = spark.createDataFrame([(50, "1", "s1", "zz"), (51, "99", "s1", "zz")], MANIFEST)
    path = str(tmp_path / "components")
    first = {r.row_id: r.split for r in grouped_split.update_split_table(one, path).collect()}
    second = {r.row_id: r.split for r in grouped_split.update_split_table(two, path).collect()}
    assert second == {50: first[0], 51: first[0]}
    assert spark.read.parquet(f"{path}/v=2").count() == 21 and spark.read.parquet(f"{path}/v=1").count() == 20


def test_later_batch_ties_through_known_studies(spark, tmp_path):
    path = str(tmp_path / "components")

    def batch(*rows):
        df = spark.createDataFrame([(*r, "zz") for r in rows], MANIFEST)
        return {r.row_id: (r.component, r.split) for r in grouped_split.update_split_table(df, path).collect()}

    first = batch(*((i, str(100 + i), f"s{i}") for i in range(40)), *((50 + i, None, f"o{i}") for i in range(20)))
    other = next(i for i in range(40) if first[i][1] != first[0][1])
    calm = next(i for i in range(40) if i not in (0, other))
    alone = next(i for i in range(20) if first[50 + i][1] != first[0][1])
    reused = [(200 + i, str(900 + i), f"s{i}") for i in range(40)] + [(300 + i, None, f"s{i}") for i in range(40)]
    second = batch(*reused, *((400 + i, None, f"o{i}") for i in range(20)))
    assert all(second[200 + i] == second[300 + i] == first[i] for i in range(40))
    assert all(second[400 + i] == first[50 + i] for i in range(20))
    third = batch((500, "777", f"o{alone}"), (501, "778", "s0"), (502, "778", f"s{other}"), (503, None, f"s{other}"), (504, "779", f"s{calm}"))
    assert third[500][1] == first[50 + alone][1] and third[500][0] == "p:777"
    assert {third[k][1] for k in (501, 502, 503)} == {"quarantine"} and third[504] == first[calm]
    fourth = batch((600, None, f"o{alone}"), (601, None, "s0"))
    assert fourth == {600: third[500], 601: third[501]}
    # Quarantine ends where someone decides it, in the patient table.
    table, studies = spark.read.parquet(f"{path}/v=4"), spark.read.parquet(f"{path}/studies/v=4")
    decided = table.withColumn("split", F.when(F.col("split") == "quarantine", "train").otherwise(F.col("split")))
    again = spark.createDataFrame([(700, None, "s0", "zz")], MANIFEST)
    assert [r.split for r in grouped_split.split_batch(again, decided, studies)[0].collect()] == ["train"]


def test_later_batch_fills_the_shares_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "components")
    grouped_split.update_split_table(spark.createDataFrame([(i, "1", None, "zz") for i in range(100)] + [(100 + i, None, None, "zz") for i in range(100)], MANIFEST), path)
    split = grouped_split.update_split_table(spark.createDataFrame([(1000 + i, str(i + 2), None, "zz") for i in range(800)], MANIFEST), path)
    held = {}
    for t in (spark.read.parquet(f"{path}/v=2"), spark.read.parquet(f"{path}/studies/v=2")):
        for r in t.groupBy("split").agg(F.sum("n").alias("n")).collect():
            held[r.split] = held.get(r.split, 0) + r.n
    assert held == {"train": 700, "val": 100, "test": 200} and split.count() == 800


def test_pairs_across_classes(spark):
    rows = [("g", "a", 1), ("g", "a", 2), ("g", "b", 3), ("g", "b", 3), ("h", "c", 4), ("h", "c", 5)]
    df = spark.createDataFrame(rows, "grp string, cls string, id long")
    assert {tuple(r) for r in pairs.pairs_across_classes(df, "grp", "cls", "id", "t").collect()} == {(1, 3), (2, 3)}


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="needs the public tokenizer files")
def test_packing(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["valve", "atrium", "jet", "wall"]) for _ in range(rng.choice([3, 20, 60, 900]))) for _ in range(150)]
    rows = [(i, t, "zz", 1) for i, t in enumerate([None, "", *texts, texts[0], "same"] + ["same"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string, place int")
    out = packing.pack_documents(df, 256).collect()
    enc = packing.encoder(packing.TOKENIZER)
    size = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, *_ in rows}
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            by_bin.setdefault(r.container, []).append(r)
    assert set(by_doc) == set(size) and all(by_doc[i][0].container is None for i in (0, 1))
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece_no)
        at = 0
        for r in pieces:
            assert r.piece_start == at
            at += r.piece_length
        assert at == size[i] and (size[i] > 256 or len(pieces) == 1)
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: r.place)
        assert sum(r.piece_length for r in pieces) <= 256
        assert [r.place for r in pieces] == list(range(1, len(pieces) + 1))
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.piece_length for r in pieces]])[:-1])
    assert len(by_bin) <= -(-sum(size.values()) // 256) + 2
    assert packing.pack_documents(df.limit(0), 256).count() == 0
    assert packing.utilisation(packing.pack_documents(df, 256), 256).first().used_share > 0.97


def test_hilbert_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert_key(grid, 3)
    order = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_best_fit_never_overfills():
    sizes = np.array([5, 5, 5, 3, 2, 7, 1, 9, 10])
    bins = packing.pack_sizes(sizes, 10, window=4)
    assert max(np.bincount(bins, weights=sizes)) <= 10



def test_ranges_follow_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 50)
    rows = [(i, 7 << 20 if i % 3 == 0 else (i * 2654435761) % (1 << 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, curve long")
    got = {r.doc_id: (r.part, r.start) for r in packing.curve_ranges(df.repartition(1), ["doc_id"]).collect()}
    assert got == {r.doc_id: (r.part, r.start) for r in packing.curve_ranges(df.repartition(9), ["doc_id"]).collect()}
    sizes = Counter(p for p, _ in got.values())
    assert max(sizes.values()) <= 100 and len(sizes) >= 8
    order = sorted((s, c) for (i, c) in rows for s in [got[i][1]] if i % 3)
    assert [c >> 15 for _, c in order] == sorted(c >> 15 for _, c in order)


def test_three_batches_leave_no_study_or_patient_in_two_splits(spark, tmp_path):
    rng = random.Random(31)
    rows = [(i, f"{rng.randrange(1, 60)}" if rng.random() < 0.8 else None, f"s{rng.randrange(90)}" if rng.random() < 0.7 else None, i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, patient_id string, study_id string, n int")
    out = grouped_split.incremental_splits(df, F.col("n"), 3, str(tmp_path / "components")).collect()
    split = {r.row_id: r.split for r in out}
    assert sorted(split) == list(range(240)) and len(out) == 240
    for k in (1, 2):
        per = {}
        for r in rows:
            if r[k]:
                per.setdefault(r[k], set()).add(split[r[0]])
        assert all(len(s) == 1 for s in per.values())
    sizes = {r.component: (r.n_patients, r.n_links) for r in grouped_split.component_sizes(grouped_split.normalised_rows(df)).collect()}
    pairs = {(r[1], r[2]) for r in rows if r[1] and r[2]}
    comp = brute_components([(f"p{p}", f"s{s}") for p, s in pairs])
    want = {}
    for p, s in pairs:
        g = want.setdefault(comp[f"p{p}"], (set(), set()))
        g[0].add(p)
        g[1].add((p, s))
    assert sorted(sizes.values()) == sorted((len(a), len(b)) for a, b in want.values() if len(a) > 1)
