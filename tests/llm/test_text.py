import json
import random
import unicodedata

from sonoloom.llm import chars, containment, lookalike, pii

DOC = "doc_id long, text string, form string, cls string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "zz", "zz") for i, t in enumerate(texts)], DOC)


def test_consistent_form(spark):
    same = ["office café 12", "oﬃce café 12", "ｏffi​ce　café 12", "оffiсе сafé 12"]
    other = ["office cafe 12", "Office café 12", "office café 1²", "office café\n12", "office  café 12", None, "", " "]
    got = {r.doc_id: r.form for r in lookalike.consistent_text(docs(spark, same + other)).collect()}
    assert {got[i] for i in range(4)} == {"office café 12"}
    assert len({got[i] for i in range(3, 9)}) == 6 and got[9] is None
    pairs = {(r.doc_id_a, r.doc_id_b) for r in lookalike.lookalike_pairs(docs(spark, same + same[:2] + other)).collect()}
    raw = same + same[:2]
    assert pairs == {(a, b) for a in range(6) for b in range(a + 1, 6) if raw[a] != raw[b]}
    assert lookalike.lookalike_pairs(docs(spark, [])).count() == 0
    classes = {r.doc_id: (r.n_docs, r.n_spellings) for r in lookalike.lookalike_classes(docs(spark, same + other)).collect()}
    assert classes[0] == (4, 4) and classes[4] == (1, 1)


def test_form_agrees_with_shape_on_random_texts():
    rng = random.Random(3)
    letters = "aeocpxABEK μβΔé́​­" + "".join(chars.PROTOTYPE)
    reader = lookalike.Reader({"^a": 5, "ab": 3})
    forms, shapes = {}, {}
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))
        f, s = reader.text(t), unicodedata.normalize("NFC", chars.skeleton(t))
        assert forms.setdefault(s, f) == f and shapes.setdefault(f, s) == s
        assert reader.text(f) == f


def test_real_greek_stays():
    reader = lookalike.Reader({})
    assert reader.text("Δ 12 β-blocker μm") == "Δ 12 β-blocker μm"


def test_leaks_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["café", "Δ", "x²"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 20, 60]))) for _ in range(30)]
    texts = [None, "", " "]
    for _ in range(120):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))]
        if rng.random() < 0.6:
            w = rng.choice(items).split(" ")
            k = rng.randrange(max(1, len(w) - 12))
            parts.insert(rng.randrange(2), ",\n".join(w[k : k + rng.randrange(10, 20)]).upper())
        texts.append(" ".join(parts))
    texts.append("lead " + " ".join(items[3:9]) * 400)
    item_df = spark.createDataFrame([(i, t) for i, t in enumerate(items + [None, items[0]])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in containment.leaked_items(docs(spark, texts), item_df).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = " " + " ".join(chars.words(t or "")) + " "
        for i, item in enumerate(items + ["", items[0]]):
            x = chars.words(item)
            if any(" " + " ".join(x[k : k + 13]) + " " in w for k in range(len(x) - 12)):
                want.add((d, i))
    assert got == want and got
    assert containment.leaked_items(docs(spark, []), item_df).count() == 0
    assert containment.leaked_items(docs(spark, texts), item_df.limit(0)).count() == 0


def test_size_classes_and_repeated_words(spark):
    classes = containment.size_classes(9)
    assert [c[:3] for c in classes] == [(1, 2, 1), (3, 4, 1), (5, 7, 2), (8, 9, 2)] and classes[-1][3] >= 3 and all(c[3] >= 1 for c in classes)
    items = ["tic " * 20, "tic tac " * 12, "one two three " * 8, " ".join(f"t{k}" for k in range(40))]
    texts = ["x " + "tic " * 13 + "y", "tic " * 12, "tac tic " * 7, "two three one " * 9, " ".join(f"t{k}" for k in range(7, 20)), " ".join(f"t{k}" for k in range(7, 19))]
    item_df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda **more: {(r.doc_id, r.item_id): (r.n_shared, round(r.containment, 3)) for r in containment.leaked_items(docs(spark, texts), item_df, **more).collect()}
    got = found()
    assert set(got) == {(0, 0), (2, 1), (3, 2), (4, 3)} and got[4, 3] == (1, round(1 / 28, 3))
    # A full bitmap only lets more band keys pass.
    assert found(bits=6) == got


def test_segments_of_another_run(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{k}" for k in range(20))) for i in range(12)], "item_id long, text string")
    texts = [" ".join(f"t{i}x{k}" for k in range(i, 20)) for i in range(12)]
    for run in (4, 10):
        got = {(r.doc_id, r.item_id) for r in containment.leaked_items(docs(spark, texts), items, run).collect()}
        assert got == {(i, i) for i in range(12) if 20 - i >= run}


CASES = [
    ("Rapport transmis à a.b+c@x.example.org.", [("email", "a.b+c@x.example.org")]),
    ("cc: ab_c[at]x[dot]example[dot]org; rappel 0639 98 15 15", [("email", "ab_c[at]x[dot]example[dot]org"), ("phone", "0639 98 15 15")]),
    ("write to jo dot ram at post dot test today", [("email", "jo dot ram at post dot test")]),
    ("(voir Zed Rampol, 514 555-0181 poste 28)", [("name", "Zed Rampol"), ("phone", "514 555-0181 poste 28")]),
    ("call (020 7946 0145), gain @ 33 dB.", [("phone", "020 7946 0145")]),
    ("Mr Zed Rampol, Flat 10, 49 Old Mill Road, Little Down, prefers", [("name", "Zed Rampol"), ("address", "Flat 10, 49 Old Mill Road, Little Down")]),
    ("Domicile : 51-4 bis, rue des Pommiers, app. 4, 99100 Valmont (QC) H0H 0B2. Lot 3", [("address", "51-4 bis, rue des Pommiers, app. 4, 99100 Valmont (QC) H0H 0B2")]),
    ("NAM QUEK 7408 2103. Sonde S/N 4156-412-7264. Accession 97227393 archivée.", [("id_number", "QUEK 7408 2103")]),
    ("Dossier 000-29-2975, tél. +33(0)1.99.00.14.82.", [("id_number", "000-29-2975"), ("phone", "+33(0)1.99.00.14.82")]),
    ("Relu par RAMPOL^ZED le matin. Méthode de Kelmar retenue. Salle 4, pavillon Brumeval.", [("name", "RAMPOL^ZED")]),
    ("- Z. Rampol Report sent to the unit", [("name", "Z. Rampol")]),
    ("Orvane sign absent. Score de Tristel 3/10. Frames 12 to 15.", []),
    ("", []),
]


def test_spans():
    for text, want in CASES:
        assert pii.scan_text(text)[1] == want, text


def test_validators():
    assert pii.luhn("046454286") and not pii.luhn("046454287")
    assert pii.mod97("255081416802538") and not pii.mod97("255081416802539")
    assert pii.health_date("74082103") and not pii.health_date("74132103")


def test_checks_confirm_and_reject():
    assert pii.scan_text("noted 130 692 544 on file")[1] == [("id_number", "130 692 544")]
    assert pii.scan_text("noted 130 692 545 on file")[1] == []
    assert pii.scan_text("SIN: 130 692 545 on file")[1] == [("id_number", "130 692 545")]
    assert pii.scan_text("vu 2 55 08 14 168 025 38 ce jour")[1] and not pii.scan_text("vu 2 55 08 14 168 025 39 ce jour")[1]


def test_many_spans_in_one_text():
    text = "cc: a@b.org, tel. 514 555-0181; " * 3000
    spans = pii.find_spans(text)
    assert len(spans) == 6000 and all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_json_only_changes_pieces():
    source = '{"EF (%)": null, "x\\u00e9": "M. Zed Rampol habite 3 rue des Bois, Valmont \\ud83d\\ude00 \\"tel\\" a@b.org\\n",  "n": 1.50, "a@b.org": "ok"}'
    out, pieces = pii.scan_json(source)
    assert out == '{"EF (%)": null, "x\\u00e9": "M. [name] habite [address] \\ud83d\\ude00 \\"tel\\" [email]\\n",  "n": 1.50, "a@b.org": "ok"}'
    assert json.loads(out)["n"] == 1.5 and [k for k, _ in pieces] == ["name", "address", "email"]
    assert pii.scan_json("not json a@b.org")[0] == "not json [email]"


def test_redaction_rows(spark):
    long = "Frame rate 12 Hz. " * 5000 + "cc: a@b.org"
    rows = [(1, "Mme Zed Rampol vue", None, "k"), (1, "Mme Zed Rampol vue", None, "k"), (2, None, "{}", "k"), (3, long, '{"a": "b@c.org"}', "k")]
    df = spark.createDataFrame(rows, "review_id long, source_text string, report_context string, redacted string")
    out = pii.redact_columns(df, ["source_text"], ["report_context"]).orderBy("review_id").collect()
    assert [r.source_text for r in out[:3]] == ["Mme [name] vue", "Mme [name] vue", None] and out[3].source_text.endswith("cc: [email]")
    assert {tuple(r) for r in pii.found_pieces(df).collect()} == {(1, "source_text", "name", "Zed Rampol"), (3, "source_text", "email", "a@b.org"), (3, "report_context", "email", "b@c.org")}
    assert pii.found_pieces(df.limit(0)).count() == 0


def test_scores_decide_letters_that_only_resemble():
    reader = lookalike.Reader({"^p": 9, "pa": 9, "at": 9, "ti": 9, "ie": 9, "en": 9, "nt": 9, "t$": 9, "^κ": 5, "κα": 5, "αρ": 5, "ρδ": 5, "δι": 5, "ια": 5, "α$": 5})
    assert reader.text("pαtient") == reader.text("pаtiеnt") == "patient" and reader.text("patιent") == "patient"
    assert reader.text("καρδια") == "καρδια" and reader.text("α") == "α" and reader.text("pα") == reader.text(reader.text("pα"))


def test_pair_counts(spark):
    got = lookalike.script_model(docs(spark, ["ab ab", "кот", "中文字", "aб", None, "é ab", "оса ﬁn-z\u00adz 1x", ""]))
    assert got["ab"] == 3 and got["^к"] == 1 and got["^e"] == 1 and got["fi"] == 1 and got["zz"] == 1 and got["^x"] == 1
    assert not any(c in k for k in got for c in "中文бса")
    rng = random.Random(30)
    texts = ["".join(rng.choice("aeo bкт̆цβ ,é1ﬀ\u200b") for _ in range(rng.randrange(40))) for _ in range(300)]
    want = {}
    for t in texts:
        for w in lookalike._TOKEN.findall(chars.prepare(t)):
            letters = [c for c in w if not unicodedata.combining(c)]
            scripts = {lookalike.script_of(c) for c in letters}
            if len(scripts) == 1 and (scripts == {"LATIN"} or not all(c in lookalike._AMBIGUOUS for c in letters)):
                for x, y in zip(["^", *letters], [*letters, "$"]):
                    want[x + y] = want.get(x + y, 0) + 1
    counts = lookalike.PairCounts()
    for k in range(0, 300, 7):
        counts.add(texts[k : k + 7])
    assert dict(counts.total) == want
