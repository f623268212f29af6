"""Queries that do the whole job where an older one of the same kind keeps to a part of its table."""

import math
import random

import __spark_entry__ as entry
from sonoloom.operators import metrics, retrieval


def test_word_counts_all_languages(spark, tmp_path):
    rows = [(1, "fr", "Fraction d’éjection à 55 % " * 20), (2, None, "no Überleitung " * 20), (3, "en", "rare")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.word, r.n, r.n_docs) for r in entry.queries()["word_counts_all"](spark, str(tmp_path)).collect()}
    assert got == {(w, 20, 1) for w in ("fraction", "d", "éjection", "à", "no", "überleitung")}


def embeddings(spark, folder, n=60):
    rng = random.Random(4)
    rows = [(i, rng.randrange(10), [rng.uniform(-1, 1) for _ in range(64)]) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return rows


def test_prompts_score_every_row(spark, tmp_path):
    rows = embeddings(spark, tmp_path)
    grades = len({label for i, label, _ in rows if i % 20})
    got = entry.queries()["prompt_categorical_all"](spark, str(tmp_path)).collect()
    assert len(got) == 60 * grades
    for i in range(60):
        assert abs(sum(r.probability for r in got if r.vec_id == i) - 1) < 1e-4
    assert sorted(r.vec_id for r in entry.queries()["prompt_binary_all"](spark, str(tmp_path)).collect()) == list(range(60))


def test_regression_takes_a_share_of_the_prompts(spark):
    # 50 prompts, values 0 to 49, less and less like the row: the nearest fifth is 0 to 9, its lower median 4.
    turn = lambda a: [math.cos(a), math.sin(a)]
    prompts = spark.createDataFrame([(i, i, turn(i / 50)) for i in range(50)], "vec_id long, label long, v array<double>")
    row = spark.createDataFrame([(7, turn(0.0))], "vec_id long, v array<double>")
    assert [tuple(r) for r in retrieval.share_median(row, prompts, 0.2).collect()] == [(7, 4)]
    assert retrieval.kept(2, 0.2) == 1 and retrieval.kept(2000, 0.2) == 400 and retrieval.kept(12, 0.2) == 2


def test_bootstrap_weighs_groups_by_their_rows(spark):
    # 1 row of error 100 and 99 rows of error 0: a resample with one group each has the mean 1, not 50.
    sums = spark.createDataFrame([(0, 100.0, 1), (1, 0.0, 99)], "at long, s double, c long")
    got = {round(r.value, 9) for r in metrics.bootstrap_ratios(sums, "s", "c", "at", 2, spark.range(50), "boot").collect()}
    assert got == {0.0, 1.0, 100.0}
