from pyspark.sql import functions as F

from sonoloom.functions.ids import path_key, patient_key, study_key

STUDY = {" 'Ab.1' ": "ab.1", "ab.1\t": "ab.1", " ab.1": "ab.1", "": None, "  ": None, "000": None, "Inconnu": None, "N/A": None, "--": None, None: None}
PATIENT = {"'010.0'": "10", "00010": "10", "10,00": "10", "0": None, "0.0": None, "10.5": "10.5", "unknown": None, "000010001268 ": "10001268"}
PATH = {r"\v\a\x.avi": "/v/a/x.avi", "/v//a/./x.avi ": "/v/a/x.avi", "./a/././b": "a/b", "/a/..b": "/a/..b", "": None, "/A": "/A", "a/.": "a"}


def check(spark, function, cases):
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string").select("x", "want", function(F.col("x")).alias("got"))
    assert [(r.x, r.got) for r in df.collect() if r.got != r.want] == []


def test_keys(spark):
    check(spark, study_key, STUDY)
    check(spark, patient_key, PATIENT)
    check(spark, path_key, PATH)
