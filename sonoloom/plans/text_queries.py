"""Clauses, templates, numbers, JSON fields, digests and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.functions.ids import patient_key, patient_key_sql
from sonoloom.operators import retrieval, textops
from sonoloom.plans.registry import Registry

R = Registry()
# Stands in for the secret of sources.config.read_salt, so that the SQL can say the same digest.
SALT = "not-a-secret-of-tests"

_CLAUSES = "list_filter(list_transform(regexp_split_to_array({x}, '//|;|\\n|\\.(?:\\s|$)'), lambda c: trim(c)), lambda c: c <> '')"
_CANON = "regexp_replace(regexp_replace(lower(c), '[\\s]+', ' ', 'g'), '^[ .,;:!?]+|[ .,;:!?]+$', '', 'g')"
_NUM = "[0-9]+(?:[.,][0-9]+)?"


@R.add(f"select review_id, len({_CLAUSES.format(x='source_text')}) as n_clauses, array_to_string({_CLAUSES.format(x='source_text')}, ' | ') as clauses from column_review where source_text is not null")
def clause_split(t):
    c = textops.clauses(F.col("source_text"))
    return t.column_review.where("source_text is not null").select("review_id", F.size(c).cast("long").alias("n_clauses"), F.array_join(c, " | ").alias("clauses"))


@R.add(f"with c as (select unnest({_CLAUSES.format(x='source_text')}) as c from column_review) select regexp_replace({_CANON}, '{_NUM}', '#', 'g') as template, count(*) as n from c group by 1 having count(*) >= 3")
def clause_template_counts(t):
    return textops.clause_counts(t.column_review, "source_text", 3)


@R.add(f"select review_id, len(regexp_extract_all(source_text, '{_NUM}')) as n, round(list_sum(list_transform(regexp_extract_all(source_text, '{_NUM}'), lambda x: replace(x, ',', '.')::double)), 4) as total from column_review where source_text is not null")
def number_extract(t):
    n = textops.numbers(F.col("source_text"))
    total = F.when(F.size(n) > 0, F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 4))
    return t.column_review.where("source_text is not null").select("review_id", F.size(n).cast("long").alias("n"), total.alias("total"))


_KEYS = {"ventricle": r"ventric", "valve": r"valv", "velocity": r"velocit|vitesse", "absent": r"\bno\b|absence|absent", "measured": r"[0-9] ?mm"}


@R.add("select review_id, concat_ws('+', " + ", ".join(f"case when regexp_matches(lower(source_text), '{p}') then '{k}' end" for k, p in _KEYS.items()) + ") as found from column_review where source_text is not null")
def keyword_flags(t):
    return t.column_review.where("source_text is not null").select("review_id", textops.flags(F.col("source_text"), _KEYS).alias("found"))


@R.add("""with x as (select review_id, trim(regexp_replace(coalesce(source_text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')) as v from column_review)
select review_id, case when lower(v) in ('na', 'n/a', 'nan', 'none', 'null', '-', '.') then '' else v end as cell from x""")
def clean_cells(t):
    return t.column_review.select("review_id", textops.clean_cell(F.col("source_text")).alias("cell"))


@R.add("""select concept, count(*) as n_rows, count(source_text) as n_with_text, count(distinct source_text) as n_texts, count(*) filter (try_cast(source_text as double) is not null) as n_codes,
  count(distinct study_id) as n_studies from column_review group by 1""")
def caption_ledger(t):
    return t.column_review.groupBy("concept").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("source_text").alias("n_with_text"), F.countDistinct("source_text").alias("n_texts"), F.count_if(F.col("source_text").try_cast("double").isNotNull()).alias("n_codes"), F.countDistinct("study_id").alias("n_studies")
    )


@R.add("""with k as (select review_id, report_context::json as j, unnest(json_keys(report_context)) as field from column_review where report_context is not null),
v as (select review_id, field, json_type(j -> ('$."' || field || '"')) as kind, j ->> ('$."' || field || '"') as x from k)
select field, count(*) as n, count(x) as n_known, count(try_cast(x as double)) as n_numbers, round(avg(try_cast(x as double)), 6) as mean from v group by 1""")
def json_field_profile(t):
    m = F.explode(F.from_json("report_context", "map<string,string>")).alias("field", "x")
    v = t.column_review.where("report_context is not null").select("review_id", m)
    number = F.col("x").try_cast("double")
    return v.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_known"), F.count(number).alias("n_numbers"), F.round(F.avg(number), 6).alias("mean"))


@R.add("""with w as (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}]+')) as word, doc_id from documents)
select word, count(*) as n, count(distinct doc_id) as n_docs from w group by 1 having count(*) >= 20""")
def word_counts_all(t):
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 20")


@R.add("select doc_id, nullif(regexp_extract(text, '(?s)(?:^|\\n)Measurements\\n+(.*?)(?:\\n\\n|$)', 1), '') as section from documents where text like '%Measurements%'")
def text_section(t):
    return t.documents.where(F.col("text").like("%Measurements%")).select("doc_id", textops.section(F.col("text"), "Measurements").alias("section"))


@R.add("select count(*) as n, sum(('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint)::bigint as digest_a, sum(('0x' || substr(md5(doc_id::varchar), 9, 8))::bigint)::bigint as digest_b from documents")
def digest_order_free(t):
    return textops.order_free_digest(t.documents, "doc_id")


@R.add("select doc_type, coalesce(lang, 'none') as lang, count(*) as n, sum(n_chars)::bigint as chars, round(avg(length(text)), 4) as mean_length, max(n_chars) as longest from documents group by 1, 2")
def document_profile(t):
    return t.documents.groupBy("doc_type", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.max("n_chars").alias("longest"))


@R.add("select regexp_replace(png_path, '/[^/]*$', '') as folder, regexp_extract(png_path, '\\.([^./]+)$', 1) as suffix, count(*) as n from radar_stills group by 1, 2")
def path_folders(t):
    return t.radar_stills.groupBy(F.regexp_replace("png_path", "/[^/]*$", "").alias("folder"), F.regexp_extract("png_path", r"\.([^./]+)$", 1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"select row_id, sha256('{SALT}' || chr(1) || {patient_key_sql('patient_id')}) as person_key, concat_ws(' | ', coalesce(site, '<missing>'), coalesce(view_class, '<missing>'), coalesce(round(fps)::int::varchar, '<missing>')) as layout from build_manifests")
def salted_keys(t):
    part = lambda c: F.coalesce(c, F.lit("<missing>"))
    return t.build_manifests.select(
        "row_id", F.sha2(F.concat(F.lit(SALT + "\u0001"), patient_key(F.col("patient_id"))), 256).alias("person_key"), F.concat_ws(" | ", part(F.col("site")), part(F.col("view_class")), part(F.round("fps").cast("int").cast("string"))).alias("layout")
    )


# ---- embeddings -----------------------------------------------------------------

_UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)"


def _units(t):
    return t.embeddings.select(F.col("vec_id").alias("vec_id"), "label", retrieval.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


_NEAR = f"""{_UNIT}, n as (select q.vec_id as query_id, c.vec_id, c.label, round(list_dot_product(q.v, c.v), 9) as similarity from u q join u c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as place from n)"""


def _nearest(t, k):
    u = _units(t)
    return retrieval.nearest(u.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v"), u, k)


@R.add(f"with {_NEAR} select query_id, vec_id, place from r where place <= 10")
def nearest_neighbours(t):
    return _nearest(t, 10).select("query_id", "vec_id", F.col("place").cast("long"))


@R.add(f"with {_NEAR} select query_id, round(avg(label), 6) as mean_label, round(avg(similarity), 6) as mean_similarity from r where place <= 20 group by 1")
def knn_label_mean(t):
    n = _nearest(t, 20).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return n.groupBy("query_id").agg(F.round(F.avg("label"), 6).alias("mean_label"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


@R.add(f"with {_NEAR}, k as (select query_id, list(label order by label) as l from r where place <= 10 group by 1) select query_id, l[(len(l) - 1) // 2 + 1] as lower_median from k")
def prompt_regression_lower_median(t):
    n = _nearest(t, 10).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return n.groupBy("query_id").agg(retrieval.lower_median(F.collect_list("label")).alias("lower_median"))


# Every row against the prompt vectors: grade centres of length 1, and the mean over each of two prompt sets.
_CENTRES = f"""{_UNIT}, c as (select {{grade}} as grade, i, avg(v[i]) as x from u, range(1, 65) r(i) where vec_id % 20 <> 0 and label is not null group by 1, 2), p as (select grade, list(x order by i) as x from c group by 1),
s as (select q.vec_id, p.grade, list_dot_product(q.v, p.x){{length}} as score from u q, p where q.v is not null)"""


def _all_scores(t, grade, pooled):
    """vec_id, and the grades with their scores in one array: a map over the rows, no shuffle of them."""
    u = _units(t)
    p = retrieval.mean_vector(u.where("vec_id % 20 <> 0 and label is not null").select(grade.alias("grade"), "v"), ["grade"], "v")
    p = p.select("grade", retrieval.unit(F.col("v")).alias("v")) if pooled else p
    held = p.agg(F.array_sort(F.collect_list(F.struct("grade", "v"))).alias("grades"))
    score = F.transform("grades", lambda g: F.struct(g["grade"].alias("grade"), retrieval.dot(F.col("v"), g["v"]).alias("score")))
    return u.where("v is not null").select("vec_id", "v").crossJoin(F.broadcast(held)).select("vec_id", score.alias("scores"))


@R.add(f"""with {_CENTRES.format(grade="label", length=" / sqrt(list_dot_product(p.x, p.x))")}, e as (select *, exp((score - max(score) over (partition by vec_id)) / 0.1) as e from s)
select vec_id, grade, round(e / sum(e) over (partition by vec_id), 6) as probability from e""")
def prompt_categorical_all(t):
    return retrieval.softmax_array(_all_scores(t, F.col("label"), True), "scores", 0.1).select("vec_id", "grade", F.round("probability", 6).alias("probability"))


@R.add(f"with {_CENTRES.format(grade='(label < 5)', length='')} select vec_id, round(1 / (1 + exp(-(max(score) filter (grade) - max(score) filter (not grade)) / 0.1)), 6) as probability from s group by 1")
def prompt_binary_all(t):
    of = lambda x: F.element_at(F.transform(F.filter("scores", lambda g: g["grade"] == F.lit(x)), lambda g: g["score"]), 1)
    d = _all_scores(t, F.col("label") < 5, False).select("vec_id", (of(True) - of(False)).alias("d"))
    return d.select("vec_id", F.round(1 / (1 + F.exp(-F.col("d") / 0.1)), 6).alias("probability"))


# Prompt set of a fixed size: 20 vectors a label, so a row costs the same whatever the table's size.
_SET = f"""{_UNIT}, p as (select vec_id, label, v from u where v is not null and label is not null qualify row_number() over (partition by label order by vec_id) <= 20),
s as (select q.vec_id, p.label, row_number() over (partition by q.vec_id order by round(list_dot_product(q.v, p.v), 9) desc, p.vec_id) as place from u q, p where q.v is not null),
k as (select vec_id, list(label order by label) as l from s where place <= (select greatest(1, round_even(0.2 * count(*), 0)) from p) group by 1)"""


@R.add(f"with {_SET} select vec_id, l[(len(l) - 1) // 2 + 1] as lower_median from k")
def prompt_regression_share_median(t):
    u = _units(t).where("v is not null")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    p = u.where("label is not null").withColumn("place", place).where("place <= 20")
    return retrieval.share_median(u, p, 0.2)


@R.add("with c as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by 1, 2) select label, round(sqrt(sum(x * x)), 6) as length, round(max(x), 6) as largest from c group by 1")
def layout_baseline_mean(t):
    m = retrieval.mean_vector(t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")), ["label"], "v")
    return m.select("label", F.round(F.sqrt(retrieval.dot(F.col("v"), F.col("v"))), 6).alias("length"), F.round(F.array_max("v"), 6).alias("largest"))


@R.add("""with c as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by 1, 2)
select e.vec_id, count(*) filter (abs(e.embedding[c.i]::double - c.x) > 0.2) as n_extra from embeddings e join c using (label) group by 1""")
def extra_cells(t):
    e = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    m = retrieval.mean_vector(e, ["label"], "e").withColumnRenamed("v", "m")
    far = F.filter(F.zip_with("e", "m", lambda a, b: F.abs(a - b)), lambda d: d > 0.2)
    return e.join(m, "label").select("vec_id", F.size(far).cast("long").alias("n_extra"))


QUERIES, SQL = R.queries, R.sql
