"""Clause work, phrases, arrays, marks and batches over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_int_sql, hash_unit_sql
from sonoloom.functions.ranks import rank_by_hash
from sonoloom.operators import arrays as A
from sonoloom.operators import clauses as K
from sonoloom.operators.textops import CLAUSE_END, clauses, numbers
from sonoloom.plans.registry import Registry

R = Registry()

_CL = "[trim(c) for c in string_split_regex({x}, '" + CLAUSE_END + "') if trim(c) <> '']"


def _cl(x: str = "source_text") -> str:
    return _CL.format(x=x)


@R.add("select review_id, lower(strip_accents(replace(source_text, '’', ''''))) as folded from column_review")
def fold_accents(t):
    return t.column_review.select("review_id", K.fold(F.col("source_text")).alias("folded"))


@R.add(r"""with w as (select unnest(regexp_extract_all(lower(strip_accents(label)), '[\p{L}\p{N}]+')) as w from label_mappings) select regexp_replace(w, '(.{3})s$', '\1') as word, count(*) as n from w group by 1""")
def plain_word_counts(t):
    return t.label_mappings.select(F.explode(K.plain_words(F.col("label"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# Fixed values of the examples: findings and the words around them.
_FINDINGS = {"thrombus": "thromb|caillot|clot", "calcified": "calcif", "dilated": "dilat", "strain": "strain"}
_PRIOR, _NEGATION, _DOUBT = "earlier|depuis|since|antérieur", "absence|absent|no |sans |pas de|without", "probabl|difficult|difficile|limited|limitée"


@R.add(f"with c as (select review_id, [x for x in {_cl()} if regexp_matches(lower(x), '{_FINDINGS['thrombus']}|{_FINDINGS['calcified']}') and not regexp_matches(lower(x), '{_PRIOR}')] as l from column_review) select review_id, len(l) as n, array_to_string(l, '; ') as kept from c where len(l) > 0")
def clause_filter(t):
    kept = K.naming(clauses(F.col("source_text")), f"{_FINDINGS['thrombus']}|{_FINDINGS['calcified']}", _PRIOR)
    return t.column_review.select("review_id", kept.alias("l")).where(F.size("l") > 0).select("review_id", F.size("l").cast("long").alias("n"), F.array_join("l", "; ").alias("kept"))


@R.add(f"""with c as (select review_id, [x for x in {_cl()} if regexp_matches(lower(x), '{_FINDINGS['thrombus']}|{_FINDINGS['dilated']}') and not regexp_matches(lower(x), '{_FINDINGS['calcified']}|{_FINDINGS['strain']}')] as l from column_review)
select review_id, array_to_string(l, '; ') as kept from c where len(l) > 0""")
def finding_subset_clauses(t):
    kept = K.only_findings(clauses(F.col("source_text")), _FINDINGS, ["thrombus", "dilated"])
    return t.column_review.select("review_id", kept.alias("l")).where(F.size("l") > 0).select("review_id", F.array_join("l", "; ").alias("kept"))


_LEANS = "^(the rest|le reste|the |le )"


@R.add(f"""with c as (select review_id, {_cl()} as l from column_review where source_text is not null),
m as (select review_id, l, [case when regexp_matches(lower(x), 'apex|paroi|wall') then 'removed' when k > 1 and regexp_matches(lower(l[k - 1]), 'apex|paroi|wall') and regexp_matches(lower(x), '{_LEANS}') then 'stranded' else 'kept' end for x, k in l] as s from c)
select review_id, array_to_string([x for x, k in l if s[k] = 'kept'], '; ') as kept, len([x for x in s if x = 'removed']) as n_removed, len([x for x in s if x = 'stranded']) as n_stranded from m""")
def clause_surgery(t):
    s = K.surgery(clauses(F.col("source_text")), "apex|paroi|wall", _LEANS)
    return t.column_review.where("source_text is not null").select("review_id", s.alias("s")).select("review_id", "s.kept", F.col("s.n_removed").cast("long").alias("n_removed"), F.col("s.n_stranded").cast("long").alias("n_stranded"))


_COMMENT = """coalesce(json_extract_string(report_context, '$."Commentaire VG"'), json_extract_string(report_context, '$."LV comment"'))"""


@R.add(f"""with c as (select review_id, {_cl(_COMMENT)} as head, {_cl()} as said from column_review where {_COMMENT} is not null and source_text is not null)
select review_id, array_to_string(list_concat([h for h in head if len([x for x in said if contains(lower(x), lower(h))]) = 0], said), '; ') as merged from c""")
def merge_clauses(t):
    m = F.from_json("report_context", "map<string,string>")
    head = F.coalesce(F.try_element_at(m, F.lit("Commentaire VG")), F.try_element_at(m, F.lit("LV comment")))
    rows = t.column_review.select("review_id", head.alias("head"), "source_text").where("head is not null and source_text is not null")
    return rows.select("review_id", F.array_join(K.merged(clauses(F.col("head")), clauses(F.col("source_text"))), "; ").alias("merged"))


_FACTS = f"""c as (select review_id, study_id, unnest({_cl()}) as clause from column_review),
f as (select review_id, study_id, finding, case when regexp_matches(lower(clause), '{_DOUBT}') then 'uncertain' when regexp_matches(lower(clause), '{_NEGATION}') then 'absent' else 'present' end as value
  from c, (values {', '.join(f"('{n}', '{p}')" for n, p in _FINDINGS.items())}) p(finding, pattern) where regexp_matches(lower(clause), pattern))"""


@R.add(f"with {_FACTS} select review_id, finding, value, count(*) as n from f group by all")
def assertion_facts(t):
    return K.assertions(t.column_review, "review_id", "source_text", _FINDINGS, _NEGATION, _DOUBT)


@R.add(f"""with {_FACTS}, g as (select study_id, finding, list(distinct value) as v from f group by all)
select study_id, finding, case when list_contains(v, 'present') and list_contains(v, 'absent') then 'conflict' when list_contains(v, 'present') then 'present' when list_contains(v, 'absent') then 'absent' else 'uncertain' end as status from g""")
def claim_reconciliation(t):
    f = K.assertions(t.column_review, "study_id", "source_text", _FINDINGS, _NEGATION, _DOUBT)
    return f.groupBy("study_id", "finding").agg(F.collect_set("value").alias("v")).select("study_id", "finding", K.claim_status(F.col("v")).alias("status"))


_VOL = """try_cast(coalesce(json_extract_string(report_context, '$."LA vol"'), json_extract_string(report_context, '$."OG vol"')) as double)"""


def _volume():
    m = F.from_json("report_context", "map<string,string>")
    return F.coalesce(F.try_element_at(m, F.lit("LA vol")), F.try_element_at(m, F.lit("OG vol"))).try_cast("double")


@R.add(f"select review_id, 'Volume : ' || replace(printf('%.1f', {_VOL}), '.', ',') || ' ml' as sentence, {_VOL} > 50 as flagged from column_review where {_VOL} between 5 and 200")
def template_sentences(t):
    rows = t.column_review.select("review_id", _volume().alias("v")).where("v between 5 and 200")
    return rows.select("review_id", F.concat(F.lit("Volume : "), K.decimal_text(F.col("v"), 1), F.lit(" ml")).alias("sentence"), (F.col("v") > 50).alias("flagged"))


@R.add(f"""select r.review_id, bool_or(abs(x - {_VOL} * s) <= abs({_VOL} * s) * 0.011) as stated from column_review r, (select unnest([1.0, 0.1, 10.0]) as s),
 (select review_id, unnest(regexp_extract_all(source_text, '[0-9]+(?:[.,][0-9]+)?')) as raw from column_review) n, lateral (select try_cast(replace(raw, ',', '.') as double) as x)
 where n.review_id = r.review_id and {_VOL} is not null group by 1""")
def tolerance_over_scales(t):
    rows = t.column_review.select("review_id", numbers(F.col("source_text")).alias("read"), F.array(_volume()).alias("values")).where("values[0] is not null and size(read) > 0")
    each = rows.select("review_id", F.explode("read").alias("x"), "values")
    return each.groupBy("review_id").agg(F.bool_or(K.matches_scaled(F.col("x"), F.col("values"), [1.0, 0.1, 10.0], 0.011)).alias("stated"))


_PHRASES = ["mitral valve", "left atrium", "Absence de thrombus", "quality", "qualité limitée"]


@R.add(f"""with p as (select doc_id, array_to_string([x for x in [{', '.join("'" + p + "'" for p in _PHRASES)}] if contains(lower(text), lower(x))], '+') as phrases from documents)
select coalesce(phrases, '') as phrases, count(*) as n from p group by 1""")
def phrase_features(t):
    p = F.coalesce(F.array_join(K.phrases_in(F.col("text"), _PHRASES), "+"), F.lit(""))
    return t.documents.groupBy(p.alias("phrases")).agg(F.count(F.lit(1)).alias("n"))


@R.add("select doc_id, regexp_replace(text, '[0-9]+(?:[.,][0-9]+)? ?%', '<value>', 'g') as masked from documents where text is not null")
def value_masking(t):
    return t.documents.where("text is not null").select("doc_id", F.regexp_replace("text", r"[0-9]+(?:[.,][0-9]+)? ?%", "<value>").alias("masked"))


@R.add("""with v as (select still_row, [x::double for x in json_extract(signed_values, '$.*')[1]::json[]] as x from radar_stills)
select case when len(x) > 2 then 'several' when len(x) = 2 then 'pair' when len(x) = 1 then 'single' else 'none' end as evidence, count(*) as n, sum(len([a for a in x if abs(a) >= 2])) as n_large from v group by 1""")
def json_list_class(t):
    lists = F.map_values(F.from_json("signed_values", "map<string,array<double>>"))
    x = F.coalesce(F.get(lists, F.lit(0)), F.array().cast("array<double>"))
    rows = t.radar_stills.select(x.alias("x"))
    kind = F.when(F.size("x") > 2, "several").when(F.size("x") == 2, "pair").when(F.size("x") == 1, "single").otherwise("none")
    return rows.groupBy(kind.alias("evidence")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("x", lambda a: F.abs(a) >= 2))).alias("n_large"))


@R.add("""with b as (select still_row, study_id, spec_y0, spec_y1, max(spec_y1) over (partition by study_id order by spec_y0, still_row rows between unbounded preceding and 1 preceding) as edge from radar_stills where study_id is not null and spec_y0 is not null and spec_y1 is not null)
select still_row, sum(case when edge is null or spec_y0 >= edge then 1 else 0 end) over (partition by study_id order by spec_y0, still_row) as line from b""")
def text_lines(t):
    rows = t.radar_stills.where("study_id is not null and spec_y0 is not null and spec_y1 is not null")
    return K.lines_of(rows, ["study_id"], "spec_y0", "spec_y1", ["still_row"]).select("still_row", "line")


_FORM = ["EF (%)", "FE (%)", "LA vol", "OG vol"]


@R.add(f"select unnest([k for k in json_keys(report_context) if not list_contains([{', '.join(repr(f) for f in _FORM)}], k]) as field, count(*) as n from column_review group by 1".replace("k]) as", "k)]) as"))
def schema_paths(t):
    return t.column_review.select(F.explode(K.unknown_paths(F.col("report_context"), _FORM)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


# ---- arrays ----------------------------------------------------------------------


@R.add("select eval_id, flatten([flatten([study_ids[s:s + 1], study_ids[s:s + 1]]) for s in range(1, greatest(len(study_ids), 1) + 1, 2)]) as ids from eval_sets")
def repeat_blocks(t):
    return t.eval_sets.select("eval_id", A.repeated_blocks(F.col("study_ids"), 2, 2).alias("ids"))


@R.add("""with e as (select vec_id, unnest(embedding)::double as x, unnest(list_reverse(embedding))::double as y from embeddings) select vec_id, round(avg(abs(x - y) ** 2) / 2, 6) as error from e where x > 0.05 group by 1""")
def masked_mean_error(t):
    keep = F.transform("embedding", lambda x: x.cast("double") > 0.05)
    out = t.embeddings.select("vec_id", F.round(A.masked_error(F.col("embedding"), F.reverse("embedding"), keep, 2.0), 6).alias("error"))
    return out.where("error is not null")


@R.add("""with e as (select label, vec_id, embedding::double[] as v from embeddings), p as (select a.label, list_sum([(x - b.v[k]) ** 2 for x, k in a.v]) as d from e a join e b on a.label = b.label and a.vec_id < b.vec_id)
select label, (1 + sqrt(1 + 8 * count(*)))::bigint // 2 as n, round(avg(d), 5) as mean_distance from p group by 1""")
def pairwise_spread(t):
    s = A.group_spread(t.embeddings, "label", "embedding")
    return s.select("label", "n", F.round("mean_distance", 5).alias("mean_distance"))


@R.add("""with e as (select vec_id, k - 1 as i, abs(x::double) as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as k from embeddings))
select vec_id, round(sum(l), 5) as total, round(min(l), 5) as least from (select vec_id, (i // 8) // 2 as r, (i % 8) // 2 as c, ln(avg(x) + 0.001) as l from e group by all) group by 1""")
def grid_pool(t):
    g = t.embeddings.select("vec_id", A.pooled_grid(F.transform("embedding", lambda x: F.abs(x.cast("double"))), 8, 4, 0.001).alias("g"))
    return g.select("vec_id", F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_min("g"), 5).alias("least"))


@R.add("""with h as (select still_row, lower(pixel_hash) as p from radar_stills where regexp_full_match(lower(pixel_hash), '[0-9a-f]{32}')) select still_row, bit_count(('0x' || substr(p, 1, 16))::ubigint) + bit_count(('0x' || substr(p, 17, 16))::ubigint) as ones, (('0x' || substr(p, 1, 1))::int & 8) = 8 as first from h""")
def packed_bits(t):
    b = t.radar_stills.where(F.lower("pixel_hash").rlike("^[0-9a-f]{32}$")).select("still_row", A.hex_bits(F.col("pixel_hash")).alias("b"))
    return b.select("still_row", F.size(F.filter("b", lambda x: x)).alias("ones"), F.get("b", F.lit(0)).alias("first"))


@R.add("""with s as (select avg(ln(label)) as m, stddev_pop(ln(label)) as s from build_manifests where label > 0 and split = 'train'), z as (select row_id, label, (ln(label) - m) / s as z from build_manifests, s where label > 0)
select row_id, round(z, 6) as z, round(exp(z * s.s + s.m), 6) as back from z, s""")
def inverse_transform(t):
    rows = t.build_manifests.where("label > 0")
    m, s = rows.where("split = 'train'").agg(F.avg(F.log("label")), F.stddev_pop(F.log("label"))).first()
    z = rows.select("row_id", ((F.log("label") - F.lit(m)) / F.lit(s)).alias("z"))
    return z.select("row_id", F.round("z", 6).alias("z"), F.round(F.exp(F.col("z") * F.lit(s) + F.lit(m)), 6).alias("back"))


@R.add("""select row_id, [[least(floor(greatest(n_frames - 13, 0) * k / 2)::int + i * 4, greatest(n_frames - 1, 0)) for i in range(4)] for k in range(3)]::varchar as frames from build_manifests where n_frames is not null""")
def contiguous_clips(t):
    c = A.clip_frames(F.col("n_frames"), 3, 4, 4)
    text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ", "), F.lit("]"))), ", "), F.lit("]"))
    return t.build_manifests.where("n_frames is not null").select("row_id", text.alias("frames"))


@R.add("""with m as (select still_row, study_id, spec_x0, spec_x0 - lag(spec_x0) over (partition by study_id order by spec_x0, still_row) as gap from radar_stills where study_id is not null and spec_x0 is not null)
select still_row, sum(case when gap <= 25 then 0 else 1 end) over (partition by study_id order by spec_x0, still_row) as chain from m""")
def mark_chains(t):
    rows = t.radar_stills.where("study_id is not null and spec_x0 is not null")
    return A.chained(rows, ["study_id"], "spec_x0", 25.0, ["still_row"]).select("still_row", "chain")


@R.add("""with s as (select manufacturer, still_tag, count(*) as n, var_pop(spec_x0) as vx, var_pop(spec_y0) as vy, covar_pop(spec_x0, spec_y0) as c from radar_stills where spec_x0 is not null and spec_y0 is not null group by all)
select manufacturer, still_tag, n, n >= 3 and vx + vy > 0 and (vx + vy - sqrt((vx - vy) * (vx - vy) + 4 * c * c)) / 2 <= 0.2 * (vx + vy) as straight from s""")
def straight_marks(t):
    return A.straight(t.radar_stills.where("spec_x0 is not null and spec_y0 is not null"), ["manufacturer", "still_tag"], "spec_x0", "spec_y0", 3, 0.2)


@R.add("""select study_id, least(a.still_row, b.still_row) as id_a, greatest(a.still_row, b.still_row) as id_b from radar_stills a join radar_stills b using (study_id) where a.still_row < b.still_row and abs(a.spec_x0 - b.spec_x0) <= 8""")
def mark_pairs(t):
    return A.near_pairs(t.radar_stills, "study_id", "still_row", "spec_x0", 8.0)


@R.add(f"""with r as (select row_id, n_frames, row_number() over (partition by n_frames order by {hash_int_sql('batch', 'row_id')}, row_id) as k from build_manifests where n_frames is not null)
select n_frames, (k - 1) // 16 as batch, count(*) as n, min(row_id) as least from r group by all""")
def length_batches(t):
    b = A.length_batches(t.build_manifests.select("row_id", "n_frames"), "n_frames", "row_id", 16, "batch")
    return b.groupBy("n_frames", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("least"))


@R.add(f"""with r as (select review_id, concept, row_number() over (order by {hash_int_sql('targets', 'review_id')}, review_id) as k from column_review), b as (select review_id, concept, (k - 1) // 32 as batch from r),
n as (select batch, concept, count(*) as n from b group by all) select a.batch, a.review_id as a, c.review_id as b, 1.0 / n.n as target from b a join b c on a.batch = c.batch and a.concept = c.concept join n on n.batch = a.batch and n.concept = a.concept""")
def target_matrix(t):
    r = rank_by_hash(t.column_review.select("review_id", "concept"), hash_int("targets", F.col("review_id")), ["review_id"], "k")
    b = r.select("review_id", "concept", F.floor((F.col("k") - 1) / 32).cast("long").alias("batch"))
    return A.equal_targets(b, ["batch"], "review_id", "concept")


@R.add(f"""with s as (select eval_id, list_sort(list_distinct(study_ids)) as ids from eval_sets), d as (select eval_id, x, {hash_unit_sql('slot', 'eval_id', 'x')} as u from (select eval_id, unnest(ids) as x from s)),
r as (select *, row_number() over (partition by eval_id order by u desc, x) as k from d) select eval_id, count(*) as n_kept, min(x) as first from r where k <= 2 or u >= 0.4 group by 1""")
def slot_augmentation(t):
    kept = A.dropped_slots(F.array_sort(F.array_distinct("study_ids")), "slot", F.col("eval_id"), 0.4, 2)
    out = t.eval_sets.select("eval_id", kept.alias("kept")).where(F.size("kept") > 0)
    return out.select("eval_id", F.size("kept").cast("long").alias("n_kept"), F.array_min("kept").alias("first"))


@R.add(f"""with l as (select row_id, site, row_number() over (partition by site order by {hash_int_sql('row', 'row_id')}, row_id) - 1 as local from build_manifests), s as (select site, count(*) as n from build_manifests group by 1),
b as (select site, coalesce(sum(n) over (order by site nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as before from s) select row_id, l.site, local, before + local as global_row from l join b on l.site is not distinct from b.site""")
def global_row_map(t):
    return A.row_map(t.build_manifests, "site", "row_id")


@R.add(f"""with f as (select row_id, unnest(['short', 'slow', 'low']) as signal, unnest([n_frames < 20, fps < 20, label < 40]) as hit from build_manifests),
r as (select row_id, signal, row_number() over (partition by signal order by {hash_int_sql('signal', 'signal', 'row_id')}, row_id) as k from f where hit) select row_id, string_agg(signal, '+' order by signal) as signals from r where k <= 40 group by 1""")
def signal_samples(t):
    f = t.build_manifests.select("row_id", F.explode(F.create_map(F.lit("short"), F.col("n_frames") < 20, F.lit("slow"), F.col("fps") < 20, F.lit("low"), F.col("label") < 40)).alias("signal", "hit")).where("hit")
    r = rank_by_hash(f, hash_int("signal", F.col("signal"), F.col("row_id")), ["row_id"], "k", ("signal",))
    return r.where("k <= 40").groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_list("signal")), "+").alias("signals"))


@R.add("""with r(view, modality, weight) as (values ('A4C', 'bmode', 3), ('A4C', null, 2), (null, 'bmode', 1)), m as (select review_id, weight, row_number() over (partition by review_id order by (r.view is not null)::int + (r.modality is not null)::int desc, (r.view is not null)::int desc) as k
 from column_review c join r on (r.view is null or r.view = c.view_class) and (r.modality is null or r.modality = c.modality))
select c.review_id, coalesce(m.weight, 0) as weight from column_review c left join m on m.review_id = c.review_id and m.k = 1""")
def precedence_lookup(t):
    rules = {("A4C", "bmode"): 3, ("A4C", None): 2, (None, "bmode"): 1}
    # From the least to the most special, so that the most special one decides.
    out = F.lit(0)
    for (view, modality), weight in sorted(rules.items(), key=lambda r: (sum(x is not None for x in r[0]), r[0][0] is not None)):
        fits = (F.lit(True) if view is None else F.col("view_class") == view) & (F.lit(True) if modality is None else F.col("modality") == modality)
        out = F.when(fits, weight).otherwise(out)
    return t.column_review.select("review_id", out.alias("weight"))


@R.add("""with c as (select distinct lower(replace(concept, '_', ' ')) as name from column_review), a as (select concept_id, unnest(list_append(aliases, lower(label_en))) as alias from ontology)
select distinct concept_id, name from a join c on length(a.alias) > 3 and (contains(c.name, a.alias) or contains(a.alias, c.name))""")
def fuzzy_columns(t):
    # Column names of one form, at most one per entry of the reference list; the match is over distinct names only.
    names = t.column_review.select(F.lower(F.replace("concept", F.lit("_"), F.lit(" "))).alias("name")).distinct()
    held = names.agg(F.collect_set("name").alias("names")).first()["names"] or []
    alias = t.ontology.select("concept_id", F.explode(F.array_append("aliases", F.lower("label_en"))).alias("alias")).where(F.length("alias") > 3)
    each = alias.select("concept_id", "alias", F.explode(F.array(*[F.lit(n) for n in held]) if held else F.array().cast("array<string>")).alias("name"))
    return each.where(F.contains("name", "alias") | F.contains("alias", "name")).select("concept_id", "name").distinct()


@R.add("""with v as (select study_id, view_class, max(try_cast(json_extract_string(report_context, '$."LA vol"') as double)) as v from column_review group by all)
select study_id, case when count(distinct v) = 1 then max(v) end as value, count(distinct v) as n_values, count(*) as n_views from v group by 1""")
def view_agreement(t):
    v = F.try_element_at(F.from_json("report_context", "map<string,string>"), F.lit("LA vol")).try_cast("double")
    per = t.column_review.groupBy("study_id", "view_class").agg(F.max(v).alias("v"))
    n = F.countDistinct("v")
    return per.groupBy("study_id").agg(F.when(n == 1, F.max("v")).alias("value"), n.alias("n_values"), F.count(F.lit(1)).alias("n_views"))


QUERIES, SQL = R.queries, R.sql
