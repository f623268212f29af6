"""Further data operators: extraction, preferences, combinations, sliding windows, segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_int_sql
from sonoloom.functions.ids import study_key, study_key_sql
from sonoloom.plans.common import M, P, manifest, predictions
from sonoloom.plans.registry import Registry
from sonoloom.plans.text_queries import _NEAR, _nearest

R = Registry()


@R.add(f"""with {_NEAR}, h as (select r.query_id, q.label, max((r.label = q.label)::int) as hit from r join u q on q.vec_id = r.query_id where place <= 5 group by 1, 2)
select label, count(*) as n, round(avg(hit), 6) as recall_at_5 from h group by 1""")
def class_mean_recall(t):
    labels = t.embeddings.select("vec_id", "label")
    n = _nearest(t, 5).join(labels.withColumnRenamed("label", "found"), "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    h = n.groupBy("query_id", "label").agg(F.max((F.col("found") == F.col("label")).cast("int")).alias("hit"))
    return h.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("recall_at_5"))


@R.add("""with c as (select vec_id, i::bigint as i, abs(embedding[i]::double) as x from embeddings, range(1, 65) r(i)),
w as (select vec_id, i - 7 as start, sum(x) over (partition by vec_id order by i rows 7 preceding) as s, max(x) over (partition by vec_id order by i rows 7 preceding) as top from c),
r as (select *, row_number() over (partition by vec_id order by round(s, 9), start) as k from w where start >= 1 and top < 0.3) select vec_id, start, round(s, 6) as weight from r where k = 1""")
def free_window(t):
    c = t.embeddings.select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("i", "x"))
    w = Window.partitionBy("vec_id").orderBy("i").rowsBetween(-7, 0)
    s = c.select("vec_id", (F.col("i") - 6).cast("long").alias("start"), F.sum("x").over(w).alias("s"), F.max("x").over(w).alias("top")).where("start >= 1 and top < 0.3")
    k = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.round("s", 9), "start"))
    return s.withColumn("k", k).where("k = 1").select("vec_id", "start", F.round("s", 6).alias("weight"))


@R.add("select event_id, s.k::bigint as frame, epoch_us(ts) // 1000000 - 8 + s.k * 2 as at from events, range(4) s(k) where event_type = 'error' and epoch_us(ts) // 1000000 - 8 + s.k * 2 >= 0")
def segment_frames(t):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    e = t.events.where("event_type = 'error'").select("event_id", at.alias("s"), F.posexplode(F.sequence(at - 8, at - 2, F.lit(2))).alias("frame", "at"))
    return e.where("at >= 0").select("event_id", F.col("frame").cast("long").alias("frame"), "at")


@R.add("""with a as (select concept_id, unnest(aliases) as alias from ontology) select concept_id, alias from a where not exists (select 1 from a b where b.concept_id = a.concept_id and b.alias <> a.alias and contains(b.alias, a.alias))""")
def remove_subsets(t):
    kept = F.filter("aliases", lambda a: ~F.exists("aliases", lambda b: (b != a) & F.contains(b, a)))
    return t.ontology.select("concept_id", F.explode(kept).alias("alias"))


@R.add(f"""with {P}, s as (select 'low_prob' as signal, prob >= 0.5 as hit, low from p union all select 'rare_view', view in ('RVINF', 'SUBCOSTAL', 'OTHER'), low from p union all select 'train', split = 'train', low from p)
select signal, count(*) filter (hit) as n_hit, count(*) filter (hit and low) as n_both, round(count(*) filter (hit and low) / nullif(count(*) filter (hit), 0), 6) as precision, round(count(*) filter (hit and low) / nullif(count(*) filter (low), 0), 6) as recall from s group by 1""")
def signal_report(t):
    signals = {"low_prob": "prob >= 0.5", "rare_view": "view in ('RVINF', 'SUBCOSTAL', 'OTHER')", "train": "split = 'train'"}
    s = predictions(t).select("low", F.inline(F.array(*[F.struct(F.lit(k).alias("signal"), F.expr(c).alias("hit")) for k, c in signals.items()])))
    hit, both = F.count_if("hit"), F.count_if(F.col("hit") & F.col("low"))
    return s.groupBy("signal").agg(hit.alias("n_hit"), both.alias("n_both"), F.round(F.try_divide(both, hit), 6).alias("precision"), F.round(F.try_divide(both, F.count_if("low")), 6).alias("recall"))


@R.add(f"""with {P}, r as (select row_id, patient, view, prob from p where patient is not null)
select a.row_id as first_row, b.row_id as second_row from r a join r b on a.view = 'A4C' and b.view = 'PLAX' and a.patient <> b.patient order by a.prob desc, a.row_id, b.prob desc, b.row_id limit 1""")
def best_distinct_pair(t):
    """Best-ranked pair over two pools with different patients: the best row of the two best patients of each pool is enough."""
    order = [F.col("prob").desc(), F.col("row_id")]
    best = predictions(t).where("view in ('A4C', 'PLAX') and patient is not null").groupBy("view", "patient").agg(F.min(F.struct((-F.col("prob")).alias("d"), "row_id")).alias("b"))
    best = best.select("view", "patient", (-F.col("b.d")).alias("prob"), "b.row_id")
    pools = [best.where(F.col("view") == v).orderBy(*order).limit(2).select(F.lit(1).alias("one"), F.struct("prob", "row_id", "patient").alias(n)) for v, n in (("A4C", "a"), ("PLAX", "b"))]
    pair = pools[0].join(pools[1], "one").where("a.patient <> b.patient").orderBy(F.col("a.prob").desc(), "a.row_id", F.col("b.prob").desc(), "b.row_id").limit(1)
    return pair.select(F.col("a.row_id").alias("first_row"), F.col("b.row_id").alias("second_row"))


@R.add(f"with {M}, g as (select study, n_frames, lag(n_frames) over (partition by study order by ingested_at, row_id) as before from m where study is not null) select study, count(before) as n_pairs, round(avg((abs(n_frames - before) <= 2)::int), 6) as share from g group by 1")
def duplicate_share(t):
    w = Window.partitionBy("study").orderBy("ingested_at", "row_id")
    g = manifest(t).where("study is not null").withColumn("before", F.lag("n_frames").over(w))
    near = (F.abs(F.col("n_frames") - F.col("before")) <= 2).cast("int")
    return g.groupBy("study").agg(F.count("before").alias("n_pairs"), F.round(F.avg(near), 6).alias("share"))


@R.add(f"""with r as (select vec_id, embedding, row_number() over (order by {hash_int_sql('mix', 'vec_id')}, vec_id) as k, count(*) over () as n from embeddings)
select a.vec_id, b.vec_id as partner, round(0.7 * a.embedding[1]::double + 0.3 * b.embedding[1]::double, 6) as first from r a join r b on b.k = a.k % a.n + 1""")
def row_mixing(t):
    from sonoloom.functions.ranks import rank_by_hash

    n = t.embeddings.count()
    r = rank_by_hash(t.embeddings.select("vec_id", "embedding"), hash_int("mix", F.col("vec_id")), ["vec_id"], "k")
    b = r.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("other"), F.col("k").alias("at"))
    mixed = r.withColumn("at", F.col("k") % max(n, 1) + 1).join(b, "at")
    both = F.zip_with(F.transform("embedding", lambda x: x.cast("double")), F.transform("other", lambda x: x.cast("double")), lambda x, y: 0.7 * x + 0.3 * y)
    return mixed.select("vec_id", "partner", F.round(F.get(both, F.lit(0)), 6).alias("first"))


@R.add("""with r as (select still_row, still_id, source, still_tag, exported_at, row_number() over (partition by key order by (split = 'train')::int desc, exported_at desc, still_row) as k, key from (select *, """ + study_key_sql("still_id") + """ as key from radar_stills))
select still_row, source, still_tag from r where k = 1 or key is null""")
def preferred_row(t):
    """One row per still, of train and latest export first; a row whose id names nothing is no repeat of another."""
    rows = t.radar_stills.withColumn("key", study_key(F.col("still_id")))
    best = F.max_by(F.struct("still_row", "source", "still_tag"), F.struct((F.col("split") == "train").cast("int"), "exported_at", -F.col("still_row")))
    named = rows.where("key is not null").groupBy("key").agg(best.alias("r")).select("r.*")
    return named.unionByName(rows.where("key is null").select("still_row", "source", "still_tag"))


@R.add(f"with {M} select path, count(*) as n, count(distinct study) as n_studies from m where path is not null group by 1 having count(*) > 1 order by n desc, path limit 100")
def most_repeated(t):
    g = manifest(t).where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("study").alias("n_studies")).where("n > 1")
    return g.orderBy(F.col("n").desc(), "path").limit(100)


@R.add("with l as (select mapping_id, source, unnest(concepts) as concept from label_mappings), k as (select source, count(*) as n, count(distinct mapping_id) as n_rows, count(distinct lower(concept)) as n_values from l group by 1) select * from k")
def nested_values(t):
    x = t.label_mappings.select("mapping_id", "source", F.explode("concepts").alias("concept"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mapping_id").alias("n_rows"), F.countDistinct(F.lower("concept")).alias("n_values"))


@R.add(f"with {M}, x as (select study, list_sort(list(distinct split_part(view, '_', 1))) as f from m where study is not null group by 1) select array_to_string(f, '+') as families, count(*) as n from x group by 1 having count(*) >= 2")
def tag_sets(t):
    x = manifest(t).where("study is not null").groupBy("study").agg(F.array_join(F.array_sort(F.collect_set(F.split_part("view", F.lit("_"), F.lit(1)))), "+").alias("families"))
    return x.groupBy("families").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@R.add(f"with {P}, v as (select vec_id, label from embeddings) select label, count(*) as n, round(avg(q.y), 6) as mean_y from v join p q on q.row_id = v.vec_id group by 1")
def label_alignment(t):
    v = t.embeddings.select(F.col("vec_id").alias("row_id"), "label")
    return v.join(predictions(t).select("row_id", "y"), "row_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))



QUERIES, SQL = R.queries, R.sql
