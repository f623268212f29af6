"""Samples, bags, batches and frame indices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_int_sql, hash_unit, hash_unit_sql
from sonoloom.operators import sampling
from sonoloom.plans.common import M, P, manifest, predictions
from sonoloom.plans.registry import Registry

R = Registry()


@R.add(f"""with {M}, r as (select row_id, site, exam, row_number() over (partition by site, exam order by {hash_int_sql('strat', 'row_id')}, row_id) as draw, count(*) over (partition by site, exam) as stratum_size from m)
select row_id, site, exam, draw, round(least(1.0, 5.0 / stratum_size), 9) as inclusion from r where draw <= 5""")
def sample_stratified(t):
    s = sampling.stratified(manifest(t).select("row_id", "site", "exam"), ["site", "exam"], 5, "strat", "row_id")
    return s.select("row_id", "site", "exam", "draw", F.round("inclusion", 9).alias("inclusion"))


@R.add(f"""with {M}, x as (select row_id, patient from m where patient is not null), c as (select patient, count(*) as size from x group by 1),
d as (select *, row_number() over (order by {hash_int_sql('two-cluster', 'patient')}, patient) as cr, count(*) over () as nc from c),
i as (select x.*, d.size, d.nc, row_number() over (partition by x.patient order by {hash_int_sql('two-item', 'row_id')}, row_id) as ir from x join d using (patient) where cr <= 50)
select row_id, patient, round(least(1.0, 50.0 / nc) * least(2, size) / size, 9) as inclusion from i where ir <= 2""")
def sample_two_stage(t):
    s = sampling.two_stage(manifest(t).where("patient is not null").select("row_id", "patient"), "patient", "row_id", 50, 2, "two")
    return s.select("row_id", "patient", F.round("inclusion", 9).alias("inclusion"))


@R.add(f"""with {M}, x as (select row_id, patient, site, view from m where patient is not null), s as (select * from x where {hash_unit_sql('taken', 'row_id')} < 0.05),
r as (select row_id, site, view, row_number() over (partition by site, view order by {hash_int_sql('ref', 'row_id')}, row_id) as draw from x where patient not in (select patient from s) and (site, view) in (select (site, view) from s))
select * from r where draw <= 3""")
def sample_reference_anti(t):
    x = manifest(t).where("patient is not null and site is not null").select("row_id", "patient", "site", "view")
    s = x.where(hash_unit("taken", F.col("row_id")) < 0.05)
    return sampling.reference_sample(x, s, "patient", ["site", "view"], 3, "ref", "row_id").select("row_id", "site", "view", "draw")


@R.add(f"""with w as (select site, count(*)::double as weight from build_manifests group by 1), c as (select site, sum(weight) over (order by site) as hi, sum(weight) over (order by site) - weight as lo, sum(weight) over () as total from w),
d as (select range as draw, {hash_unit_sql('draws', 'range')} as u from range(1000))
select d.draw, c.site from d join c on d.u * c.total >= c.lo and d.u * c.total < c.hi""")
def sample_weighted(t):
    w = t.build_manifests.groupBy("site").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return sampling.weighted_draws(w, "site", "weight", 1000, "draws", t.spark.range)


@R.add(f"""with r as (select doc_id, source, doc_type, row_number() over (partition by source, doc_type order by {hash_int_sql('quota', 'source', 'doc_id')}, doc_id) as turn from documents),
s as (select *, row_number() over (partition by source order by turn, {hash_int_sql('quota', 'source', 'doc_type')}, doc_type) as slot from r)
select doc_id, source, doc_type, turn, slot from s where slot <= 12""")
def sample_quota_round_robin(t):
    return sampling.round_robin(t.documents.select("doc_id", "source", "doc_type"), "source", "doc_type", "doc_id", 12, "quota").select("doc_id", "source", "doc_type", F.col("turn").cast("long"), F.col("slot").cast("long"))


@R.add(f"""with r as (select o_orderkey, row_number() over (order by {hash_int_sql('perm', 'o_orderkey')}, o_orderkey) - 1 as pos, count(*) over () as n from orders)
select o_orderkey, pos // 64 as batch, (pos % 64) // 16 as rank_of_world from r where pos < n // 64 * 64""")
def shuffle_batches(t):
    return sampling.batches(t.orders, "o_orderkey", 64, 4, "perm")


@R.add(f"select {hash_int_sql('shard', 'o_orderkey')} % 16 as shard, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def hash_shards(t):
    return t.orders.groupBy(sampling.shards(t.orders, "o_orderkey", 16, "shard").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


_FAMILY = "split_part(view, '_', 1)"
_BAG = f"""r as (select study, row_id, view, {_FAMILY} as family, row_number() over (partition by study, {_FAMILY} order by {hash_int_sql('bag', 'study', 'row_id')}, row_id) as turn from m where study is not null),
b as (select *, row_number() over (partition by study order by turn, {hash_int_sql('bag', 'study', 'family')}, family) as slot from r)"""


def _bag(t, slots, tier=None):
    m = manifest(t).where("study is not null").select("study", "row_id", "view", F.split_part("view", F.lit("_"), F.lit(1)).alias("family"))
    return sampling.round_robin(m, "study", "family", "row_id", slots, "bag", tier)


@R.add(f"with {M}, {_BAG} select study, row_id, family, slot from b where slot <= 4")
def round_robin_bag(t):
    return _bag(t, 4).select("study", "row_id", "family", F.col("slot").cast("long"))


@R.add(f"with {M}, {_BAG} select study, array_to_string(list_resize(list(row_id::varchar order by slot), 6, '-1'), ',') as clips, count(*) as n_real from b where slot <= 6 group by 1")
def bag_padding(t):
    g = _bag(t, 6).groupBy("study").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "row_id"))), lambda x: x["row_id"].cast("string")).alias("ids"))
    clips, mask = sampling.padded(F.col("ids"), 6)
    return g.select("study", F.array_join(clips, ",", "-1").alias("clips"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"))


@R.add(f"""with {M}, {_BAG.replace('order by turn,', "order by case when family in ('OTHER', 'SUBCOSTAL') then 1 else 0 end, turn,")} select study, row_id, family, slot from b where slot <= 3""")
def filler_tier_bag(t):
    return _bag(t, 3, F.expr("case when family in ('OTHER', 'SUBCOSTAL') then 1 else 0 end")).select("study", "row_id", "family", F.col("slot").cast("long"))


@R.add(f"""with {M} select patient, study, row_id from (select *, row_number() over (partition by patient order by (status = 'success')::int desc, {hash_int_sql('prio', 'row_id')}, row_id) as k from m where patient is not null and study is not null) where k = 1""")
def priority_pick(t):
    m = manifest(t).where("patient is not null and study is not null")
    order = [F.expr("status = 'success'").cast("int").desc(), hash_int("prio", F.col("row_id")), F.col("row_id")]
    return sampling.top_k(m, ["patient"], order, 1).select("patient", "study", "row_id")


@R.add(f"with {P} select view, row_id, prob, place from (select *, row_number() over (partition by view order by prob desc, row_id) as place from p) where place <= 3")
def top_k_per_group(t):
    return sampling.top_k(predictions(t), ["view"], [F.col("prob").desc(), F.col("row_id")], 3).select("view", "row_id", "prob", F.col("place").cast("long"))


@R.add(f"with x as (select c_custkey, ntile(8) over (order by {hash_int_sql('chunk', 'c_custkey')}, c_custkey) as chunk from customer) select chunk::bigint as chunk, count(*) as n, sum(c_custkey)::bigint as keys from x group by 1")
def near_equal_chunks(t):
    from sonoloom.functions.ranks import rank_by_hash

    n = t.customer.count()
    big, size = n % 8, n // 8
    r = rank_by_hash(t.customer.select("c_custkey"), hash_int("chunk", F.col("c_custkey")), ["c_custkey"]).withColumn("at", F.col("rank") - 1)
    head = big * (size + 1)
    chunk = F.when(F.col("at") < head, F.floor(F.col("at") / (size + 1))).otherwise(F.lit(big) + F.floor((F.col("at") - head) / max(size, 1))) + 1
    return r.groupBy(chunk.cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


_STEP = "greatest(coalesce(ceil(fps)::bigint // 8, 1), 1)"


@R.add(f"select row_id, n_frames is not null and n_frames < 16 * {_STEP} as needs_padding, {_STEP} as step from build_manifests")
def needs_padding(t):
    step = F.greatest(F.coalesce(F.floor(F.ceil("fps") / 8), F.lit(1)), F.lit(1)).cast("long")
    return t.build_manifests.select("row_id", (F.col("n_frames").isNotNull() & (F.coalesce("n_frames", F.lit(0)) < 16 * step)).alias("needs_padding"), step.alias("step"))


@R.add("select row_id, array_to_string(list_transform(range(16), lambda i: case when n_frames >= 16 then (i * n_frames) // 16 when i < n_frames then i else -1 end), ',') as frames from build_manifests where n_frames is not null")
def frame_indices(t):
    n = F.col("n_frames")
    idx = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(n >= 16, F.floor(i * n / 16).cast("long")).when(i < n, i.cast("long")).otherwise(F.lit(-1).cast("long")))
    return t.build_manifests.where("n_frames is not null").select("row_id", F.array_join(F.transform(idx, lambda x: x.cast("string")), ",").alias("frames"))


@R.add("""select vec_id, k::bigint as clip, round(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: x::double)), 5) as total from embeddings, range(4) r(k)""")
def array_chunks(t):
    clips = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.cast("long").alias("clip"), F.slice("embedding", k * 16 + 1, 16).alias("v")))
    e = t.embeddings.select("vec_id", F.inline(clips))
    return e.select("vec_id", "clip", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@R.add("select vec_id, array_to_string(list_filter(range(16), lambda i: i not in (vec_id % 16, (vec_id * 7) % 16)), ',') as visible from embeddings")
def mask_complement(t):
    hidden = F.array((F.col("vec_id") % 16).cast("int"), (F.col("vec_id") * 7 % 16).cast("int"))
    return t.embeddings.select("vec_id", F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.lit(15)), hidden), lambda x: x.cast("string")), ",").alias("visible"))


@R.add("select vec_id, round(embedding[1 + vec_id % 64]::double, 6) as picked, round(embedding[64 - vec_id % 64]::double, 6) as mirrored from embeddings")
def array_index_gather(t):
    pick = lambda i: F.round(F.element_at("embedding", i.cast("int")).cast("double"), 6)
    return t.embeddings.select("vec_id", pick(1 + F.col("vec_id") % 64).alias("picked"), pick(64 - F.col("vec_id") % 64).alias("mirrored"))


@R.add("""select range as step, round(case when range < 100 then 1e-5 + (1e-3 - 1e-5) * range / 100 else 1e-6 + (1e-3 - 1e-6) * 0.5 * (1 + cos(pi() * (range - 100) / 900)) end, 12) as lr,
  round(case when range < 100 then 1e-3 * range / 100 when range < 800 then 1e-3 else 1e-3 * (1 - (range - 800) / 200.0) end, 12) as stable_decay from range(1000)""")
def step_schedules(t):
    s = F.col("id").cast("double")
    cosine = F.when(s < 100, 1e-5 + (1e-3 - 1e-5) * s / 100).otherwise(1e-6 + (1e-3 - 1e-6) * 0.5 * (1 + F.cos(F.pi() * (s - 100) / 900)))
    wsd = F.when(s < 100, 1e-3 * s / 100).when(s < 800, 1e-3).otherwise(1e-3 * (1 - (s - 800) / 200.0))
    return t.spark.range(1000).select(F.col("id").alias("step"), F.round(cosine, 12).alias("lr"), F.round(wsd, 12).alias("stable_decay"))


@R.add("""select f.view, b.lr, s.seed from (values ('low'), ('high')) b(lr), (values (0), (1), (2)) s(seed), (select distinct coalesce(view_class, 'OTHER') as view from build_manifests) f""")
def factor_grid(t):
    views = manifest(t).select("view").distinct()
    grid = F.explode(F.array(*[F.struct(F.lit(lr).alias("lr"), F.lit(s).alias("seed")) for lr in ("low", "high") for s in (0, 1, 2)]))
    return views.select("view", grid.alias("g")).select("view", "g.lr", "g.seed")


@R.add(f"""with {M}, c as (select exam, count(*) as n from m group by 1), w as (select exam, n, sum(n) over (order by n desc, exam rows unbounded preceding) - n as before, sum(n) over () as total from c)
select exam, n, before < 0.8 * total as common from w""")
def cumulative_share_label(t):
    c = manifest(t).groupBy("exam").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy().orderBy(F.col("n").desc(), "exam").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = c.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return w.select("exam", "n", (F.col("before") < 0.8 * F.col("total")).alias("common"))


QUERIES, SQL = R.queries, R.sql
