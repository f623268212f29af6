"""Splits that keep related records together (problem 4).

Patients tied by a study form components. The component table (patient -> component,
split, rows) and its study table (study -> component, split, rows) are Parquet tables that
outlive the run: a later batch adds its ties to them, also those through studies of earlier
batches, components that exist keep their split, new ones fill what each split still lacks
of all rows, and a merge of components with different splits is quarantined instead of guessed.

Ties are stars, one edge from every patient of a study to its least patient. Components
come from hooking each root to its least neighbour, pointer jumping until every pointer
is a root, and contraction of the edges to the roots, repeated until no edge is left.
Each round is written to the shared folder, so the plan stays short and a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.ids import patient_key, study_key
from sonoloom.functions.skew import hot_keys, salted_join
from sonoloom.session import drop_scratch, write_scratch

SHARES = {"train": 0.7, "val": 0.1, "test": 0.2}
QUARANTINE = "quarantine"
BUCKETS = 1024


def _lookup(rows: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Left join of ``table`` (key -> value) on ``column``, salted for hot values; misses keep the key itself."""
    small = table.select(F.col(key).alias(column), F.col(value).alias("_found"))
    got = salted_join(rows, small, column, hot_keys(rows, column), F.struct(*rows.columns), "left")
    return got.withColumn(out, F.coalesce("_found", column)).drop("_found")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node with an edge. edges: a, b; null ends and loops tie nothing."""
    spark = edges.sparkSession
    open_edges = write_scratch(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not open_edges.isEmpty():
        both = open_edges.unionByName(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parents = write_scratch(hooked.select("node", F.least("node", "least").alias("root")), "parents")
        moved = True
        while moved:
            up = _lookup(parents, "root", parents.select(F.col("node").alias("n"), F.col("root").alias("r")), "n", "r", "next")
            jumped = write_scratch(up.select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            drop_scratch(parents)
            parents = jumped.select("node", "root")
            parents._scratch_path = jumped._scratch_path
        roots = parents.select(F.col("node").alias("n"), F.col("root").alias("r"))
        if labels is not None:
            raised = write_scratch(_lookup(labels, "root", roots, "n", "r", "up").select("node", F.col("up").alias("root")), "labels")
            drop_scratch(labels)
            labels = raised
        left = _lookup(open_edges, "a", roots, "n", "r", "ra").select("ra", "b")
        right = _lookup(left, "b", roots, "n", "r", "rb").where("ra <> rb")
        contracted = write_scratch(right.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_scratch(open_edges)
        open_edges = contracted
        if labels is None:
            labels = parents
        else:
            drop_scratch(parents)
    drop_scratch(open_edges)
    return labels if labels is not None else spark.createDataFrame([], "node string, root string")


def study_ties(rows: DataFrame) -> DataFrame:
    """a, b: star edges from the least patient of a study to its others. rows: patient, study (normalised)."""
    pairs = write_scratch(rows.where("patient is not null and study is not null").select("study", "patient").distinct(), "pairs")
    least = pairs.groupBy("study").agg(F.min("patient").alias("a"), F.max("patient").alias("hi")).where("a < hi").select("study", "a")
    tied = pairs.join(least.select("study"), "study", "left_semi")
    return salted_join(tied, least, "study", hot_keys(tied, "study"), F.col("patient")).where("a <> patient").select("a", F.col("patient").alias("b"))


def normalised_rows(manifests: DataFrame, row_id: str = "row_id") -> DataFrame:
    """row_id, patient, study: ids that name nothing are null."""
    return manifests.select(F.col(row_id).alias("row_id"), patient_key(F.col("patient_id")).alias("patient"), study_key(F.col("study_id")).alias("study"))


def component_table(rows: DataFrame) -> DataFrame:
    """patient, component of all patients of ``rows`` that are tied to another patient."""
    return components(study_ties(rows)).select(F.col("node").alias("patient"), F.col("root").alias("component"))


def tied_patients(rows: DataFrame) -> DataFrame:
    """patient_a < patient_b (as text): patients that a chain of rows ties together."""
    t = component_table(rows)
    hot = hot_keys(t, "component")
    a = t.select("component", F.col("patient").alias("patient_a"))
    b = t.select("component", F.col("patient").alias("patient_b"))
    return salted_join(a, b, "component", hot, F.col("patient_a")).where("patient_a < patient_b").select("patient_a", "patient_b")


# ---- assignment ------------------------------------------------------------------


def fill_plan(sizes: list[tuple[int, int]], held: dict[str, int], shares: dict[str, float]) -> list[tuple[int, dict[str, int]]]:
    """For each component size, largest first, how many components go to each split.

    Every component goes to the split that lacks most rows at that moment; many components
    of one size are handed out at once by levelling the lacks.
    """
    total = sum(s * n for s, n in sizes) + sum(held.values())
    names = list(shares)
    lack = {k: shares[k] * total - held.get(k, 0) for k in names}
    plan = []
    for size, n in sorted(sizes, reverse=True):
        given = dict.fromkeys(names, 0)
        # Levels down to which the lacks are filled: the least that gives no more than n in all; the few left go one by one.
        lo, hi = min(lack.values()) - size * (n + 1), max(lack.values())
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(max(0, int((lack[k] - mid) // size)) for k in names) > n:
                lo = mid
            else:
                hi = mid
        for k in names:
            given[k] = max(0, int((lack[k] - hi) // size))
            lack[k] -= given[k] * size
        for _ in range(n - sum(given.values())):
            k = max(names, key=lambda x: lack[x])
            given[k] += 1
            lack[k] -= size
        plan.append((size, given))
    return plan


def split_batch(
    manifests: DataFrame, known: DataFrame | None = None, studies: DataFrame | None = None, shares: dict[str, float] | None = None, row_id: str = "row_id", seed: str = "split"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignment, table, studies): row_id, component, split of every row; and the two tables for the next run.

    table: patient, component, split, n (rows so far). studies: study, component (``p:`` and
    its least patient, or ``s:`` and the study if no patient is known), split, n (rows so far
    without a patient); its rows without a study count the rows that had no id at all.

    Defined cases: a row without a patient goes with its study, and with that study's
    patients if it has any, of this batch or an earlier one; a row without either stands
    alone; repeated rows share a split; an empty table gives empty results. A component
    whose known members have different splits gets the split ``quarantine`` until someone
    decides (in ``table``; a study with patients follows them). New components fill what each
    split lacks of all rows so far. Extra columns are ignored. The driver takes one row per
    distinct component size (at most the square root of twice the rows).
    """
    spark = manifests.sparkSession
    shares = shares or SHARES
    # Ids with a prefix, so that patients, studies and lone rows cannot meet by accident.
    rows = write_scratch(normalised_rows(manifests, row_id), "rows")
    p, s = (lambda c: F.concat(F.lit("p:"), c)), (lambda c: F.concat(F.lit("s:"), c))
    edges = study_ties(rows).select(p("a").alias("a"), p("b").alias("b"))
    named = rows.where("study is not null").groupBy("study").agg(F.min("patient").alias("owner"), F.count_if(F.col("patient").isNull()).alias("n"))
    named = named.select("study", p("owner").alias("owner"), "n", F.lit(None).cast("string").alias("was"))
    if known is not None:
        known = known.select("patient", "component", "split", F.col("n") if "n" in known.columns else F.lit(0).cast("long").alias("n"))
        edges = edges.unionByName(known.where("patient <> component").select(p("component").alias("a"), p("patient").alias("b")))
    if studies is not None:
        named = named.drop("was").join(studies.where("study is not null").select("study", F.col("component").alias("was")), "study", "left")
        edges = edges.unionByName(named.where("owner <> was").select(F.col("was").alias("a"), F.col("owner").alias("b")))
    tied = components(edges)
    blank = F.lit(None).cast("string").alias("split")
    placed_at = rows.where("patient is not null").groupBy("patient").agg(F.count("*").alias("n")).select(p("patient").alias("key"), p("patient").alias("at"), "n", blank)
    placed_at = placed_at.unionByName(named.select(s("study").alias("key"), F.coalesce("owner", "was", s("study")).alias("at"), "n", blank))
    if known is not None:
        placed_at = placed_at.unionByName(known.select(p("patient").alias("key"), p("patient").alias("at"), "n", "split"))
    if studies is not None:
        own = F.when(F.col("component").startswith("s:"), F.col("split")).alias("split")
        placed_at = placed_at.unionByName(studies.where("study is not null").select(s("study").alias("key"), F.col("component").alias("at"), "n", own))
    keys = _lookup(placed_at, "at", tied, "node", "root", "component").select("key", "component", "n", "split")
    if known is not None or studies is not None:
        keys = keys.groupBy("key").agg(F.min("component").alias("component"), F.sum("n").alias("n"), F.min("split").alias("split"))
    single = F.concat(F.lit("r:"), F.col("row_id").cast("string"))
    lone = rows.where("patient is null and study is null").select(single.alias("key"), single.alias("component"), F.lit(1).cast("long").alias("n"), blank)
    keys = write_scratch(keys.unionByName(lone), "keys")
    sizes = keys.groupBy("component").agg(F.sum("n").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    state = sizes.select("component", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), QUARANTINE).alias("kept"))
    state = write_scratch(state, "sizes")
    held = {r.kept: r.n for r in state.where("kept is not null").groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    unnamed = studies.where("study is null").select("study", "component", "split", "n") if studies is not None else None
    for r in unnamed.groupBy("split").agg(F.sum("n").alias("n")).collect() if unnamed is not None else []:
        held[r.split] = held.get(r.split, 0) + r.n
    new = state.where("kept is null")
    counts = [(r.n, r.c) for r in new.groupBy("n").agg(F.count("*").alias("c")).collect()]
    plan = fill_plan(counts, {k: v for k, v in held.items() if k in shares}, shares)
    names = list(shares)
    limits, schema = [], "n long, upto array<long>"
    for size, given in plan:
        upto, acc = [], 0
        for k in names:
            acc += given[k]
            upto.append(acc)
        limits.append((size, upto))
    order = F.xxhash64(F.lit(seed), F.col("component"))
    spread = new.withColumn("bucket", F.pmod(order, F.lit(BUCKETS))).withColumn("h", order)
    offsets = spread.groupBy("n", "bucket").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("n", "bucket").orderBy("h", "component"))).join(offsets.select("n", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["n", "bucket"])
    ranked = ranked.join(spark.createDataFrame(limits, schema), "n").withColumn("rank", F.col("before") + F.col("r"))
    pick = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        pick = F.when(F.col("rank") <= F.col("upto")[k], F.lit(names[k])).otherwise(pick)
    decided = write_scratch(state.where("kept is not null").select("component", F.col("kept").alias("split")).unionByName(ranked.select("component", pick.alias("split"))), "splits")
    placed = write_scratch(keys.drop("split").join(decided, "component").select("key", "component", "split", "n"), "placed")
    keyed = rows.select("row_id", F.coalesce(F.concat(F.lit("p:"), "patient"), F.concat(F.lit("s:"), "study"), F.concat(F.lit("r:"), F.col("row_id").cast("string"))).alias("key"))
    out = salted_join(keyed, placed.drop("n"), "key", hot_keys(keyed, "key"), F.col("row_id")).select("row_id", "component", "split")
    table = placed.where(F.col("key").startswith("p:")).select(F.substring("key", 3, 1 << 20).alias("patient"), F.substring("component", 3, 1 << 20).alias("component"), "split", "n")
    seen = placed.where(F.col("key").startswith("s:")).select(F.substring("key", 3, 1 << 20).alias("study"), "component", "split", "n")
    none = F.lit(None).cast("string")
    counted = placed.where(F.col("key").startswith("r:")).select(none.alias("study"), none.alias("component"), "split", "n")
    if unnamed is not None:
        counted = counted.unionByName(unnamed)
    return out, table, seen.unionByName(counted.groupBy("study", "component", "split").agg(F.sum("n").alias("n")))


def split_rows(
    manifests: DataFrame, known: DataFrame | None = None, shares: dict[str, float] | None = None, row_id: str = "row_id", seed: str = "split", studies: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Assignment and patient table of :func:`split_batch`; a later batch needs the study table too, so use that or :func:`update_split_table`."""
    return split_batch(manifests, known, studies, shares, row_id, seed)[:2]


def incremental_splits(manifests: DataFrame, batches: Column, n_batches: int, path: str, shares: dict[str, float] | None = None) -> DataFrame:
    """row_id, batch, component, split: ``manifests`` fed to the table under ``path`` in ``n_batches`` batches by the number in ``batches`` (0 and up).

    The split given is the one a row has after the last batch: a row of an earlier batch
    whose component was quarantined by a later merge is in quarantine too.
    """
    named = manifests.select("row_id", patient_key(F.col("patient_id")).alias("patient_id"), study_key(F.col("study_id")).alias("study_id"), batches.alias("batch"))
    rows = write_scratch(named, "batches")
    done = None
    for k in range(n_batches):
        out = update_split_table(rows.where(F.col("batch") == k), path, shares)
        lone = out.where(F.col("component").startswith("r:")).select("row_id", "component", "split")
        done = lone if done is None else done.unionByName(lone)
    table, studies = latest_tables(rows.sparkSession, path)
    people = table.select(F.col("patient").alias("patient_id"), F.concat(F.lit("p:"), "component").alias("component"), "split")
    owned = studies.where("study is not null").select(F.col("study").alias("study_id"), F.col("component").alias("at"), F.col("split").alias("own"))
    with_patient = rows.where("patient_id is not null").select("row_id", "batch", "patient_id")
    a = salted_join(with_patient, people, "patient_id", hot_keys(with_patient, "patient_id"), F.col("row_id")).select("row_id", "batch", "component", "split")
    b = rows.where("patient_id is null and study_id is not null").join(owned, "study_id").select("row_id", "batch", F.col("at").alias("component"), F.col("own").alias("split"))
    c = rows.where("patient_id is null and study_id is null").join(done, "row_id").select("row_id", "batch", "component", "split")
    return a.unionByName(b).unionByName(c)


def latest_tables(spark, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Patient and study table of the last whole version under ``path``; None where there is none."""
    last = _last_version(spark, path)
    if not last:
        return None, None
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/studies/v={last}/_SUCCESS")
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    # Versions written before there was a study table have none.
    return spark.read.parquet(f"{path}/v={last}"), spark.read.parquet(f"{path}/studies/v={last}") if there else None


def _last_version(spark, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    done = [s.getPath().getParent().getName() for s in (p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])]
    return max((int(d.split("=")[1]) for d in done), default=0)


def component_sizes(rows: DataFrame) -> DataFrame:
    """component, n_patients, n_studies (that tie), n_links (distinct patient and study pairs in it): the classes of :func:`tied_patients` without its pairs."""
    table = component_table(rows)
    pairs = rows.where("patient is not null and study is not null").select("patient", "study").distinct()
    linked = salted_join(pairs, table, "patient", hot_keys(pairs, "patient"), F.col("study"))
    per_study = linked.groupBy("component", "study").agg(F.count("*").alias("n"))
    links = per_study.groupBy("component").agg(F.count_if(F.col("n") > 1).alias("n_studies"), F.sum("n").alias("n_links"))
    return table.groupBy("component").agg(F.count("*").alias("n_patients")).join(links, "component")


def update_split_table(manifests: DataFrame, path: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Assignment of a batch with the component table kept under ``path``, one folder per version, its study table under ``path``/studies.

    The last version is read, the batch is merged into it and the next version is written
    before the assignment is returned; a run that dies leaves the last version as it was.
    """
    spark = manifests.sparkSession
    last = _last_version(spark, path)
    known, known_studies = latest_tables(spark, path)
    out, table, studies = split_batch(manifests, known, known_studies, shares)
    studies.write.mode("overwrite").parquet(f"{path}/studies/v={last + 1}")
    table.write.mode("overwrite").parquet(f"{path}/v={last + 1}")
    return out
