"""Embeddings: similarity, nearest neighbours, prompt sets, element-wise means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.session import write_scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector divided by its length; null for a zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, vec_id, similarity, place: the ``k`` most similar corpus vectors of each query (cosine, ties by id).

    queries: query_id, v; corpus: vec_id, v (unit vectors). The query set goes to the
    executors in blocks of about ``block`` vectors; the driver holds one block at a time.
    Each corpus partition keeps its k best per query, so what is shuffled is k rows per query
    and partition. A query is not its own neighbour.
    """
    queries = queries.where("v is not null").select("query_id", "v")
    spark, found = corpus.sparkSession, None
    blocks = max(1, -(-queries.count() // block))
    for at in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)
        held = spark.sparkContext.broadcast([(r.query_id, list(r.v)) for r in part.collect()])

        def search(batches, held=held):
            import numpy as np
            import pandas as pd

            if not held.value:
                return
            ids = np.array([q for q, _ in held.value], dtype=np.int64)
            matrix = np.array([v for _, v in held.value], dtype=np.float64).reshape(len(ids), -1)
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf):
                    continue
                vec = pdf["vec_id"].to_numpy()
                sim = np.round(matrix @ np.stack(pdf["v"].to_numpy()).astype(np.float64).T, 9)
                for i in range(len(ids)):
                    keep = np.lexsort((vec, -sim[i]))[: k + 1]
                    best[i] = sorted([*best[i], *((-sim[i, j], int(vec[j])) for j in keep if vec[j] != ids[i])])[:k]
            yield pd.DataFrame([(q, v, -s) for q, b in zip(ids, best) for s, v in b], columns=["query_id", "vec_id", "similarity"])

        one = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInPandas(search, "query_id long, vec_id long, similarity double")
        if blocks > 1:
            # Each block is searched and written before the next one is fetched.
            one = write_scratch(one, "nearest")
            held.destroy()
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mean_vector(df: DataFrame, groups: list[str], v: str) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    cells = df.select(*groups, F.posexplode(v).alias("pos", "x")).groupBy(*groups, "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def softmax(scores: DataFrame, group: str, score: str, temperature: float) -> DataFrame:
    """Probability of each option of a group."""
    w = Window.partitionBy(group)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return scores.withColumn("probability", e / F.sum(e).over(w))


def softmax_array(df: DataFrame, scores: str, temperature: float) -> DataFrame:
    """A row per option of ``scores`` (array of grade, score), with its probability; within the row, without a shuffle."""
    others = [c for c in df.columns if c != scores]
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    e = df.withColumn("_top", top).withColumn("_e", F.transform(scores, lambda s: F.struct(s["grade"].alias("grade"), F.exp((s["score"] - F.col("_top")) / temperature).alias("e"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, s: a + s["e"])
    return e.select(*others, total.alias("_total"), F.explode("_e").alias("_s")).select(*others, "_s.grade", (F.col("_s.e") / F.col("_total")).alias("probability"))


def share_median(rows: DataFrame, prompts: DataFrame, share: float) -> DataFrame:
    """vec_id, lower_median: lower median of the labels of the ``share`` of ``prompts`` most similar to each row (cosine, ties by id).

    rows: vec_id, v; prompts: vec_id, label, v (unit vectors), a set of bounded size that goes to every executor.
    """
    held = sorted((r.vec_id, r.label, list(r.v)) for r in prompts.select("vec_id", "label", "v").collect())
    k = kept(len(held), share)

    def estimate(batches):
        import numpy as np
        import pandas as pd

        matrix, labels = np.array([v for _, _, v in held], dtype=np.float64), np.array([x for _, x, _ in held])
        for pdf in batches:
            if not len(pdf) or not len(held):
                continue
            sim = np.round(np.stack(pdf["v"].to_numpy()).astype(np.float64) @ matrix.T, 9)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # prompts are in order of their ids
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "lower_median": np.sort(labels[best], axis=1)[:, (k - 1) // 2]})

    kinds = dict(rows.dtypes) | {"label": dict(prompts.dtypes)["label"]}
    return rows.select("vec_id", "v").mapInPandas(estimate, f"vec_id {kinds['vec_id']}, lower_median {kinds['label']}")


def lower_median(values: Column) -> Column:
    """Middle of a sorted array, the lower one of two."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int"))


def kept(n: int, share: float) -> int:
    """How many of ``n`` a share keeps: the nearest number, at least 1."""
    return max(1, round(n * share))
