"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are cut into buckets of similar length by sampled splitters on
(length, id), so ties in length never make a bucket grow.  Queries first meet
the bucket of longest vectors, which gives each a lower bound on its k-th best
score.  For every other bucket that bound, divided by the lengths, is a local
cosine threshold: above 1 the bucket is skipped for that query; if it is high
a coordinate bound on the query's strongest component selects candidates; if
it is low a length bound does.  What is left is verified by exact products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import task_count
from factlake.session import cut_lineage

OUT = "query_id long, vec_id long, score long"
HIGH_COSINE = 0.7       # local threshold from which the coordinate bound is used
EXACT_FLOAT = 2 ** 20   # components up to this size have exact float64 products


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(vec_id, v array<bigint>, dim, norm)`` of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite)
    v = v.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    return v.select("vec_id", "v", F.size("v").alias("dim"),
                    F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products, through float64 where that is exact."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores, ids, k):
    """Indices of the k best of one query: score descending, id ascending."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_bucket(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of bucket ``c`` for each query of block ``q``."""
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    c = c.drop_duplicates("vec_id").sort_values("norm", ascending=False)
    cv = np.array(c["v"].tolist(), dtype=np.int64).reshape(len(c), -1)
    cn, cid = c["norm"].to_numpy(), c["vec_id"].to_numpy()
    qv = np.array(q["v"].tolist(), dtype=np.int64).reshape(len(q), -1)
    qn, qid, bound = q["norm"].to_numpy(), q["vec_id"].to_numpy(), q["bound"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(bound > 0, bound / (qn * cn[0]), -1.0)    # of a vector as long as the longest here
        cosine = np.where((bound > 0) & (qn * cn[0] == 0), 2.0, cosine)
        unit = cv / np.where(cn > 0, cn, 1)[:, None]
    parts = []

    def verified(i, at, scores):
        keep = cid[at] != qid[i]
        at, scores = at[keep], scores[keep]
        b = _best(scores, cid[at], k)
        parts.append((np.full(len(b), qid[i]), cid[at[b]], scores[b]))

    slack = 1e-9
    for i in np.flatnonzero((cosine >= HIGH_COSINE) & (cosine <= 1 + slack)):
        # coordinate bound: with t = cos threshold and f the strongest component,
        # |c_f - t q_f| <= sqrt((1 - t^2)(1 - q_f^2)) on unit vectors, from t up to 1
        u = qv[i] / qn[i]
        f = int(np.argmax(np.abs(u)))
        t = np.minimum(bound[i] / (qn[i] * np.where(cn > 0, cn, np.inf)), 2.0)
        span = np.sqrt(np.maximum(1 - np.minimum(t, 1) ** 2, 0) * max(1 - u[f] ** 2, 0))
        low, sign = t * abs(u[f]) - span, np.sign(u[f])
        at = np.flatnonzero((t <= 1 + slack) & (unit[:, f] * sign >= low - slack))
        if len(at):
            verified(i, at, _products(qv[i:i + 1], cv[at])[0])
    plain = np.flatnonzero(cosine < HIGH_COSINE)
    for s in range(0, len(plain), 128):
        block = plain[s:s + 128]
        least = np.where(bound[block] > 0, bound[block] / np.maximum(qn[block], 1e-300), 0)
        n = int(np.searchsorted(-cn, -(least.min() * (1 - slack)), side="right"))   # length bound
        scores = _products(qv[block], cv[:n])
        for j, i in enumerate(block):
            verified(i, np.arange(n), scores[j])
    if not parts:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    a, b, s = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, bucket_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k largest integer products.

    Queries are the rows whose id ``query_every`` divides; candidates are all
    rows with another id and the same number of components.  Null vectors,
    vectors with a null, NaN or infinite component, and null ids take no part.
    Rows that repeat an id count once.  Ties go to the smaller id; fewer than
    k candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    v = quantised(vectors, id_col, vec_col, scale)
    n = v.count()
    buckets = task_count(spark, n, bucket_rows)
    c = cut_lineage(v.repartitionByRange(buckets, "dim", F.col("norm").desc(), "vec_id")
                     .withColumn("bucket", F.spark_partition_id()))
    # the longest vectors of each dimension open its run of buckets
    first = c.groupBy("dim").agg(F.min("bucket").alias("first_bucket"))
    q = c.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"])
    blocks = task_count(spark, max(1, n // query_every), query_rows)
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).drop("bucket")
    q = q.join(first, "dim")
    cand = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    keys = ["dim", "bucket", "block"]

    def run(queries, candidates):
        candidates = candidates.select(*[F.col(x).alias(x) for x in (*keys, "vec_id", "v", "norm")])
        return (queries.groupBy(*keys).cogroup(candidates.groupBy(*keys))
                .applyInPandas(lambda a, b: search_bucket(a, b, k), OUT))

    opening = q.withColumn("bucket", F.col("first_bucket")).withColumn("bound", F.lit(0.0))
    found = cut_lineage(run(opening, cand.join(first, "dim").where("bucket = first_bucket").drop("first_bucket")))
    bound = (found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
                  .select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).cast("double").alias("bound")))
    # a bucket is worth a visit when its longest vector can still reach the bound
    stats = c.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"))
    rest = (q.join(bound, "vec_id", "left").fillna(0.0, ["bound"])
             .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
             .where("bucket <> first_bucket").join(stats, ["dim", "bucket"])
             .where("bound <= norm * longest * (1 + 1e-9)").drop("longest"))
    more = run(rest, cand.join(first, "dim").where("bucket <> first_bucket").drop("first_bucket"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.unionAll(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
