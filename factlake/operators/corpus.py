"""Corpus layout helpers: documents co-partitioned by ``doc_id``.

Every per-document operator below aggregates on keys that start with
``doc_id`` (``(doc_id, sid, term)``, ``(doc_id, term)``, ...).  Hash
partitioning the *documents* once on ``doc_id`` satisfies all of those
distributions, so after one shuffle of the raw text every later aggregate,
join and window of the operator runs without another exchange.  A single
document is one input row, so a partition never holds more of one key than
one row already did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import text as T


def by_doc(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition on the document key into ``spark.sql.shuffle.partitions``
    parts.  The count is explicit so that adaptive coalescing does not fold
    the CPU-heavy text work (regex, tokenising) into a few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


def spread(df: DataFrame) -> DataFrame:
    """Parallelism guard for CPU-heavy row-level work: when the scan yields
    fewer partitions than the cluster has cores (one small file, one row
    group), spread the rows round-robin; otherwise (large inputs, many file
    splits) leave the plan as it is, with no shuffle."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


def sentence_table(docs: DataFrame, text_col: str = "text", key: str = "doc_id",
                   partitioned: bool = True) -> DataFrame:
    """X07 long form ``<key, n_sent, sid, sentence>``; ``sid`` is 0-based."""
    d = by_doc(docs.select(key, text_col), key) if partitioned else docs.select(key, text_col)
    d = d.select(key, T.sentences(text_col).alias("_s"))
    # posexplode_outer: same rows (a split has at least one element) and no
    # inferred filter below the shuffle, so every branch that reads the
    # sentence table reuses one document exchange
    return d.select(key, F.size("_s").alias("n_sent"), F.posexplode_outer("_s").alias("sid", "sentence"))


def term_counts(units: DataFrame, keys: list, text_col: str,
                stop: list | None = None) -> DataFrame:
    """Raw term frequency per unit: ``<keys..., term, tf>``."""
    t = units.select(*keys, F.explode(T.tokens(text_col)).alias("term"))
    if stop:
        t = t.where(~F.col("term").isin(list(stop)))   # hash-set lookup per token
    return t.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
