"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition yields a run: its texts' digests in order, each with the
best row seen so far.  Runs then merge in rounds, ``fan_in`` at a time; a
digest that recurs is reduced at each level, so even a text that makes up a
third of all rows crosses a round as one row per run.  Aggregating a struct
makes the planner sort each task's input by digest and merge it as a stream,
which is the multiway merge of sorted runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import id_text
from factlake.session import cut_lineage

KEY = ["digest", "n_norm", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, code points, and the SHA-256 of the text
    without white space ``[\\x20\\x09-\\x0D]``, with a length and a second hash
    that verify equality."""
    d = id_text(docs, id_col, text_col)
    norm = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    return (d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), norm.alias("_n"))
             .select("doc_id", "n_chars", F.unhex(F.sha2(F.col("_n"), 256)).alias("digest"),
                     F.length("_n").cast("bigint").alias("n_norm"), F.xxhash64("_n").alias("check")))


def merge_runs(rows: DataFrame, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """``KEY -> best, group_size`` after the binomial rounds.  ``best`` orders
    rows by most code points, then smallest id; a null id comes last."""
    best = F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    cur = (rows.select(*KEY, best.alias("best"), (F.spark_partition_id() % runs).alias("run"))
               .groupBy("run", *KEY).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("group_size")))
    while runs > 1:
        runs = -(-runs // fan_in)
        cur = (cur.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                  .groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size")))
    return cur.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                runs: int = 64, fan_in: int = 4) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical without white space; the row with the most
    code points stays, then the smallest id.  Null texts count as empty, and
    all empty texts are one group.  A null id is outranked by any id of the
    same length.  Rows that repeat both id and text are all marked alike.
    An empty table gives an empty result.
    """
    rows = cut_lineage(digests(docs, id_col, text_col))
    won = merge_runs(rows, runs, fan_in).select(*[F.col(c).alias("_" + c) for c in KEY],
                                                F.col("best.doc_id").alias("keep_id"), "group_size")
    same = [F.col(c) == F.col("_" + c) for c in KEY]
    return rows.join(won, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w"""
