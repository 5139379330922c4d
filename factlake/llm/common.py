"""Helpers shared by the operators: input columns, worker state, components."""

from __future__ import annotations

import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.session import cut_lineage

# White space as Unicode's White_Space property has it (``str.split()`` would
# also split at U+001C..U+001F).
WHITE = r"\t-\r \x85\xa0  -     　"


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, null text as the empty text.
    Every other column, whatever its name, is left behind."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def worker_state(name: str, make):
    """State that a Python worker keeps between tasks (caches, loaded
    tokenizers), one at a time: the next operator's replaces it, so a worker
    never holds more than one cache.  It only saves time: results never depend
    on it."""
    holder = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(holder, "name", None) != name:
        holder.state = None
        holder.name, holder.state = name, make()
    return holder.state


def coded(lists: list) -> tuple:
    """Lists of strings as ``(ends, codes, distinct)``: where each list ends in
    the flat sequence, the sequence as numbers, and the strings they stand for."""
    ends = np.cumsum([0, *map(len, lists)])
    d = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
    return ends, d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def task_count(spark, rows: int, rows_per_task: int, least: int = 1) -> int:
    """Partitions so that no task gets more than about ``rows_per_task`` rows."""
    return max(least, -(-rows // rows_per_task))


def held_out(id_column: str):
    """crc32 of the id as text leaves remainder 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(a, b)``.

    Returns ``(node, root)``, root being the smallest node of the component,
    for every node that has a link.  Alternates large-star and small-star
    steps: each rewrites links so that every node points at the smallest
    neighbour it knows; the number of rounds grows with the logarithm of the
    longest path.  Each round is a reliable checkpoint, so lineage stays short
    and lost executors cost one round at most.  A hub is only ever a group
    key of an aggregate with map-side minimum or the small side of a join.
    """
    cur = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: neighbours above u move to the smallest of u's neighbourhood
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = (cur.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u")
                  .where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v")))
        # small star: neighbours below u, and u itself, move to the smallest of them
        big = cut_lineage(big.distinct())
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        nxt = cut_lineage(small)
        changed = nxt.exceptAll(cur).isEmpty() and cur.exceptAll(nxt).isEmpty()
        cur = nxt
        if changed:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
