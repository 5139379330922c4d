"""Segmentation: clauses (X05), after-"que" clauses (X06), quoted spans
(X04), claim segments and factual share (C18, A02, A13), word-piece
re-joining (W03) and similarity segmentation (W02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.operators import scan
from factlake.operators.corpus import sentence_table, term_counts

FACTUAL = "factual"
NON_FACTUAL = "non-factual"


def explode_parts(df: DataFrame, key: str, arr: Column, name: str) -> DataFrame:
    """Long form ``<key, pos, name>`` of an array column (pos 0-based)."""
    return df.select(key, F.posexplode(arr).alias("pos", name))


def clause_table(docs: DataFrame, text_col: str = "text", key: str = "doc_id",
                 keep_separators: bool = True) -> DataFrame:
    return explode_parts(docs, key, T.clause_split(text_col, keep_separators), "clause")


def after_que_table(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    return explode_parts(docs, key, T.after_que(text_col), "clause")


def quoted_table(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    return explode_parts(docs, key, T.quoted_spans(text_col), "span")


def rule_label(x) -> Column:
    """Default claim classifier (M05 stand-in): a segment that states a
    number is ``factual``.  Real models plug in through ``infer``."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.rlike(r"\d"), F.lit(FACTUAL)).otherwise(F.lit(NON_FACTUAL))


def factual_share(docs: DataFrame, text_col: str = "text", key="doc_id",
                  label_fn=rule_label, keep_separators: bool = True) -> DataFrame:
    """Share of clause segments labelled factual per text; 0.0 for a
    text without segments; NULL for every text when no classifier is given
    (M08).  Segments are counted inside each row: no shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = T.clause_split(text_col, keep_separators)
    if label_fn is None:
        return docs.select(*keys, F.size(parts).cast("bigint").alias("n_segments"),
                           F.lit(None).cast("bigint").alias("n_factual"),
                           F.lit(None).cast("double").alias("factual_share"))
    n_fact = _n_factual(parts, label_fn)
    d = docs.select(*keys, F.size(parts).cast("bigint").alias("n_segments"), n_fact.cast("bigint").alias("n_factual"))
    return d.withColumn("factual_share", F.when(F.col("n_segments") == 0, F.lit(0.0))
                        .otherwise(F.col("n_factual") / F.col("n_segments")))


def _n_factual(parts: Column, label_fn) -> Column:
    return F.size(F.filter(F.transform(parts, lambda p: label_fn(p)), lambda x: F.lower(x) == FACTUAL))


def share_of(parts: Column, label_fn=rule_label) -> Column:
    """A02 as an expression: the share of factual segments, 0.0 without any."""
    # bound to a lambda variable, or the segments would be cut once for every place that names them
    share = F.transform(F.array(parts), lambda p: F.when(F.size(p) == 0, F.lit(0.0)).otherwise(_n_factual(p, label_fn) / F.size(p)))
    return F.get(share, F.lit(0))


def factual_segments(docs: DataFrame, text_col: str = "text", key: str = "doc_id",
                     label_fn=rule_label, sep: str = " | ") -> DataFrame:
    """Segments labelled factual, in segment order, per text."""
    parts = T.clause_split(text_col, True)
    kept = F.filter(parts, lambda p: label_fn(p) == FACTUAL)
    return docs.select(key, F.size(kept).cast("bigint").alias("n_factual"),
                       F.array_join(kept, sep).alias("factual_text"))


def wordpiece_rejoin(pieces: DataFrame, key: str = "doc_id", pos: str = "pos",
                     piece: str = "piece") -> DataFrame:
    """A piece starting with ``##`` is glued (without the marks) to the
    previous one; the first piece is kept as it is.  Window per document:
    the pieces of one document came from one row."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    starts = (~F.col(piece).startswith("##")) | (F.row_number().over(Window.partitionBy(key).orderBy(pos)) == 1)
    g = pieces.withColumn("_start", starts).withColumn("grp", F.sum(F.col("_start").cast("int")).over(w))
    body = F.when(F.col("_start"), F.col(piece)).otherwise(F.substring(F.col(piece), 3, 1 << 30))
    return (g.groupBy(key, "grp")
             .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), body.alias("b")))).alias("_x"))
             .select(key, "grp", F.array_join(F.transform("_x", lambda s: s["b"]), "").alias("word")))


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays, computed in DOUBLE."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda s, v: s + v)
    na = F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v)
    nb = F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot / (F.sqrt(na) * F.sqrt(nb))


def similarity_segments(vectors: DataFrame, group: str = "label", order: str = "vec_id",
                        vec: str = "embedding", n_buckets: int | None = None) -> DataFrame:
    """Cosine of consecutive vectors within a group; a break follows
    position i when ``sim_i < mean(sim) - std_pop(sim)`` (strict); segment
    id = number of breaks before the vector.

    A group may be huge (one label can hold a third of all rows), so nothing
    is windowed over a whole group: positions come from bucketed ranks,
    neighbours from an equi-join on ``(group, pos + 1)``, the threshold
    from a grouped aggregate and segment ids from a bucketed prefix sum.
    """
    v = scan.range_bucket(vectors.select(group, order, vec), [group], [order], "_b", n_buckets)
    ranked = scan.rank_within(v, [group], "_b", [F.col(order)], "pos")
    nxt = ranked.select(group, (F.col("pos") - 1).alias("pos"), F.col(vec).alias("_next"))
    sims = (ranked.join(nxt, [group, "pos"], "left")
                  .withColumn("sim", cosine(vec, "_next")))
    stats = sims.groupBy(group).agg((F.avg("sim") - F.stddev_pop("sim")).alias("thr"))
    flagged = (sims.join(stats, [group])
                   .withColumn("brk", F.coalesce((F.col("sim") < F.col("thr")).cast("long"), F.lit(0))))
    # segment of a vector = breaks strictly before it
    seg = scan.running_sum(flagged, [group], "_b", "pos", "brk", "seg_incl")
    return seg.select(group, order, "pos", F.round("sim", 6).alias("sim"),
                      (F.col("seg_incl") - F.col("brk")).alias("segment"))


def similarity_pieces(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """W02 inside a text: ``(key, piece, text)``, runs of sentences between breaks.

    Neighbouring sentences are compared by the cosine of their term counts (0 if one has no
    terms); a break follows where it lies below the text's mean by more than the standard deviation.
    Cosines are whole millionths, so the comparison is exact.  All steps are keyed by the text
    and share its one exchange; terms meet only the next sentence's.
    """
    s = sentence_table(docs, text_col, key).select(key, "sid", "sentence")
    terms = term_counts(s, [key, "sid"], "sentence")
    # a term's next sentence follows it in the order of its sentences; a hash goes first, so that mostly numbers are sorted
    after = Window.partitionBy("_ht", key, "term").orderBy("sid")
    terms = terms.withColumn("_ht", F.xxhash64(key, "term"))
    terms = terms.withColumn("_tf2", F.when(F.lead("sid").over(after) == F.col("sid") + 1, F.lead("tf").over(after)))
    sums = terms.groupBy(key, "sid").agg(F.sum(F.col("tf") * F.col("tf")).alias("nn"), F.sum(F.col("tf") * F.col("_tf2")).alias("dot"))
    order = Window.partitionBy(key).orderBy("sid")
    d = s.join(sums, [key, "sid"], "left")
    d = d.withColumn("_n2", F.lead("nn").over(order)).withColumn("_last", F.lead("sid").over(order).isNull())
    cos = F.floor(F.lit(1e6) * F.col("dot").cast("double") / F.sqrt((F.col("nn") * F.col("_n2")).cast("double")) + 0.5).cast("bigint")
    d = d.withColumn("_s", F.when(~F.col("_last"), F.coalesce(cos, F.lit(0).cast("bigint"))))
    whole = Window.partitionBy(key)
    d = (d.withColumn("_n", F.count("_s").over(whole)).withColumn("_sum", F.sum("_s").over(whole))
          .withColumn("_sq", F.sum(F.col("_s") * F.col("_s")).over(whole)))
    wide = "decimal(18,0)"
    below = (F.col("_sum") - F.col("_n") * F.col("_s")).cast(wide)
    spread = F.col("_n").cast(wide) * F.col("_sq").cast(wide) - F.col("_sum").cast(wide) * F.col("_sum").cast(wide)
    d = d.withColumn("_brk", F.coalesce((below > 0) & (below * below > spread), F.lit(False)).cast("bigint"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("piece", F.coalesce(F.sum("_brk").over(before), F.lit(0).cast("bigint")))
    return d.groupBy(key, "piece").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("sid", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def factual_pieces(docs: DataFrame, text_col: str = "text", key: str = "doc_id", label_fn=rule_label, sep: str = " | ") -> DataFrame:
    """C18 over W02: the pieces between similarity breaks, re-joined, classified,
    and the factual ones kept in order."""
    p = similarity_pieces(docs, text_col, key)
    kept = F.array_sort(F.collect_list(F.when(F.lower(label_fn("text")) == FACTUAL, F.struct("piece", "text"))))
    return p.groupBy(key).agg(F.count(F.lit(1)).alias("n_pieces"), kept.alias("_k")).select(
        key, "n_pieces", F.size("_k").cast("bigint").alias("n_factual"),
        F.array_join(F.transform("_k", lambda x: x["text"]), sep).alias("factual_text"))
