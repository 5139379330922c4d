"""TF-IDF relevance: weighting (C01), sentence centrality (C02), extractive
summary (C03), pair cosine (C04) and single-text keywords (C05).

Weighting follows the common vectoriser defaults: lower-case tokens of 2+
word characters, raw term frequency, smoothed ``idf = ln((1+n)/(1+df)) + 1``
and L2-normalised rows.  Spark ML's ``IDF`` lacks the ``+1`` and the norm,
so the formula is written with aggregates.
"""

from __future__ import annotations

import math
import sys as _sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.operators.corpus import by_doc, sentence_table, term_counts

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

SCORE_DIGITS = 6
TOKENS = 1 << 19        # tokens whose counts are held at once, or those of one text


def sentence_centrality(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """C01+C02: mean cosine of each sentence with every sentence of its
    document (itself included).

    Uses mean_j <u_i, u_j> = <u_i, sum_j u_j> / N: one join with the
    per-document centroid instead of the N x N sentence pairs, so the work
    is linear in the number of tokens.  Token-less sentences score 0.
    All steps are aggregates and windows whose keys start with ``key``, so
    after the one document shuffle the chain runs without another exchange.
    Returns ``<key, sid, n_sent, sentence, score, has_tok>``.
    """
    sent = sentence_table(docs, text_col, key)
    tf = term_counts(sent, [key, "sid", "n_sent"], "sentence")
    by_term = Window.partitionBy(key, "term")
    by_sent = Window.partitionBy(key, "sid")
    w = tf.withColumn("w", F.col("tf") * (F.log((F.col("n_sent") + 1.0)
                                                / (F.count(F.lit(1)).over(by_term) + 1.0)) + 1.0))
    u = w.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_sent)))
    c = u.withColumn("c", F.sum("u").over(by_term))
    score = c.groupBy(key, "sid").agg((F.sum(F.col("u") * F.col("c")) / F.max("n_sent")).alias("raw"))
    return (sent.join(score, [key, "sid"], "left")
                .withColumn("has_tok", F.col("raw").isNotNull())
                .withColumn("score", F.round(F.coalesce("raw", F.lit(0.0)), SCORE_DIGITS))
                .drop("raw"))


def top_sentences(scored: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """``k`` best sentences per document; ties -> lower index."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("sid"))
    return scored.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def token_slices(lengths: np.ndarray, most: int = TOKENS):
    """Ranges of rows that hold about ``most`` tokens together, or a single row."""
    upto, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def lists(column: pa.Array) -> tuple:
    """``(lengths, values)`` of a column of lists; a null list is an empty one."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def codes(values: pa.Array) -> tuple:
    """``(code of every value, the distinct values)``."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _sums(groups: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, weights=x, minlength=n)


def _inverse(key: np.ndarray) -> tuple:
    """``(number of a key among the distinct ones, how often each occurs)``."""
    n = max(len(key), 1)
    if int(key.max(initial=0)) >= (1 << 62) // n:
        return np.unique(key, return_inverse=True, return_counts=True)[1:]
    both = np.sort(key * n + np.arange(len(key)))      # faster than the order of the keys
    key, at = both // n, both % n
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    out = np.empty(len(key), np.int64)
    out[at] = group
    return out, np.bincount(group) if len(key) else group


def _central(k: int):
    """An Arrow function from a key's sentences as token arrays, and the number of sentences of each of its
    texts, to the places of its ``k`` most central sentences; none where they hold no token.  The values
    of ``sentence_centrality``, from counts of a batch in numpy arrays."""
    def best(tokens, sizes):
        (per_row, sents), (texts, size) = lists(tokens), lists(sizes)
        per_sent, toks = lists(sents)
        row = np.repeat(np.arange(len(per_row)), per_row)
        n_sent = np.repeat(size.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False))
        first = np.cumsum(size.to_numpy(zero_copy_only=False)) - size.to_numpy(zero_copy_only=False)
        sid = np.arange(len(row)) - np.repeat(first, size.to_numpy(zero_copy_only=False))
        unit = place = np.arange(len(row))
        if (texts > 1).any():       # texts of one key: their sentences count together by place (and number)
            place = np.unique(np.stack([row, sid]), axis=1, return_inverse=True)[1].ravel()
            unit = np.unique(np.stack([row, sid, n_sent]), axis=1, return_inverse=True)[1].ravel()
        n = len(row)
        at_unit = np.zeros((3, n), np.int64)
        at_unit[:, unit] = row, place, n_sent
        most = np.zeros(n, np.int64)
        np.maximum.at(most, place, n_sent)
        code, words = codes(toks)
        v = max(len(words), 1)
        counted, tf = np.unique(np.repeat(unit, per_sent) * v + code, return_counts=True)
        r, p, ns = at_unit[:, counted // v]
        term, df = _inverse(r * v + counted % v)
        w = tf * (np.log((ns + 1.0) / (df[term] + 1.0)) + 1.0)
        u = w / np.sqrt(_sums(p, w * w, n)[p])
        c = _sums(term, u, len(df))[term]
        raw = _sums(p, u * c, n)[place] / np.maximum(most[place], 1)
        has = (np.bincount(p, minlength=n) > 0)[place]
        score = np.floor(raw * 10 ** SCORE_DIGITS + 0.5)
        order = np.lexsort((sid, -score, row))
        rank = np.arange(n) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        kept = order[rank < k]
        kept = kept[(_sums(row[kept], has[kept], len(per_row)) > 0)[row[kept]]]
        start = np.cumsum(per_row) - per_row
        out = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(per_row)))])
        return pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.array(kept - start[row[kept]], pa.int32()))

    def rows(tokens: pa.Array, sizes: pa.Array) -> pa.Array:
        per_row, sents = lists(tokens)
        upto = np.concatenate([[0], np.cumsum(lists(sents)[0])])
        ends = np.cumsum(per_row)
        parts = [best(tokens.slice(i, j - i), sizes.slice(i, j - i)) for i, j in token_slices(upto[ends] - upto[ends - per_row])]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    return rows


def tfidf_summary(docs: DataFrame, k: int = 5, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``k`` most central sentences joined by a space in score
    order.  A document without any token yields an empty summary (Q18), and so does a null key.
    A key's texts meet in one row and are scored in Arrow batches, so only texts are exchanged."""
    text = F.when(F.col(key).isNotNull(), F.coalesce(text_col, F.lit(""))).alias("_t")      # a list leaves nulls out
    d = by_doc(docs.select(key, text), key).groupBy(key).agg(F.collect_list("_t").alias("_t"))
    d = d.select(key, F.transform("_t", lambda t: T.sentences(t)).alias("_t"))
    d = d.select(key, F.flatten("_t").alias("_s"), F.transform("_t", lambda s: F.size(s)).alias("_n"))
    best = F.arrow_udf(_central(k), "array<int>")
    d = d.select(key, "_s", best(F.transform("_s", lambda s: T.tokens(s)), "_n").alias("_b"))
    return d.select(key, F.array_join(F.transform("_b", lambda i: F.get("_s", i)), " ").alias("summary"))


def lead_summary(docs: DataFrame, k: int = 3, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Lead-k baseline summariser: the first ``k`` sentences."""
    return docs.select(key, F.array_join(F.slice(T.sentences(text_col), 1, k), " ").alias("summary"))


def pair_cosine(pairs: DataFrame, keys: list, left: str, right: str, stop: list,
                out: str = "cosine") -> DataFrame:
    """TF-IDF cosine of two texts fitted on just those two texts,
    stop-words removed.  With n = 2 the idf is 1 for shared terms and
    ln(1.5)+1 for one-sided terms, so only term counts are needed.
    Empty vocabulary -> NULL (the vectoriser raises); one empty side -> 0.
    """
    a = term_counts(pairs, keys, left, stop).withColumnRenamed("tf", "a")
    b = term_counts(pairs, keys, right, stop).withColumnRenamed("tf", "b")
    one_side = math.log(1.5) + 1.0
    j = a.join(b, keys + ["term"], "full_outer").na.fill(0, ["a", "b"])
    f = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1.0)).otherwise(F.lit(one_side))
    agg = j.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b") * f * f).alias("dot"),
        F.sum(F.col("a") * F.col("a") * f * f).alias("na"),
        F.sum(F.col("b") * F.col("b") * f * f).alias("nb"))
    cos = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)) \
           .otherwise(F.col("dot") / (F.sqrt("na") * F.sqrt("nb")))
    scored = agg.select(*keys, F.round(cos, SCORE_DIGITS).alias(out))
    # pairs without any term (empty vocabulary) stay NULL
    return pairs.select(*keys).join(scored, keys, "left")


def doc_summary_cosine(orig: DataFrame, summaries: DataFrame, stop: list, key: str = "doc_id",
                       method: str = "modelo", text_col: str = "original", summary_col: str = "summary",
                       out: str = "cosine") -> DataFrame:
    """C04 for many summaries of one original: the original's term counts
    are computed once per document and held against every summary (instead of
    re-tokenising the original for each method).  Same values as
    ``pair_cosine``.  A key's texts and summaries meet in one row; equal keys count together."""
    words = lambda texts: F.flatten(F.transform(texts, lambda t: T.tokens(t)))
    a = by_doc(orig.select(key, text_col).where(F.col(key).isNotNull()), key).groupBy(key).agg(F.collect_list(text_col).alias("_a"))
    b = by_doc(summaries.select(method, key, summary_col), key).groupBy(key, method).agg(
        F.collect_list(F.when(F.col(key).isNotNull(), F.col(summary_col))).alias("_b"), F.count(F.lit(1)).alias("_n"))
    b = b.groupBy(key).agg(F.collect_list(F.struct(F.col(method).alias("m"), F.col("_b").alias("b"), F.col("_n").alias("n"))).alias("_s"))
    score = F.arrow_udf(_pair_cosines(stop), "array<double>")
    d = b.join(a, key, "left")
    d = d.select(key, "_s", score(words("_a"), F.transform("_s", lambda s: words(s["b"])), F.transform("_s", lambda s: s["n"])).alias("_c"))
    d = d.select(key, F.explode(F.arrays_zip(F.col("_s").alias("s"), F.col("_c").alias("c"))).alias("_z"))
    m = F.col("_z.s.m")
    cos = F.when(F.col(key).isNotNull() & m.isNotNull(), F.round("_z.c", SCORE_DIGITS))
    return d.select(m.alias(method), key, cos.alias(out), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_z.s.n"))).alias("_i")).drop("_i")


def _pair_cosines(stop: list):
    """An Arrow function from a text's tokens, those of its summaries and how many rows each of them stands
    for, to the cosine of each summary; NULL where neither side has a term."""
    stop, one_side = pa.array(sorted(stop), pa.string()), (math.log(1.5) + 1.0) ** 2

    def scored(tokens, summaries, rows):
        (na, a), (ns, s) = lists(tokens), lists(summaries)
        nb, b = lists(s)
        rows = lists(rows)[1].to_numpy(zero_copy_only=False)
        code, words = codes(pa.concat_arrays([a, b]))
        kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)
        v, n, m = max(len(words), 1), len(na), len(nb)
        of = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(m), nb)])
        ours = kept[code] if len(words) else np.zeros(0, bool)
        left = np.arange(len(code)) < len(a)
        ka, ca = np.unique((of * v + code)[ours & left], return_counts=True)
        kb, cb = np.unique((of * v + code)[ours & ~left], return_counts=True)
        text = np.repeat(np.arange(n), ns)
        of, same = kb // v, text[kb // v] * v + kb % v
        at = np.minimum(np.searchsorted(ka, same), max(len(ka) - 1, 0))
        x = np.where(ka[at] == same, ca[at], 0) if len(ka) else np.zeros(len(kb), int)
        aa = _sums(ka // v, ca * ca, n)[text]
        dot, a2, bb = _sums(of, x * cb, m), _sums(of, x * x, m), _sums(of, cb * cb, m)
        b2 = _sums(of, np.where(x > 0, cb * cb, 0), m)
        left, right = rows * (a2 + (aa - a2) * one_side), rows * b2 + (bb - b2) * one_side
        some = (aa > 0) & (bb > 0)
        cos = np.where(some, rows * dot / np.where(some, np.sqrt(left) * np.sqrt(right), 1.0), 0.0)
        out = pa.array(cos, pa.float64(), mask=(aa == 0) & (bb == 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ns)]), pa.int32()), out)

    def rows(tokens: pa.Array, summaries: pa.Array, n: pa.Array) -> pa.Array:
        (na, _), (ns, s) = lists(tokens), lists(summaries)
        upto, ends = np.concatenate([[0], np.cumsum(lists(s)[0])]), np.cumsum(ns)
        parts = [scored(tokens.slice(i, j - i), summaries.slice(i, j - i), n.slice(i, j - i))
                 for i, j in token_slices(na + upto[ends] - upto[ends - ns])]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))
    return rows


def tfidf_keywords(docs: DataFrame, stop: list, k: int = 10, text_col: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """Keywords of one text fitted alone: idf is 1, so the score is
    tf / ||tf||; top ``k`` by score, ties by term."""
    tf = term_counts(docs, [key], text_col, stop)
    w = Window.partitionBy(key)
    scored = tf.withColumn("score", F.round(F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w)),
                                            SCORE_DIGITS))
    rk = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term"))
    return (scored.withColumn("rank", F.row_number().over(rk)).filter(F.col("rank") <= k)
                  .select(key, "rank", "term", "score"))
