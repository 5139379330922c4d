"""Keyword extraction: frequency (C06/A14/T03), embedding similarity
(C07, hashed bag-of-tokens embedder by default), keyword overlap (C08/U01)
and the noun-phrase chunker (W01)."""

from __future__ import annotations

import hashlib
import heapq
import sys as _sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.operators import tfidf
from factlake.operators.corpus import by_doc
from factlake.operators.tfidf import codes, lists, token_slices

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

DIMS = 64
BATCH = 64          # texts whose tokens are Python objects at once
LONG = 500_000      # tokens of a text from which different numbers can round to one score


def hash_bucket(x, dims: int = DIMS) -> Column:
    """Deterministic token bucket: first 32 bits of md5, modulo ``dims``."""
    c = F.col(x) if isinstance(x, str) else x
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % dims


def freq_keywords(docs: DataFrame, stop: list, k: int = 10, text_col: str = "text",
                  key: str = "doc_id") -> DataFrame:
    """The ``k`` most frequent lower-cased alphabetic words that are not
    stop-words; ties -> first occurrence.  ``<key, rank, term, cnt>``."""
    d = by_doc(docs.select(key, text_col), key)
    t = (d.select(key, F.posexplode(T.word_tokens(text_col)).alias("pos", "tok"))
          .select(key, "pos", F.lower("tok").alias("term"))
          .where(F.col("term").rlike(r"^\p{L}+$") & ~F.col("term").isin(list(stop))))
    g = t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy(key).orderBy(F.col("cnt").desc(), F.col("first_pos"))
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
             .select(key, F.col("rank").cast("bigint").alias("rank"), "term", "cnt"))


def bucket_counts(buckets, dims: int = DIMS) -> Column:
    """How often each bucket 0..dims-1 occurs in an array of buckets."""
    b = F.col(buckets) if isinstance(buckets, str) else buckets
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")),
                       lambda i: F.size(b) - F.size(F.array_remove(b, i)))


def _best_candidates(stop: list, n_max: int, top_n: int, dims: int):
    """An Arrow function from token arrays to the candidates that can rank, as ``(x, k)``: score and keyword.

    Runs of words are scored as whole numbers in numpy arrays; strings are made only of those that
    reach the ``top_n``-th best distinct number (less what rounding can hide), and of equal numbers
    only for the first ``top_n`` in keyword order.
    """
    out = pa.list_(pa.struct([("x", pa.float64()), ("k", pa.string())]))
    stop, known = frozenset(stop), {}

    def bucket(t):
        if t not in known:
            if len(known) >= 200_000:
                known.clear()
            known[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims
        return known[t]

    def best(tokens):
        if not tokens:
            return []
        b = np.array([bucket(t) for t in tokens])
        counts = np.bincount(b, minlength=dims)
        norm = np.sqrt(np.dot(counts, counts))
        at = [i for i, t in enumerate(tokens) if t not in stop]
        words, b = [tokens[i] for i in at], b[at]
        v, runs = counts[b], []
        for n in range(1, min(n_max, len(words)) + 1):
            m = len(words) - n + 1
            dot = sum(v[j:j + m] for j in range(n))
            size = n + 2 * sum((b[j:j + m] == b[k:k + m]) for j in range(n) for k in range(j)) if n > 1 else np.ones(m)
            runs.append((n, dot, np.sqrt(size)))
        if not runs:
            return []
        levels = np.unique(np.concatenate([dot / size for _, dot, size in runs]))
        least = levels[-top_n] - norm * 2e-6 if len(levels) >= top_n else 0.0
        equal = {}
        for n, dot, size in runs:
            x = dot / (size * norm)
            for i in np.flatnonzero(dot / size >= least):
                equal.setdefault(x[i], set()).add(" ".join(words[i:i + n]))
        return [{"x": x, "k": k} for x, ks in equal.items() for k in heapq.nsmallest(top_n, ks)]

    def words(tokens):
        """``best`` for single words, of many texts at once: no two numbers round to the same score here."""
        n, values = lists(tokens)
        code, distinct = codes(values)
        names = distinct.to_pylist()
        b, kept = np.array([bucket(t) for t in names], int), np.array([t not in stop for t in names], bool)
        by_name = pc.array_sort_indices(distinct).to_numpy().astype(np.int64)
        in_order = np.empty(len(names), np.int64)
        in_order[by_name] = np.arange(len(names))
        text = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(text * dims + b[code], minlength=len(n) * dims).reshape(len(n), dims)
        v = max(len(names), 1)
        seen = np.unique((text * v + code)[kept[code]])
        text, code = seen // v, seen % v
        dot = counts[text, b[code]]
        # one number orders by text, then the larger dot, then the word
        most = int(dot.max(initial=0)) + 1
        key = np.sort((text * most + (most - 1 - dot)) * v + in_order[code])
        text, per_text = key // v // most, np.bincount(text, minlength=len(n))
        top = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) < top_n
        text, dot, code = text[top], most - 1 - (key[top] // v) % most, by_name[key[top] % v] if len(names) else key
        x = dot / np.sqrt((counts * counts).sum(1))[text]
        found = pa.StructArray.from_arrays([pa.array(x, pa.float64()), distinct.take(pa.array(code))], ["x", "k"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]), pa.int32()), found)

    def rows(tokens: pa.Array) -> pa.Array:
        if n_max == 1:
            n = lists(tokens)[0]
            parts = [words(tokens.slice(i, j - i)) if n[i:j].max() < LONG else pa.array([best(t) for t in tokens.slice(i, j - i).to_pylist()], out)
                     for i, j in token_slices(n)]
            return pa.concat_arrays(parts) if parts else pa.array([], out)
        parts = [pa.array([best(t) for t in tokens.slice(i, BATCH).to_pylist()], out) for i in range(0, len(tokens), BATCH)]
        return pa.concat_arrays(parts) if parts else pa.array([], out)
    return rows


def embed_keyword_rows(texts: DataFrame, keep: list, stop: list, n_max: int = 1, top_n: int = 5,
                       text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """C07 per row: the ``keep`` columns plus ``keywords
    array<struct<s, k>>``, the ``top_n`` best candidates as (-score, keyword).

    Candidates are n-grams (1..``n_max`` tokens, formed after stop-word
    removal) ranked by cosine to the text's embedding, ties in keyword order.
    Default embedder: hashed bag of tokens (``dims`` buckets).  Spark cuts the
    texts into tokens and rounds and ranks; the candidates of a text's own
    tokens are scored in Arrow batches, so nothing is shuffled.
    """
    best = F.arrow_udf(_best_candidates(stop, n_max, top_n, dims), "array<struct<x:double,k:string>>")
    d = texts.select(*keep, best(T.tokens(text_col)).alias("_k"))
    scored = F.transform("_k", lambda z: F.struct((-F.round(z["x"], 6)).alias("s"), z["k"].alias("k")))
    return d.select(*keep, F.slice(F.sort_array(scored), 1, top_n).alias("keywords"))


def embed_keywords(texts: DataFrame, keys: list, stop: list, n_max: int = 1, top_n: int = 5,
                   text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """C07 as a long table ``<keys..., rank, keyword, score>``."""
    d = embed_keyword_rows(texts, keys, stop, n_max, top_n, text_col, dims)
    # outer: the filter that a plain explode implies would be pushed below the
    # projections above, and their expressions written into it over and over
    d = d.select(*keys, F.posexplode_outer("keywords").alias("_i", "_g")).where("_g IS NOT NULL")
    return d.select(*keys, (F.col("_i") + 1).cast("bigint").alias("rank"), F.col("_g.k").alias("keyword"), (-F.col("_g.s")).alias("score"))


def keyword_names(keywords="keywords") -> Column:
    """The lower-cased distinct keywords of an array of (-score, keyword)."""
    return F.array_distinct(F.transform(keywords, lambda g: F.lower(g["k"])))


def keyword_sets(ranked: DataFrame, keys: list, out: str = "kw") -> DataFrame:
    """Lower-cased keyword set per text (T04 slice already applied by rank)."""
    return ranked.groupBy(*keys).agg(F.array_distinct(F.collect_list(F.lower("keyword"))).alias(out))


def noun_phrases(tagged: DataFrame, stop: list, keys: list, pos: str = "pos", word: str = "word",
                 tag: str = "tag", tags: list | None = None) -> DataFrame:
    """Maximal runs of tokens tagged N / NPROP / ADJ whose lower-cased
    form is not a stop-word, joined by a space (gaps and islands: a running
    count of breaks numbers the runs).  Windows are per sentence."""
    from factlake.functions import vocab
    tags = tags or vocab.NOUN_PHRASE_TAGS
    inside = F.col(tag).isin(*tags) & ~F.lower(F.col(word)).isin(list(stop))
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    t = tagged.withColumn("_in", F.coalesce(inside, F.lit(False))) \
              .withColumn("island", F.sum((~F.col("_in")).cast("int")).over(w))
    return (t.where("_in").groupBy(*keys, "island")
             .agg(F.min(pos).alias("start"),
                  F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(word).alias("w")))).alias("_x"))
             .select(*keys, F.col("start").cast("bigint").alias("start"),
                     F.array_join(F.transform("_x", lambda s: s["w"]), " ").alias("phrase")))


def sentence_phrases(tagged: DataFrame, stop: list, keys: list, words: str = "words", tags: str = "tags",
                     keep: list | None = None) -> DataFrame:
    """W01 on sentences as parallel arrays: ``<keys..., start, phrase>``.  A run
    starts at a fitting token behind one that does not fit and ends before the
    next such one, so a sentence's runs are found in its own row."""
    from factlake.functions import vocab
    fits = F.transform(F.arrays_zip(F.col(words).alias("w"), F.col(tags).alias("t")),
                       lambda z: F.coalesce(z["t"].isin(*(keep or vocab.NOUN_PHRASE_TAGS)) & ~F.lower(z["w"]).isin(list(stop)), F.lit(False)))
    d = tagged.select(*keys, F.col(words).alias("_w"), fits.alias("_in"))
    every = F.when(F.size("_in") > 0, F.sequence(F.lit(0), F.size("_in") - 1))

    def edges(step):
        return F.filter(every, lambda i: F.get("_in", i) & ~F.coalesce(F.get("_in", i + step), F.lit(False)))

    runs = F.zip_with(edges(-1), edges(1), lambda s, e: F.struct(
        s.cast("bigint").alias("start"), F.array_join(F.slice("_w", s + 1, e - s + 1), " ").alias("phrase")))
    return d.select(*keys, F.explode(runs).alias("_r")).select(*keys, "_r.start", "_r.phrase")


def keyword_bundle(docs: DataFrame, tagged: DataFrame | None, stop: list, embed_stop: list, k: int = 10, embed_k: int = 5,
                   text_col: str = "text", key: str = "doc_id", runs: DataFrame | None = None) -> DataFrame:
    """Noun phrases, frequent words, TF-IDF words and embedding keywords
    of every document, each list in its rank order.  The TF-IDF words (C05)
    come from the noun phrases, or from the text itself where there are none.
    ``tagged`` holds the documents' tokens ``<key, sid, pos, word, tag>``, or
    ``runs`` their noun phrases ``<key, sid, start, phrase>``."""
    def in_order(df, order, col, out):
        return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, col))), lambda s: s[col]).alias(out))

    runs = noun_phrases(tagged, stop, [key, "sid"]) if runs is None else runs
    docs = by_doc(docs.select(key, text_col), key)      # the one exchange of texts: all below is by key
    phrases = in_order(runs, ["sid", "start"], "phrase", "noun_phrases")
    d = docs.join(phrases, key, "left")
    joined = F.coalesce(F.array_join("noun_phrases", " "), F.col(text_col)).alias("text")
    words = in_order(tfidf.tfidf_keywords(d.select(key, joined), list(stop), k, key=key), ["rank"], "term", "tfidf_words")
    frequent = in_order(freq_keywords(docs, stop, k, text_col, key), ["rank"], "term", "frequent_words")
    near = embed_keyword_rows(d.select(key, text_col, "noun_phrases"), [key, "noun_phrases"], embed_stop, 1, embed_k, text_col)
    out = near.join(frequent, key, "left").join(words, key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, *[F.coalesce(c, none).alias(c) for c in ("noun_phrases", "frequent_words", "tfidf_words")],
                      F.coalesce(F.transform("keywords", lambda g: g["k"]), none).alias("embedding_words"))
