"""Named queries: ``(spark, sf_dir) -> DataFrame`` over the whole fixture tables.

Each query composes library operators; ``factlake.plans.oracle`` holds the
equivalent DuckDB SQL for the value check.  Every computed column carries
the same alias in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.functions import vocab
from factlake.operators import tfidf
from factlake.operators.corpus import by_doc
from factlake.session import cut_lineage
from factlake.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _rows(df):
    """Row-level queries: spread a scan that has too few partitions."""
    from factlake.operators.corpus import spread
    return spread(df)


def sentence_centrality_top5(spark: SparkSession, sf: str) -> DataFrame:
    scored = tfidf.sentence_centrality(_docs(spark, sf))
    top = tfidf.top_sentences(scored, 5)
    return top.select("doc_id", F.col("rk").cast("bigint").alias("rk"), F.col("sid").cast("bigint").alias("sid"),
                      "score", "sentence")


def tfidf_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.tfidf_summary(_docs(spark, sf))


QUERIES = {
    "sentence_centrality_top5": sentence_centrality_top5,
    "tfidf_summary": tfidf_summary,
}


# ---------------------------------------------------------------- segmentation
from factlake.operators import segment  # noqa: E402


def _pos64(df):
    return df.withColumn("pos", F.col("pos").cast("bigint"))


def clause_split(spark, sf):
    return _pos64(segment.clause_table(_rows(_docs(spark, sf))))


def after_que_clauses(spark, sf):
    return _pos64(segment.after_que_table(_rows(_docs(spark, sf))))


def quoted_spans(spark, sf):
    return _pos64(segment.quoted_table(_rows(_docs(spark, sf))))


def page_paragraphs(spark, sf):
    return _rows(table(spark, sf, "pages")).select("page_id", "url", T.page_text("html").alias("text"))


def text_chunks(spark, sf):
    d = _rows(_docs(spark, sf))
    return (d.select("doc_id", F.posexplode(T.chunks("text")).alias("chunk_id", "chunk"))
             .select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "chunk",
                     F.length("chunk").cast("bigint").alias("n_chars")))


QUERIES.update({
    "clause_split": clause_split,
    "after_que_clauses": after_que_clauses,
    "quoted_spans": quoted_spans,
    "page_paragraphs": page_paragraphs,
    "text_chunks": text_chunks,
})


# ---------------------------------------------------------------- labels, evaluation, preparation
from factlake.functions import labels as L  # noqa: E402
from factlake.operators import evaluate, prepare  # noqa: E402

EVAL_LABELS = ["factual", "non-factual"]


def _raw_labels(spark, sf):
    ev = table(spark, sf, "events")
    lab = table(spark, sf, "labels")
    return (ev.select(F.lit("event_type").alias("source"), F.col("event_type").alias("raw"))
              .unionByName(ev.select(F.lit("value").alias("source"),
                                     (F.floor("value") - 1).cast("bigint").cast("string").alias("raw")))
              .unionByName(lab.select(F.lit("quality").alias("source"), F.col("quality").cast("string").alias("raw")))
              .unionByName(lab.select(F.lit("toxic").alias("source"), F.col("toxic").cast("string").alias("raw"))))


def normalize_gold(spark, sf):
    r = _raw_labels(spark, sf).withColumn("gold", L.gold_label("raw"))
    return r.groupBy("source", "raw", "gold").agg(F.count(F.lit(1)).alias("n"))


def normalize_3class(spark, sf):
    r = _raw_labels(spark, sf).withColumn("label3", L.three_class_label("raw"))
    r = r.withColumn("label_id", L.class_id("label3").cast("bigint"))
    return r.groupBy("source", "raw", "label3", "label_id").agg(F.count(F.lit(1)).alias("n"))


def normalize_binary(spark, sf):
    r = _raw_labels(spark, sf).withColumn("label2", L.binary_label("raw").cast("bigint"))
    return r.groupBy("source", "raw", "label2").agg(F.count(F.lit(1)).alias("n"))


def _gold_pred(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select(L.gold_label(F.col("quality").cast("string")).alias("gold"),
                      L.gold_label(F.col("toxic").cast("string")).alias("pred"))


def confusion_counts(spark, sf):
    return evaluate.confusion_counts(_gold_pred(spark, sf), EVAL_LABELS)


def confusion_normalized(spark, sf):
    return evaluate.confusion_normalized(_gold_pred(spark, sf), EVAL_LABELS)


def class_report(spark, sf):
    return evaluate.class_report(_gold_pred(spark, sf), EVAL_LABELS)


def macro_metrics(spark, sf):
    return evaluate.macro_metrics(_gold_pred(spark, sf))


def binary_metrics(spark, sf):
    lab = table(spark, sf, "labels")
    return evaluate.binary_metrics(lab, 1, gold="quality", pred="toxic")


def class_weights_mean(spark, sf):
    return prepare.class_weights_mean(table(spark, sf, "labels"), "quality", num_labels=2)


def class_weights_sum(spark, sf):
    return prepare.class_weights_sum(table(spark, sf, "labels"), "quality", num_labels=2)


def _labelled_docs(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return lab.join(table(spark, sf, "documents").select("doc_id"), "doc_id")


def stratified_split(spark, sf):
    s = prepare.stratified_split(_labelled_docs(spark, sf), "label", "doc_id", seed=42)
    return s.select("doc_id", "label", "split")


def stratified_carveout(spark, sf):
    s = prepare.stratified_carveout(_labelled_docs(spark, sf), "label", "doc_id", seed=42)
    return s.select("doc_id", "label", "split")


def early_stop(spark, sf):
    e = prepare.early_stop(table(spark, sf, "events"), "event_type", "event_id", "value", patience=3)
    return e.withColumnRenamed("stop_order", "stop_event_id")


def best_checkpoint(spark, sf):
    b = prepare.best_checkpoint(table(spark, sf, "events"), "event_type", "event_id", "value")
    return b.withColumnRenamed("best_order", "best_event_id")


QUERIES.update({
    "normalize_gold": normalize_gold,
    "normalize_3class": normalize_3class,
    "normalize_binary": normalize_binary,
    "confusion_counts": confusion_counts,
    "confusion_normalized": confusion_normalized,
    "class_report": class_report,
    "macro_metrics": macro_metrics,
    "binary_metrics": binary_metrics,
    "class_weights_mean": class_weights_mean,
    "class_weights_sum": class_weights_sum,
    "stratified_split": stratified_split,
    "stratified_carveout": stratified_carveout,
    "early_stop": early_stop,
    "best_checkpoint": best_checkpoint,
})


# ---------------------------------------------------------------- keywords and scoreboard
from factlake.operators import keywords, scoreboard  # noqa: E402


def freq_keywords(spark, sf):
    return keywords.freq_keywords(_docs(spark, sf), vocab.stop_words("portuguese"), 10)


def tfidf_keywords(spark, sf):
    return tfidf.tfidf_keywords(by_doc(_docs(spark, sf)), list(vocab.stop_words("portuguese")), 10)


def ngram_keywords(spark, sf):
    return keywords.embed_keywords(_docs(spark, sf), ["doc_id"], list(vocab.stop_words("english")),
                                   n_max=3, top_n=10)


def _board(spark, sf):
    d = _rows(_docs(spark, sf))
    return scoreboard.scoreboard(d, scoreboard.method_summaries(d))


def doc_summary_cosine(spark, sf):
    d = by_doc(_docs(spark, sf))
    return tfidf.doc_summary_cosine(d.withColumnRenamed("text", "original"), by_doc(scoreboard.method_summaries(d)),
                                    list(vocab.stop_words("portuguese"))).select("modelo", "doc_id", "cosine")


def keyword_jaccard(spark, sf):
    """C08 with human keywords: keyword cells of ``benchmark`` (keyed by
    item_id = doc_id; duplicate keys -> empty set) against the top-10
    1-3-gram keywords of each summary."""
    d = _rows(_docs(spark, sf))
    summ = scoreboard.method_summaries(d)
    bench = table(spark, sf, "benchmark")
    uniq = bench.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    human = bench.join(uniq, "item_id").select(F.col("item_id").alias("doc_id"), T.keyword_set("text").alias("ko"))
    kr = keywords.embed_keyword_rows(summ, ["modelo", "doc_id"], list(vocab.stop_words("english")), 3, 10, "summary")
    empty = F.array().cast("array<string>")
    j = (kr.select("modelo", "doc_id", keywords.keyword_names().alias("kr")).join(human, "doc_id", "left")
             .select("modelo", "doc_id", F.coalesce("ko", empty).alias("ko"), F.coalesce("kr", empty).alias("kr")))
    return j.select("modelo", F.col("doc_id").alias("idx_texto"), F.round(T.jaccard("ko", "kr"), 6).alias("jaccard_kw"),
                    T.sorted_join("ko").alias("kw_orig"), T.sorted_join("kr").alias("kw_resumo"))


def scoreboard_q(spark, sf):
    return _board(spark, sf).drop("method_idx")


def scoreboard_by_model(spark, sf):
    return scoreboard.by_model(_board(spark, sf))


def radar(spark, sf):
    agg = scoreboard.by_model(_board(spark, sf))
    return scoreboard.radar(agg, True).unionByName(scoreboard.radar(agg, False))


def per_text_compare(spark, sf):
    return scoreboard.per_text_compare(_board(spark, sf))


def boxplot_stats(spark, sf):
    long = scoreboard.per_text_compare(_board(spark, sf)).where(F.col("metric") != "len_texto")
    return scoreboard.box_stats(long, ["modelo", "metric"])


def tradeoff(spark, sf):
    return scoreboard.tradeoff(_board(spark, sf))


def factual_share(spark, sf):
    return segment.factual_share(_rows(_docs(spark, sf)))


def factual_segments(spark, sf):
    return segment.factual_segments(_rows(_docs(spark, sf)))


QUERIES.update({
    "freq_keywords": freq_keywords,
    "tfidf_keywords": tfidf_keywords,
    "ngram_keywords": ngram_keywords,
    "doc_summary_cosine": doc_summary_cosine,
    "keyword_jaccard": keyword_jaccard,
    "scoreboard": scoreboard_q,
    "scoreboard_by_model": scoreboard_by_model,
    "radar": radar,
    "boxplot_stats": boxplot_stats,
    "per_text_compare": per_text_compare,
    "tradeoff": tradeoff,
    "factual_share": factual_share,
    "factual_segments": factual_segments,
})


# ---------------------------------------------------------------- similarity, word pieces, tagger
from factlake.operators import tagger  # noqa: E402


def similarity_segments(spark, sf):
    return segment.similarity_segments(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


def wordpiece_rejoin(spark, sf):
    """W03 on word-piece streams derived from the documents: every third
    token carries the continuation mark."""
    d = by_doc(_docs(spark, sf))
    p = d.select("doc_id", F.posexplode(T.word_tokens("text")).alias("pos", "tok"))
    p = p.select("doc_id", "pos", F.when(F.col("pos") % 3 == 2, F.concat(F.lit("##"), "tok"))
                 .otherwise(F.col("tok")).alias("piece"))
    w = segment.wordpiece_rejoin(p, "doc_id", "pos", "piece")
    return (w.groupBy("doc_id")
             .agg(F.count(F.lit(1)).alias("n_words"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "word"))),
                                           lambda s: s["word"]), " ").alias("text")))


def _tagger(spark, sf):
    stop = vocab.stop_words("portuguese")
    sents = tagger.sentence_words(_rows(_docs(spark, sf)))
    uni, bi = tagger.train_sentences(tagger.rule_tagged_sentences(sents, stop))
    return _docs(spark, sf), uni, bi


def pos_train(spark, sf):
    _, uni, bi = _tagger(spark, sf)
    return (uni.select(F.lit("unigram").alias("kind"), F.lit(None).cast("string").alias("prev_tag"), "word", "tag", "n")
               .unionByName(bi.select(F.lit("bigram").alias("kind"), "prev_tag", "word", "tag", "n")))


def pos_tag(spark, sf):
    s = tagger.tag_texts(*_tagger(spark, sf))
    return s.select("doc_id", "sid", F.size("words").cast("bigint").alias("n_tokens"),
                    F.array_join(F.transform("tags", lambda t: F.coalesce(t, F.lit("-"))), " ").alias("tags"))


def _phrases(spark, sf):
    s = tagger.tag_texts(*_tagger(spark, sf))
    return keywords.sentence_phrases(s, vocab.stop_words("portuguese"), ["doc_id", "sid"])


def noun_phrases(spark, sf):
    return _phrases(spark, sf)


def keyword_bundle(spark, sf):
    """C12 with C05 over noun phrases: four keyword lists per document."""
    b = keywords.keyword_bundle(_docs(spark, sf), None, vocab.stop_words("portuguese"), vocab.stop_words("english"), runs=_phrases(spark, sf))
    return b.select("doc_id", *[F.array_join(c, "; ").alias(c) for c in b.columns[1:]])


QUERIES.update({
    "keyword_bundle": keyword_bundle,
    "similarity_segments": similarity_segments,
    "wordpiece_rejoin": wordpiece_rejoin,
    "pos_train": pos_train,
    "pos_tag": pos_tag,
    "noun_phrases": noun_phrases,
})


# ---------------------------------------------------------------- cells, columns, translation
from factlake.operators import schema as S  # noqa: E402
from factlake.operators import infer  # noqa: E402

TEXT_TABLES = ["documents", "benchmark", "conversations", "pages"]


def infer_text_column(spark, sf):
    """P04 per table, then the size of the chosen column over the whole table."""
    out = None
    for name in TEXT_TABLES:
        df = table(spark, sf, name)
        col = S.infer_text_column(df)
        part = df.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.sum((F.length(T.strip(col)) > 0).cast("long")).alias("n_nonblank"),
                      F.sum(F.length(col)).cast("bigint").alias("n_chars")) \
                 .select(F.lit(name).alias("table_name"), F.lit(col).alias("text_col"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _cells(spark, sf):
    d = _rows(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    cell = (F.when(F.col("lang") == "de", F.lit(None).cast("string"))
             .when(F.col("lang") == "es", F.col("text"))
             .otherwise(T.list_literal(T.after_que("text"))))
    return d.select("doc_id", cell.alias("cell"))


def coalesce_text(spark, sf):
    d = table(spark, sf, "documents")
    primary = F.when(F.col("lang") == "en", F.col("text"))
    fallback = F.when(F.col("lang") != "de", F.col("source"))
    return d.select("doc_id", T.first_nonblank(primary, fallback).alias("text"))


def list_cell_text(spark, sf):
    return _cells(spark, sf).select("doc_id", T.list_cell_text("cell").alias("text"))


def clean_list_cells(spark, sf):
    return _cells(spark, sf).select("doc_id", T.strip_brackets("cell").alias("text"))


def lexicon_translate(spark, sf):
    """C19 with the default translator: a lexicon derived from ``benchmark``
    (every word of 2+ characters -> its reverse)."""
    words = table(spark, sf, "benchmark").select(F.explode(T.tokens("text")).alias("src")).distinct()
    lexicon = words.select("src", F.reverse("src").alias("tgt"))
    return infer.translate_column(_docs(spark, sf), lexicon, "text", "text_pt")


QUERIES.update({
    "infer_text_column": infer_text_column,
    "coalesce_text": coalesce_text,
    "list_cell_text": list_cell_text,
    "clean_list_cells": clean_list_cells,
    "lexicon_translate": lexicon_translate,
})


# ---------------------------------------------------------------- Python-worker operators (rows-only checks)
from factlake.operators import summarize  # noqa: E402


def cluster_summary(spark, sf):
    """Per-document k-means summary (no SQL form: iterative).  The
    measured ``tempo_s`` is dropped here so reruns give identical rows."""
    return summarize.cluster_summary(_docs(spark, sf)).drop("tempo_s")


def scoreboard_variants(spark, sf):
    """C13/J04 with the cluster summariser's variants beside the others (no
    SQL form: k-means); ``tempo_s`` is measured, so it is left out here."""
    d = _docs(spark, sf)
    s = scoreboard.registry_summaries(d, ["lead-3", "tfidf-top5", "cluster-0.2", "cluster-0.3"])
    return scoreboard.scoreboard(d, s).drop("method_idx", "tempo_s")


def _claim_data(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    data = lab.join(_docs(spark, sf), "doc_id")
    split = prepare.stratified_split(data.select("doc_id", "label"), "label", "doc_id", seed=42)
    data = data.join(split.select("doc_id", "split"), "doc_id")
    weights = prepare.class_weights_mean(data.where(F.col("split") == "train"), "label", num_labels=2)
    return data, weights


def classify_batch(spark, sf):
    """Class-weighted logistic regression trained on the train
    split; predictions for every labelled document (no SQL form: training)."""
    data, weights = _claim_data(spark, sf)
    return infer.train_and_predict(data, weights)


def classify_report(spark, sf):
    """Class reports of the validation and test predictions."""
    p = classify_batch(spark, sf)
    reports = [evaluate.class_report(p.where(F.col("split") == s), [0, 1]).withColumn("split", F.lit(s)) for s in ("validation", "test")]
    return reports[0].unionByName(reports[1])


def classify_model(spark, sf):
    """A model plugged in through Arrow batches; this one says what
    the rule classifier says."""
    def make():
        import re

        import numpy as np
        number = re.compile("[0-9]")

        def predict(texts):
            hit = np.array([bool(number.search(t or "")) for t in texts])
            return {"label": np.where(hit, "factual", "non-factual").astype(object), "score": hit.astype(float)}

        return predict

    return infer.classify_batch(_docs(spark, sf), make).select("doc_id", "label", "score")


QUERIES.update({
    "cluster_summary": cluster_summary,
    "scoreboard_variants": scoreboard_variants,
    "classify_batch": classify_batch,
    "classify_report": classify_report,
    "classify_model": classify_model,
})


def news_record(spark, sf):
    """The wide record per document: TF-IDF summary, its
    TF-IDF keywords and embedding keywords (", "-joined in rank order) and
    the after-"que" clauses as a list literal (Q6: the clauses, not the
    whole text).  Keyed joins on doc_id, no positional zip."""
    d = _docs(spark, sf)
    summ = keywords.embed_keyword_rows(tfidf.tfidf_summary(d), ["doc_id", "summary"], list(vocab.stop_words("english")), 1, 5, "summary")
    # read twice below: the summaries are made once
    summ = cut_lineage(summ.select("doc_id", "summary", F.array_join(F.transform("keywords", lambda g: g["k"]), ", ").alias("palavras_chave_emb")))
    kt = (tfidf.tfidf_keywords(by_doc(summ.select("doc_id", F.col("summary").alias("text"))), list(vocab.stop_words("portuguese")), 10)
          .groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                                          lambda s: s["term"]), ", ").alias("palavras_chave_tfidf")))
    que = _rows(d).select("doc_id", T.list_literal(T.after_que("text")).alias("termos_relevantes"))
    return (summ.withColumnRenamed("summary", "resumo").join(kt, "doc_id", "left")
                .join(que, "doc_id")
                .select("doc_id", "resumo", F.coalesce("palavras_chave_tfidf", F.lit("")).alias("palavras_chave_tfidf"),
                        F.coalesce("palavras_chave_emb", F.lit("")).alias("palavras_chave_emb"), "termos_relevantes"))


QUERIES["news_record"] = news_record


def claim_eval_report(spark, sf):
    """E3 evaluation-only flow: labelled texts (documents ⋈ labels) ->
    evaluation frame (gold from quality) -> default claim classifier ->
    class report over factual / non-factual."""
    data = table(spark, sf, "labels").join(_docs(spark, sf), "doc_id")
    ev = evaluate.evaluation_frame(data, "text", "quality")
    pred = ev.withColumn("pred", segment.rule_label("text"))
    return evaluate.class_report(pred, EVAL_LABELS)


QUERIES["claim_eval_report"] = claim_eval_report


def source_roundtrip(spark, sf):
    """``labels`` through a CSV file, and the documents,
    one per line, through a text file; both written to the shared folder and
    read again."""
    import os
    import uuid

    from factlake.session import checkpoint_dir
    from factlake.sources import io
    folder = os.path.join(checkpoint_dir(spark), f"sources-{uuid.uuid4().hex}")
    io.write_table(table(spark, sf, "labels"), f"{folder}/labels", "csv")
    io.write_lines(_docs(spark, sf).select(F.translate("text", "\n\r", "  ").alias("text")), f"{folder}/lines")
    lab = io.read_table(spark, f"{folder}/labels").select(
        F.lit("csv").alias("source"), F.concat_ws(",", "doc_id", "quality", "toxic").alias("value"))
    lines = io.read_lines(spark, f"{folder}/lines").select(F.lit("lines").alias("source"), F.md5("text").alias("value"))
    return lab.unionByName(lines).groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))


QUERIES["source_roundtrip"] = source_roundtrip


# ---------------------------------------------------------------- pluggable models
from factlake.operators import plugin  # noqa: E402


def ngram_keywords_model(spark, sf):
    """C07 through a pluggable embedder; the default one as a model gives the
    keywords of ``ngram_keywords``."""
    return plugin.embed_keywords(_rows(_docs(spark, sf)), ["doc_id"], list(vocab.stop_words("english")), plugin.hash_embedder(),
                                 n_max=3, top_n=10)


def _parallel_texts(spark, sf):
    """Texts of ``benchmark`` beside their successors, as a parallel corpus."""
    b = table(spark, sf, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("tgt_text"))
    return b.select("item_id", F.col("text").alias("src_text")).join(after, "item_id")


def aligned_lexicon(spark, sf):
    """The lexicon that a translator learns from parallel texts."""
    return plugin.aligned_lexicon(_parallel_texts(spark, sf))


def translate_model(spark, sf):
    """C19 through a pluggable batch translator with that lexicon."""
    model = plugin.lexicon_translator(aligned_lexicon(spark, sf))
    return plugin.translate_column(_docs(spark, sf), model)


def quarantine(spark, sf):
    """A model that fails on some texts (those without a number); the
    failed rows carry their error, the others their value."""
    def make():
        import re
        number = re.compile("[0-9]+")

        def first_number(texts):
            out = []
            for t in texts:
                found = number.search(t or "")
                if not found:
                    raise ValueError("no number in the text")
                out.append(found.group())
            return out
        return first_number
    got = plugin.capture(_rows(_docs(spark, sf)), make)
    return got.select("doc_id", F.col("result.value").alias("value"), F.col("result.error").alias("error"))


QUERIES.update({
    "ngram_keywords_model": ngram_keywords_model,
    "aligned_lexicon": aligned_lexicon,
    "translate_model": translate_model,
    "quarantine": quarantine,
})


def training_rounds(spark, sf):
    """M06 in rounds: the evaluation history of a training that stops early
    (no SQL form: training)."""
    import uuid

    from factlake.session import checkpoint_dir
    data, _ = _claim_data(spark, sf)
    return infer.train_in_rounds(data, f"{checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}")[0]


QUERIES["training_rounds"] = training_rounds


# ---------------------------------------------------------------- links, order of categories
from factlake.operators import links  # noqa: E402


def link_texts(spark, sf):
    """Every page's address as a link into the page's end, joined back."""
    pages = table(spark, sf, "pages")
    wanted = pages.select(F.col("page_id").alias("link_id"), F.concat(links.address("url"), F.lit("#end")).alias("url"))
    return links.link_texts(wanted, _rows(pages))


def category_order(spark, sf):
    """A10 per language: sources in the order of their first document."""
    return links.first_appearance(table(spark, sf, "documents"), "source", "doc_id", ["lang"])


QUERIES.update({"link_texts": link_texts, "category_order": category_order})


# ---------------------------------------------------------------- word pieces, claims between breaks
from factlake.operators import subwords  # noqa: E402


def subword_limit(spark, sf):
    """Texts cut after 128 pieces of a vocabulary taken from the benchmark, then classified."""
    cut = subwords.limit_pieces(_docs(spark, sf), subwords.affix_vocabulary(table(spark, sf, "benchmark")), 128, held=subwords.HELD)
    return infer.rule_classifier(cut, "cut").drop("score")


def factual_pieces(spark, sf):
    return segment.factual_pieces(_docs(spark, sf))


def tradeoff_timed(spark, sf):
    """Quality against compression and measured time, cluster variants included (no SQL form: time)."""
    d = _docs(spark, sf)
    s = scoreboard.timed_summaries(d, ["lead-3", "tfidf-top5", "cluster-0.2", "cluster-0.3"])
    return scoreboard.tradeoff(scoreboard.scoreboard(d, s))


QUERIES.update({"tradeoff_timed": tradeoff_timed, "subword_limit": subword_limit, "factual_pieces": factual_pieces})
