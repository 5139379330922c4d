"""The text work of summaries, keywords and tags: values against brute force, and
plans that do each expensive step once."""

import hashlib
import math

from pyspark.sql import functions as F

from factlake.functions import text as T
from factlake.operators import keywords, segment, subwords, summarize, tagger, tfidf

TEXT = "O gato preto viu 2 ratos. Mas o gato dormiu, porque o rato fugiu! Um gato preto dorme. E o rato come queijo?"


def docs(spark, rows=((1, TEXT), (2, "Curta."), (3, ""), (4, None))):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_share_cuts_its_segments_once(spark):
    d = docs(spark)
    share = segment.share_of(T.clause_split("text"))
    assert optimized(d.select(share.alias("s"))).count("split(") == 1
    got = [r["s"] for r in d.orderBy("doc_id").select(share.alias("s")).collect()]
    want = [r["factual_share"] for r in segment.factual_share(d).orderBy("doc_id").collect()]
    assert got == want and got[0] > 0 and got[2] == 0.0


def test_buckets_are_worked_out_once_and_vectors_count_them(spark):
    d = docs(spark)
    assert "filter(" not in optimized(summarize.cluster_summary(d))
    for r in summarize.sentence_vectors(d).collect():
        words = [w for w in "".join(c if c.isalnum() else " " for c in (r["sentence"] or "").lower()).split() if len(w) > 1]
        want = [0.0] * 64
        for w in words:
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        assert r["vec"] == want


def by_hand(tokens, stop, n_max, top_n):
    bucket = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64 for t in tokens]
    whole = [bucket.count(i) for i in range(64)]
    kept = [(t, b) for t, b in zip(tokens, bucket) if t not in stop]
    seen = {}
    for n in range(1, n_max + 1):
        for i in range(len(kept) - n + 1):
            run = kept[i:i + n]
            own = [[b for _, b in run].count(j) for j in range(64)]
            dot = sum(x * y for x, y in zip(own, whole))
            seen[" ".join(t for t, _ in run)] = round(dot / (math.sqrt(sum(x * x for x in own)) * math.sqrt(sum(x * x for x in whole))), 6)
    return sorted(((-s, k) for k, s in seen.items()))[:top_n]


def test_keywords_are_scored_in_batches_as_by_hand(spark):
    d = docs(spark)
    for n_max, top_n, stop in ((1, 3, ["o"]), (3, 7, ["o", "um"]), (2, 100, [])):
        rows = keywords.embed_keyword_rows(d, ["doc_id"], stop, n_max, top_n)
        assert "ArrowEvalPython" in optimized(rows)
        got = {r["doc_id"]: [(x["s"], x["k"]) for x in r["keywords"] or []] for r in rows.collect()}
        tokens = d.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()
        assert got == {r["doc_id"]: by_hand(r["t"], stop, n_max, top_n) for r in tokens}


def test_only_a_summarys_terms_meet_the_original(spark):
    orig = spark.createDataFrame([(1, "gato preto dorme gato"), (2, "o o"), (3, "rato come"), (4, "gato"), (None, "gato")], "doc_id long, original string")
    summ = spark.createDataFrame([("a", 1, "gato dorme"), ("b", 1, "gato preto dorme gato"), ("a", 2, "o"), ("a", 3, ""), ("a", 4, "rato novo"),
                                  ("b", 3, None), ("a", None, "gato"), ("b", 5, "gato")], "modelo string, doc_id long, summary string")
    out = tfidf.doc_summary_cosine(orig, summ, ["o"])
    assert "FullOuter" not in optimized(out)
    got = {(r["modelo"], r["doc_id"]): r["cosine"] for r in out.collect()}
    pairs = summ.join(orig, "doc_id", "left")
    want = {(r["modelo"], r["doc_id"]): r["cosine"] for r in tfidf.pair_cosine(pairs, ["modelo", "doc_id"], "original", "summary", ["o"]).collect()}
    assert got == want and got["b", 1] == 1.0 and got["a", 3] == 0.0 and got["a", None] is None


def test_equal_keys_of_summaries_each_get_a_row(spark):
    orig = spark.createDataFrame([(1, "gato preto")], "doc_id long, original string")
    summ = spark.createDataFrame([("a", 1, "gato"), ("a", 1, "gato")], "modelo string, doc_id long, summary string")
    assert tfidf.doc_summary_cosine(orig, summ, []).count() == 2


def test_chunks_join_sentences_without_a_search_for_white_space(spark):
    text = "  " + " ".join(f"Frase {i} do texto." for i in range(40)) + "\n\t"
    d = docs(spark, [(1, text)])
    step = optimized(d.select(F.explode(T.chunks("text", 50)))).split("aggregate(")[1].split("lambdafunction(")[1]
    assert "regexp_replace" not in step
    want, b = [], ""
    for s in [f"Frase {i} do texto." for i in range(40)]:
        if len(b) + len(s) + 1 <= 50:
            b = (b + " " + s).strip()
        else:
            want, b = want + [b], s
    assert d.select(T.chunks("text", 50).alias("c")).first()["c"] == want + [b]


def test_tokens_are_sorted_without_a_comparing_lambda(spark):
    d = docs(spark)
    sents = tagger.rule_tagged_sentences(tagger.sentence_words(d), ["o"])
    uni, bi = tagger.train_sentences(sents)
    tagged = tagger.tag_sentences(tagger.token_table(d), uni, bi, ["doc_id", "sid"])
    cut = subwords.limit_pieces(d, subwords.affix_vocabulary(d.where("doc_id = 1")), 5)
    assert "array_sort" not in optimized(tagged).split("aggregate(_toks")[-1].split("Join")[0]
    assert "sort_array" in optimized(tagged) and "sort_array" in optimized(cut)
    first = {(r["doc_id"], r["sid"]): [t["word"] for t in r["_toks"]] for r in tagged.collect()}
    assert first[1, 0] == ["O", "gato", "preto", "viu", "2", "ratos", "."]


# ------------------------------------------------------------- work in batches instead of exchanges of tokens
ODD = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" + (". " if j % 5 == 0 else "") for j in range(i % 40))) for i in range(120)]
ODD += [(5, "x y. w1 w2."), (5, "w1 w2 w3. w4 w1. x"), (7, ODD[7][1]), (None, "abc. def"), (None, "w1 w2"), (400, ""), (401, None), (402, "a. b. c"),
        (403, "São Paulo. ÁGUA água. são"), (404, " x\u2003w1 w2.\u3000w1 w3.\x85")]


def test_summaries_are_those_of_the_centrality_table(spark):
    d = docs(spark, ODD).repartition(5)
    top = tfidf.top_sentences(tfidf.sentence_centrality(d), 5).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("rk", "sentence"))).alias("p"), F.max(F.col("has_tok").cast("int")).alias("t"))
    want = {(r.doc_id, " ".join(x.sentence for x in r.p) if r.t else "") for r in top.collect()}
    got = [(r.doc_id, r.summary) for r in tfidf.tfidf_summary(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = optimized(tfidf.tfidf_summary(d))
    assert "Window" not in plan and "Generate" not in plan      # no row per token


def test_cosines_of_many_summaries_are_those_of_pairs_and_cost_no_row_per_token(spark):
    rows = [(i, t) for i, t in ODD if i is not None and i not in (5, 7)]
    d = docs(spark, rows).withColumnRenamed("text", "original")
    s = spark.createDataFrame([(m, i, (t or "")[k:k + 60] if t is not None else None) for i, t in rows for m, k in (("a", 0), ("b", 9))], "modelo string, doc_id long, summary string")
    want = tfidf.pair_cosine(s.join(d, "doc_id"), ["modelo", "doc_id"], "original", "summary", ["w3"])
    got = tfidf.doc_summary_cosine(d, s, ["w3"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    none = spark.createDataFrame([("a", None, "w1"), (None, 3, "w1"), ("a", 999, "w1"), ("a", 999, "w1"), ("b", 999, "")], s.schema)
    got = sorted(map(repr, map(tuple, tfidf.doc_summary_cosine(d, none, []).collect())))
    assert got == sorted(map(repr, [("a", None, None), (None, 3, None), ("a", 999, 0.0), ("a", 999, 0.0), ("b", 999, None)]))
    assert "explode(regexp_extract_all" not in optimized(got_plan := tfidf.doc_summary_cosine(d, s, ["w3"])) and got_plan.columns == ["modelo", "doc_id", "cosine"]


def test_batches_of_any_size_give_the_same(spark, monkeypatch):
    import pyarrow as pa
    rows = [[[f"w{(i * j) % 7}" for j in range(n)] for n in range(i % 6)] for i in range(50)] + [[], [[]], None]
    tokens, sizes = pa.array(rows, pa.list_(pa.list_(pa.string()))), pa.array([[len(r or [])] for r in rows], pa.list_(pa.int32()))
    flat = pa.array([sum(r, []) if r is not None else None for r in rows], pa.list_(pa.string()))
    ones = pa.array([[2] * len(r or []) for r in rows], pa.list_(pa.int64()))

    def found():
        picked = summarize._cluster_group("k", 0.3, None, None)(tokens, pa.array([[9] * len(r or []) for r in rows], pa.list_(pa.int32())))
        return (tfidf._central(2)(tokens, sizes).to_pylist(), keywords._best_candidates(["w1"], 1, 3, 64)(flat).to_pylist(),
                tfidf._pair_cosines(["w2"])(flat, tokens, ones).to_pylist(), [(p["at"], p["n"], p["k"]) for p in picked.to_pylist()])
    whole = found()
    assert [len(x) for x in whole] == [len(rows)] * 4
    for most in (1, 10):
        monkeypatch.setattr(tfidf.token_slices, "__defaults__", (most,))
        assert found() == whole


def test_documents_are_clustered_without_a_data_frame_each(spark):
    d = docs(spark, ODD)
    plan = optimized(summarize.cluster_summary(d))
    assert "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" in plan
    got = {r.doc_id: r for r in summarize.cluster_summary(d, 0.5, 4, 30).collect()}
    assert len(got) == len({i for i, _ in ODD}) and got[400].n_sentences == 0 and got[400].k == 0 and got[400].summary == ""
    assert got[402].n_sentences == 0 and got[403].n_sentences == 2 and got[403].summary == "São Paulo." and got[5].n_sentences > 2


def test_the_clause_pattern_asks_for_the_first_letter_once():
    import re

    from factlake.functions import vocab
    plain = re.compile(r"\b" + vocab.connective_group() + r"\b|[.!?]")
    fast = re.compile(vocab.clause_pattern_java().replace("(?U)", ""))
    assert fast.pattern != plain.pattern
    words = vocab.CONNECTIVES + ["logo que", "não", "x", "ou.ou", "quequer", "à", "às", "Se", "se1", "é", "tal. qual", "!"]
    text = "; ".join(f"{a} {b}" for a in words for b in words)
    assert [(m.span(), m.group(1)) for m in fast.finditer(text)] == [(m.span(), m.group(1)) for m in plain.finditer(text)]


def test_trimming_by_a_set_equals_trimming_by_a_pattern(spark):
    rows = [(i, f"{a}x{b}y{a}") for i, (a, b) in enumerate([("", ""), (T.WS_CHARS, T.WS_CHARS), ("\u200b", " "), ("é \u3000", "\n")])] + [(9, T.WS_CHARS), (10, ""), (11, None)]
    rows += [(12, " " + "ab " * 40_000)]
    r = docs(spark, rows).select(T._strip_named(F.col("text")).alias("a"), T.strip("text").alias("b")).collect()
    assert all(x.a == x.b for x in r) and r[1].a.startswith("x") and r[1].a.endswith("y")
