"""Bigram tagger: training tables and the left-to-right fold vs a Python loop."""

from collections import Counter, defaultdict

from factlake.operators import tagger

CORPUS = [
    [("O", "ART"), ("gato", "N"), ("come", "V")],
    [("O", "ART"), ("come", "N"), ("bom", "ADJ")],
    [("A", "ART"), ("come", "V"), ("gato", "N")],
    [("come", "N"), ("gato", "N")],
]


def py_train(corpus):
    uc = defaultdict(Counter)
    for s in corpus:
        for w, t in s:
            uc[w][t] += 1
    uni = {w: sorted(c.items(), key=lambda x: (-x[1], x[0]))[0][0] for w, c in uc.items()}
    bc, useful = defaultdict(Counter), set()
    for s in corpus:
        prev = tagger.START
        for w, t in s:
            bc[(prev, w)][t] += 1
            if t != uni[w]:
                useful.add((prev, w))
            prev = t
    bi = {k: sorted(bc[k].items(), key=lambda x: (-x[1], x[0]))[0][0] for k in useful}
    return uni, bi


def py_tag(words, uni, bi):
    prev, out = tagger.START, []
    for w in words:
        t = bi.get((prev, w), uni.get(w))
        out.append(t)
        prev = t if t is not None else tagger.START
    return out


def test_train_and_tag(spark):
    rows = [(0, sid, pos, w, t) for sid, s in enumerate(CORPUS) for pos, (w, t) in enumerate(s)]
    gold = spark.createDataFrame(rows, "doc_id long, sid long, pos long, word string, tag string")
    uni, bi = tagger.train(gold, ["doc_id", "sid"])
    puni, pbi = py_train(CORPUS)
    assert {r["word"]: r["tag"] for r in uni.collect()} == puni
    assert {(r["prev_tag"], r["word"]): r["tag"] for r in bi.collect()} == pbi
    test = [["O", "come", "gato", "xyz", "come"], ["come", "come"]]
    toks = spark.createDataFrame([(1, sid, pos, w) for sid, s in enumerate(test) for pos, w in enumerate(s)],
                                 "doc_id long, sid long, pos long, word string")
    got = {}
    for r in tagger.tag(toks, uni, bi, ["doc_id", "sid"]).collect():
        got.setdefault(r["sid"], {})[r["pos"]] = r["tag"]
    for sid, s in enumerate(test):
        assert [got[sid][i] for i in range(len(s))] == py_tag(s, puni, pbi)


def test_broadcast_and_salted_lookup_agree(spark):
    """One word is a third of all tokens; words without a model row stay."""
    words = ["de", "gato", "come", "de", "xyz", "O", "de", "come", "casa"]
    toks = spark.createDataFrame([(d, s, i, w) for d in range(40) for s in range(3) for i, w in enumerate(words[s:] * (d % 3 + 1))],
                                 "doc_id long, sid long, pos long, word string")
    gold = spark.createDataFrame([(0, sid, pos, w, t) for sid, s in enumerate(CORPUS) for pos, (w, t) in enumerate(s)],
                                 "doc_id long, sid long, pos long, word string, tag string")
    uni, bi = tagger.train(gold, ["doc_id", "sid"])
    puni, pbi = py_train(CORPUS)
    keys = ["doc_id", "sid"]
    small, large = (tagger.tag_sentences(toks, uni, bi, keys, b) for b in (tagger.BROADCAST_BYTES, -1))
    assert "_salt" not in small._jdf.queryExecution().toString() and "_salt" in large._jdf.queryExecution().toString()
    for df in (small, large):
        rows = df.collect()
        assert len(rows) == 120
        for r in rows:
            got = [t["word"] for t in r["_toks"]]
            assert got == words[r["sid"]:] * (r["doc_id"] % 3 + 1) and r["_tags"] == py_tag(got, puni, pbi)
    assert tagger.tag_sentences(toks.limit(0), uni, bi, keys).count() == 0
    assert {t for r in tagger.tag_sentences(toks, uni.limit(0), bi.limit(0), keys).collect() for t in r["_tags"]} == {None}


def test_sentence_phrases_equal_token_phrases(spark):
    import random
    from factlake.operators import keywords
    rng = random.Random(3)
    sents = [(d, s, [rng.choice(["gato", "de", "O", "Lisboa", "preto"]) for _ in range(n)]) for d in range(20) for s, n in enumerate((0, 1, 2, 9))]
    sents = [(d, s, w, [rng.choice(["N", "ADJ", "V", "NPROP", None]) for _ in w]) for d, s, w in sents]
    rows = spark.createDataFrame(sents + [(99, 0, None, None)], "doc_id long, sid long, words array<string>, tags array<string>")
    toks = spark.createDataFrame([(d, s, i, w, t) for d, s, ws, ts in sents for i, (w, t) in enumerate(zip(ws, ts))],
                                 "doc_id long, sid long, pos long, word string, tag string")
    keys = ["doc_id", "sid"]
    a = sorted(map(tuple, keywords.sentence_phrases(rows, ["de", "o"], keys).collect()))
    b = sorted(map(tuple, keywords.noun_phrases(toks, ["de", "o"], keys).collect()))
    assert a == b and len(a) > 20


def test_noun_phrases(spark):
    from factlake.operators import keywords
    rows = [(0, 0, i, w, t) for i, (w, t) in enumerate(
        [("O", "ART"), ("gato", "N"), ("preto", "ADJ"), ("come", "V"), ("de", "N"), ("Lisboa", "NPROP")])]
    df = spark.createDataFrame(rows, "doc_id long, sid long, pos long, word string, tag string")
    got = sorted((r["start"], r["phrase"]) for r in keywords.noun_phrases(df, ["de", "o"], ["doc_id", "sid"]).collect())
    assert got == [(1, "gato preto"), (5, "Lisboa")]


def test_sentence_training_equals_token_training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30)
    stop = ["de", "la"]
    toks = tagger.rule_tags(tagger.token_table(docs), stop)
    a = tagger.train(toks, ["doc_id", "sid"])
    b = tagger.train_sentences(tagger.rule_tagged_sentences(tagger.sentence_words(docs), stop))
    for x, y in zip(a, b):
        cols = sorted(x.columns)
        assert sorted(map(tuple, x.select(cols).collect())) == sorted(map(tuple, y.select(cols).collect()))


def test_keyword_bundle_uses_the_text_without_noun_phrases(spark):
    from factlake.operators import keywords
    docs = spark.createDataFrame([(1, "a casa bela fica longe"), (2, "corre muito"), (3, None)], "doc_id long, text string")
    tags = spark.createDataFrame([(1, 0, 0, "a", "ART"), (1, 0, 1, "casa", "N"), (1, 0, 2, "bela", "ADJ"), (1, 0, 3, "fica", "V"), (1, 0, 4, "longe", "ADV"),
                                  (2, 0, 0, "corre", "V"), (2, 0, 1, "muito", None)], "doc_id long, sid long, pos long, word string, tag string")
    got = {r.doc_id: r for r in keywords.keyword_bundle(docs, tags, ["a"], []).collect()}
    assert got[1].noun_phrases == ["casa bela"] and got[1].tfidf_words == ["bela", "casa"]
    assert got[2].noun_phrases == [] and got[2].tfidf_words == ["corre", "muito"] and got[2].frequent_words == ["corre", "muito"]
    assert len(got[1].embedding_words) == 4 and got[3].tfidf_words == [] and got[3].embedding_words == []


# ------------------------------------------------------------------ whole texts
def _odd_texts(spark):
    rows = [(i, " ".join(("A casa", "casa", "Bela casa", "bela", "fazer", "mente", "9", "!", "Casa.")[(i * 5 + j * j) % 9] for j in range(i % 30))) for i in range(60)]
    rows += [(5, "casa A. Bela fazer"), (5, "x"), (7, rows[7][1]), (None, "Casa bela."), (None, "A casa"), (90, ""), (91, None), (92, " . "), (93, "casa " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _models(spark, d):
    known = tagger.rule_tagged_sentences(tagger.sentence_words(d), ["a"])
    yield tagger.train_sentences(known)
    yield tagger.train_sentences(known.limit(4))            # most words are not in the model
    uni = spark.createDataFrame([("casa", "N", 3), ("Bela", None, 1)], "word string, tag string, n long")
    yield uni, spark.createDataFrame([("N", "casa", "V", 1), ("V", "casa", "N", 2), (tagger.START, "casa", "X", 1), ("N", "bela", "ADJ", 1)], "prev_tag string, word string, tag string, n long")
    yield uni.limit(0), spark.createDataFrame([], "prev_tag string, word string, tag string, n long")


def test_whole_texts_are_tagged_as_their_sentences_are(spark):
    d = _odd_texts(spark)
    for uni, bi in _models(spark, d):
        folded = tagger.tag_sentences(tagger.token_table(d), uni, bi, ["doc_id", "sid"]).collect()
        want = sorted(repr((r.doc_id, r.sid, [x.word for x in r._toks], r._tags)) for r in folded)
        whole = tagger.tag_texts(d, uni, bi)
        assert sorted(repr((r.doc_id, r.sid, r.words, r.tags)) for r in whole.collect()) == want != []
        assert "Generate explode" not in whole._jdf.queryExecution().optimizedPlan().toString()     # no row per token


def test_two_words_with_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F
    d = _odd_texts(spark)
    uni, bi = next(_models(spark, d))
    want = sorted(map(repr, tagger.tag_texts(d, uni, bi).collect()))
    plain = tagger._hash
    monkeypatch.setattr(tagger, "_hash", lambda w, seed: plain(w, seed) if seed > 1 else F.pmod(plain(w, seed), F.lit(2)))
    assert tagger.model_file(tagger.model_rows(uni, bi))[1] == 2
    assert sorted(map(repr, tagger.tag_texts(d, uni, bi).collect())) == want
