"""Word pieces by longest match, and claims between similarity breaks."""

import math
import random
from collections import Counter

from factlake.operators import segment, subwords


def brute_pieces(word, vocabulary):
    at, out = 0, []
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


def vocabulary_and_words():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(200)] + ["abc" * 200, "zzz", "#"]
    vocabulary = {"a", "b", "ab", "abc", "é", "c", "##a", "##b", "##ab", "##bca", "##abcabc", "##c", "##éa", "a", "#"}
    return vocabulary, words


def test_pieces_equal_brute_force(spark):
    vocabulary, words = vocabulary_and_words()
    got = subwords.word_pieces(spark.createDataFrame([(w,) for w in [*words, "", None]], "word string"),
                               spark.createDataFrame([(p,) for p in [*vocabulary, ""]], "piece string")).collect()
    assert {r.word: r.pieces for r in got} == {w: brute_pieces(w, vocabulary) for w in words}


def test_rejoin_inverts_pieces(spark):
    vocabulary, words = vocabulary_and_words()
    p = subwords.word_pieces(spark.createDataFrame([(w,) for w in words], "word string"),
                             spark.createDataFrame([(p,) for p in vocabulary], "piece string"))
    p = p.where("pieces[0] <> '[UNK]'").selectExpr("word AS doc_id", "posexplode(pieces) AS (pos, piece)")
    got = segment.wordpiece_rejoin(p).collect()
    assert got and all(r.doc_id == r.word for r in got)


def test_limit_counts_the_whole_text(spark):
    vocabulary = spark.createDataFrame([("ab",), ("##c",), ("ab",), (".",), ("the",)], "piece string")
    docs = spark.createDataFrame([(1, "ABC the abcc."), (2, ""), (3, None), (4, "xyz ab"), (5, "the " * 500)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in subwords.limit_pieces(docs, vocabulary, 5).collect()}
    assert got == {1: (7, 0, "abc the abc"), 2: (0, 0, ""), 3: (0, 0, ""), 4: (2, 1, "[UNK] ab"), 5: (500, 0, "the the the the the")}
    assert subwords.limit_pieces(docs.limit(0), vocabulary, 5).count() == 0
    assert subwords.limit_pieces(docs, vocabulary.limit(0), 1).where("doc_id = 5").first().n_unknown == 500


def brute_texts(sentences):
    bags = [Counter(w for w in s.lower().rstrip(".").split() if len(w) > 1) for s in sentences]
    sims = []
    for a, b in zip(bags, bags[1:]):
        size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        sims.append(math.floor(1e6 * sum(a[w] * b[w] for w in a) / size + 0.5) if size else 0)
    out = [[sentences[0]]]
    n, total, square = len(sims), sum(sims), sum(x * x for x in sims)
    for s, x in zip(sentences[1:], sims):
        low = total - n * x
        if low > 0 and low * low > n * square - total * total:
            out.append([])
        out[-1].append(s)
    return [" ".join(x) for x in out]


def test_pieces_between_breaks(spark):
    rng = random.Random(8)
    docs = {i: [" ".join(rng.choices(["apple", "pear", "plum", "12", "x", "fig"], k=rng.randint(1, 6))) + "." for _ in range(rng.randint(1, 30))]
            for i in range(40)}
    rows = [(i, " ".join(s)) for i, s in docs.items()] + [(100, ""), (101, None), (102, "One same. One same. One same.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: brute_texts(s) for i, s in docs.items()} | {100: [""], 101: [""], 102: ["One same. One same. One same."]}
    got = {}
    for r in segment.similarity_pieces(df).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == want
    kept = {r.doc_id: (r.n_pieces, r.n_factual, r.factual_text) for r in segment.factual_pieces(df).collect()}
    for i, texts in want.items():
        factual = [t for t in texts if any(c.isdigit() for c in t)]
        assert kept[i] == (len(texts), len(factual), " | ".join(factual))


def test_a_held_vocabulary_gives_the_same_as_the_join(spark):
    rows = [(i, " ".join(("casas", "Casa", "xcasa", "ção", "a", "#", "casacasa", "é", "q")[(i * 5 + j * j) % 9] for j in range(i % 30))) for i in range(50)]
    rows += [(5, "casa a. xx q"), (5, "é"), (7, rows[7][1]), (None, "casa"), (None, "a q"), (90, ""), (91, None), (92, "a " * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for pieces in (["casa", "ca", "##s", "##sa", "##a", "a", "x", "##c", "##ca", "##casa", "çã", "##o", "é", "#"], ["a"], []):
        v = spark.createDataFrame([(p,) for p in pieces + ["", None]], "piece string")
        for limit in (1, 4, 128):
            want = subwords.limit_pieces(d, v, limit, held=-1)
            got = subwords.limit_pieces(d, v, limit, held=subwords.HELD)
            assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()       # no row per token


def test_the_query_moves_no_token(spark):
    from conftest import SF001
    from factlake.plans import queries
    assert "regexp_extract_all" not in "".join(
        ln for ln in queries.subword_limit(spark, SF001)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in ln)
