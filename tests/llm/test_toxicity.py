import numpy as np
import pytest

from factlake.llm import toxicity as T
from factlake.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return T.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_trigram_counts_cover_all_documents(spark):
    df = spark.createDataFrame([("ab 1",), (None,), ("",), ("Äb",)], "text string")
    c = T.trigram_counts(df)
    want = np.zeros_like(c)
    for t in ["ab 1", "", "Äb"]:
        s = [0, *(T.symbol(x.lower()) for x in t), 0]
        for i in range(len(s) - 2):
            want[s[i], s[i + 1], s[i + 2]] += 1
    want[:] = np.where(want > 0, want, 0)
    assert (c == want).all()


def test_decoder_restores_noisy_words(model):
    d = T.Decoder(model[0])
    for noisy, plain in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("m*o*r*o*n", "moron"), ("idiooooot", "idiot"), ("w0rthless", "worthless"),
                         ("$tupid", "stupid"), ("tr4$h", "trash"), ("i-d-i-0-t", "idiot"), ("cl0wn!!", "clown"), ("the", "the"), ("1234", "1234")]:
        assert T.words_of(noisy, d) == [plain], noisy


def brute_force(decoder, token):
    """The cheapest path by listing all of them."""
    paths = [(0.0, "", (0, 0))]
    for i in range(len(token) + 1):
        nxt = []
        for out, cost in decoder.edges(token, i) if i < len(token) else [(" ", 0.0)]:
            for total, text, (a, b) in paths:
                s = decoder.symbol(out) if out else None
                nxt.append((total + cost, text, (a, b)) if not out else (total + cost + decoder.costs[a][b][s], text + out, (b, s)))
        paths = nxt
    return min(paths)[1].strip()


def test_viterbi_equals_all_paths(model):
    d = T.Decoder(model[0])
    for token in ["1d10t", "a.b.c", "s00o", "|o$er", "x y z", "6!8"]:
        assert d.decode(token) == brute_force(d, token)


def test_held_out_labels(spark, model):
    got = T.score(table(spark, SF, "documents").select("doc_id", "text"), model).toPandas()
    m = got.merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    from factlake.llm.common import held_out
    held = {r.doc_id for r in table(spark, SF, "labels").where(held_out("doc_id")).collect()}
    m = m[m.doc_id.isin(held)]
    clean, toxic = m[m.toxic == 0], m[m.toxic == 1]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (clean.predicted == 0).mean() >= 0.97 and (toxic.predicted == 1).mean() >= 0.6


def test_noisy_text_scores_like_plain_text(model):
    s = T.Scorer(*model)
    assert s.score("the onst 1d10t of w0rthless") == s.score("the onst idiot of worthless") > s.score("the onst of")


def test_odd_rows(spark, model):
    rows = [(1, None, "c", 1.0), (None, "idiot worthless scum", "c", 2.0), (2, "", None, None), (2, "", None, None), (3, "a1!" * 30_000, "c", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    got = T.score(df, model).collect()
    assert len(got) == 5 and got[0].score == got[2].score and got[1].predicted == 1 and got[0].predicted == 0
    empty = df.limit(0)
    m = T.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(empty, m).count() == 0 and [r.predicted for r in T.score(df, m).collect()] == [0] * 5


def whole_viterbi(d, token):
    paths = {(0, 0): (0.0, "")}
    for i in range(len(token) + 1):
        new = {}
        for out, cost in d.edges(token, i) if i < len(token) else [(" ", 0.0)]:
            for (a, b), (total, text) in paths.items():
                s = d.symbol(out) if out else None
                key, step = ((a, b), (total + cost, text)) if not out else ((b, s), (total + cost + d.costs[a][b][s], text + out))
                new[key] = min(step, new.get(key, step))
        paths = new
    return min(paths.values())[1].strip()


def test_long_tokens_are_searched_whole():
    rng = np.random.default_rng(2)
    d = T.Decoder(rng.uniform(0, 6, (29, 29, 29)))
    for token in [" ".join("you are such a worthless idiot and a clown".replace(" ", "")), "a.b1" * 60, "".join(rng.choice(list("ab0!. -x"), 300)) + "z"]:
        assert d.restore(token) == whole_viterbi(d, token)
