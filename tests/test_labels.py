"""Label normalisers (X14-X16) and the fixed class map."""

from factlake.functions import labels as L


def _map(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn("x")).collect()]


def test_gold_label(spark):
    got = _map(spark, L.gold_label, ["Factual", "1.9", "-1", "nan", "??", None, " FAKE ", "0", "inf"])
    assert got == ["factual", "factual", "non-factual", None, None, None, "non-factual", "non-factual", None]


def test_three_class(spark):
    got = _map(spark, L.three_class_label, [None, " NF ", "1", "1.0", "x", "factual nao importante"])
    assert got == ["non-factual", "non-factual", "factual-non-important", "factual-checkworthy",
                   "factual-checkworthy", "factual-non-important"]
    ids = _map(spark, lambda c: L.class_id(L.three_class_label(c)), [None, "1", "x"])
    assert ids == [0, 1, 2]


def test_binary_label(spark):
    assert _map(spark, L.binary_label, ["fato", "boato", "not-factual", "foo", None, "Verdadeiro"]) == \
        [1, 0, 1, 0, 0, 1]


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2],), ([0.5, 0.5],)], "s array<double>")
    assert [r[0] for r in df.select(L.argmax("s")).collect()] == [1, 0]
