"""Evaluation, class weights (FIXTURES goldens on labels sf0.01)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from factlake.operators import evaluate, prepare


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF01}/labels.parquet")


def test_confusion_counts(labels):
    cc = evaluate.confusion_counts(labels, [0, 1], "quality", "toxic").orderBy("gold_idx").collect()
    assert [[r["pred_0"], r["pred_1"]] for r in cc] == [[49, 9], [299, 42]]
    assert sum(r["pred_0"] + r["pred_1"] for r in cc) == labels.count()


def test_confusion_normalized(labels):
    cn = evaluate.confusion_normalized(labels, [0, 1], "quality", "toxic").orderBy("gold_idx").collect()
    assert [[r["pred_0"], r["pred_1"]] for r in cn] == [[0.845, 0.155], [0.877, 0.123]]


def test_absent_gold_row_is_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "gold string, pred string")
    cc = {r["gold"]: r for r in evaluate.confusion_counts(df, ["a", "b", "c"]).collect()}
    assert (cc["c"]["pred_a"], cc["c"]["pred_b"], cc["c"]["pred_c"]) == (0, 0, 0)
    cn = {r["gold"]: r for r in evaluate.confusion_normalized(df, ["a", "b", "c"]).collect()}
    assert cn["c"]["pred_a"] == 0.0


def test_binary_metrics(labels):
    r = evaluate.binary_metrics(labels, 1, "quality", "toxic").first()
    assert r["accuracy"] == pytest.approx(0.22807, abs=1e-5)
    assert r["precision"] == pytest.approx(0.823529, abs=1e-6)
    assert r["recall"] == pytest.approx(0.123167, abs=1e-6)
    assert r["f1"] == pytest.approx(0.214286, abs=1e-6)


def test_class_report_matches_binary(labels):
    rep = {r["row_label"]: r for r in evaluate.class_report(labels, [0, 1], "quality", "toxic").collect()}
    assert rep["1"]["precision"] == pytest.approx(0.823529, abs=1e-6)
    assert rep["accuracy"]["f1"] == pytest.approx(0.22807, abs=1e-5)
    assert rep["macro avg"]["support"] == 399
    m = evaluate.macro_metrics(labels, None, "quality", "toxic").first()
    assert m["macro_precision"] == pytest.approx((rep["0"]["precision"] + rep["1"]["precision"]) / 2, abs=1e-6)


def test_class_weights(labels):
    wm = {r["label"]: r["weight"] for r in prepare.class_weights_mean(labels, "quality", 2).collect()}
    assert wm[0] == pytest.approx(1.709273, abs=1e-6) and wm[1] == pytest.approx(0.290727, abs=1e-6)
    ws = {r["label"]: r["weight"] for r in prepare.class_weights_sum(labels, "quality", 2).collect()}
    assert ws[0] == pytest.approx(0.854637, abs=1e-6) and ws[1] == pytest.approx(0.145363, abs=1e-6)
    w3 = {r["label"]: (r["n"], r["weight"]) for r in prepare.class_weights_mean(labels, "quality", 3).collect()}
    assert w3[2][0] == 0 and w3[2][1] > w3[0][1]   # absent class included, largest weight


def test_minmax_radar(spark):
    from factlake.operators.scoreboard import radar
    agg = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0), ("b", 2.0, 2.0, 2.0, 2.0, 2.0),
                                 ("c", 3.0, 3.0, 3.0, 3.0, 3.0)],
                                "modelo string, sim_tfidf_medio double, jaccard_kw_medio double, "
                                "factual_share_medio double, compression_ratio_medio double, tempo_medio_s double")
    r = {x["modelo"]: x for x in radar(agg).collect()}
    assert r["a"]["sim_tfidf_medio"] == 0.0 and r["b"]["sim_tfidf_medio"] == pytest.approx(0.5, abs=1e-6)
    assert r["c"]["sim_tfidf_medio"] == pytest.approx(1.0, abs=1e-6)
    assert r["a"]["tempo_medio_s"] == 1.0          # time inverted
    assert all(0 <= x[c] <= 1 for x in r.values() for c in ["sim_tfidf_medio", "tempo_medio_s"])
    assert F is not None
