"""Classification evaluation (A03-A07): every metric is derived from one
distributed ``(gold, pred) -> count`` aggregate, which has at most
|labels|^2 rows whatever the input size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.session import cut_lineage


def safe_name(label: str) -> str:
    return re.sub(r"\W+", "_", str(label)).strip("_")


def pair_counts(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return (df.groupBy(F.col(gold).cast("string").alias("gold"), F.col(pred).cast("string").alias("pred"))
              .agg(F.count(F.lit(1)).alias("n")))


def _label_table(spark, labels):
    return spark.createDataFrame([(str(lab), i) for i, lab in enumerate(labels)], "label string, label_idx int")


def confusion_counts(df: DataFrame, labels: list, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row per gold label (all labels, fixed order), one
    ``pred_<label>`` count column per label; pairs outside ``labels`` are
    ignored."""
    pc = pair_counts(df, gold, pred)
    lab = _label_table(df.sparkSession, labels)
    piv = pc.groupBy("gold").pivot("pred", [str(x) for x in labels]).agg(F.sum("n"))
    out = lab.join(piv, lab.label == piv.gold, "left")
    cols = [F.coalesce(F.col(f"`{lab_}`"), F.lit(0)).cast("bigint").alias(f"pred_{safe_name(lab_)}")
            for lab_ in labels]
    return out.select(F.col("label").alias("gold"), F.col("label_idx").cast("bigint").alias("gold_idx"), *cols)


def confusion_normalized(df: DataFrame, labels: list, gold: str = "gold", pred: str = "pred",
                         digits: int = 3) -> DataFrame:
    """Counts divided by the row total, rounded half-to-even; 0 for an
    empty row."""
    cc = confusion_counts(df, labels, gold, pred)
    names = [f"pred_{safe_name(x)}" for x in labels]
    total = sum((F.col(c) for c in names), F.lit(0))
    return cc.select("gold", "gold_idx", *[
        F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.col(c) / total, digits)).alias(c) for c in names])


def _per_class(df: DataFrame, labels, gold, pred) -> DataFrame:
    # a pair counts once for its gold label and once for its predicted one: one
    # pass over the data, then one over at most labels x labels rows
    pc, none = pair_counts(df, gold, pred), F.lit(0).cast("bigint")
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(none)
    sides = F.array(F.struct(F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("gold_n"), none.alias("pred_n")),
                    F.struct(F.col("pred").alias("label"), none.alias("tp"), none.alias("gold_n"), F.col("n").alias("pred_n")))
    m = pc.select(F.explode(sides).alias("s")).select("s.*").where("label IS NOT NULL").groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "gold_n", "pred_n")])
    if labels is not None:
        m = _label_table(df.sparkSession, labels).select("label").join(m, "label", "left").na.fill(0, ["tp", "gold_n", "pred_n"])
    prec = F.when(F.col("pred_n") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("pred_n"))
    rec = F.when(F.col("gold_n") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("gold_n"))
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return m.withColumn("f1", f1).withColumn("support", F.col("gold_n").cast("bigint"))


def class_report(df: DataFrame, labels: list | None = None, gold: str = "gold", pred: str = "pred",
                 digits: int = 6) -> DataFrame:
    """Precision / recall / F1 / support per class, then the accuracy,
    macro-average and support-weighted-average rows."""
    pc = cut_lineage(_per_class(df, labels, gold, pred))     # a row per class, read four times
    r = lambda c: F.round(c, digits)
    per = pc.select(F.col("label").alias("row_label"), r(F.col("precision")).alias("precision"),
                    r(F.col("recall")).alias("recall"), r(F.col("f1")).alias("f1"), "support")
    tot = pc.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("row_label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), r(F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("row_label"), r(F.col("mp")).alias("precision"),
                       r(F.col("mr")).alias("recall"), r(F.col("mf")).alias("f1"),
                       F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("row_label"), r(F.col("wp")).alias("precision"),
                          r(F.col("wr")).alias("recall"), r(F.col("wf")).alias("f1"),
                          F.col("n").cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def macro_metrics(df: DataFrame, labels: list | None = None, gold: str = "gold", pred: str = "pred",
                  digits: int = 6) -> DataFrame:
    """Accuracy and macro precision / recall / F1 (one row)."""
    pc = _per_class(df, labels, gold, pred)
    return pc.agg(F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
                  F.round(F.avg("precision"), digits).alias("macro_precision"),
                  F.round(F.avg("recall"), digits).alias("macro_recall"),
                  F.round(F.avg("f1"), digits).alias("macro_f1"))


def binary_metrics(df: DataFrame, positive, gold: str = "gold", pred: str = "pred",
                   digits: int = 6) -> DataFrame:
    """Accuracy and precision / recall / F1 of the positive class."""
    g, p = F.col(gold).cast("string"), F.col(pred).cast("string")
    pos = F.lit(str(positive))
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum((g == p).cast("long")).alias("ok"),
               F.sum(((g == pos) & (p == pos)).cast("long")).alias("tp"),
               F.sum((p == pos).cast("long")).alias("pp"), F.sum((g == pos).cast("long")).alias("gp"))
    prec = F.when(F.col("pp") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("pp"))
    rec = F.when(F.col("gp") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("gp"))
    a = a.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return a.select(F.round(F.col("ok") / F.col("n"), digits).alias("accuracy"),
                    F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall"),
                    F.round(f1, digits).alias("f1"))


def evaluation_frame(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Keep the text and label columns (error when one is
    missing), normalise the gold label, drop rows whose text or gold label
    is NULL (Q8: a missing text stays NULL instead of becoming "nan")."""
    from factlake.functions.labels import gold_label
    from factlake.functions.text import strip
    from factlake.operators.schema import require_columns
    require_columns(df, [text_col, label_col])
    out = df.select(strip(F.col(text_col)).alias("text"), gold_label(F.col(label_col).cast("string")).alias("gold"))
    return out.na.drop(subset=["text", "gold"])
