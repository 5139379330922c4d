"""Sources and sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from factlake.operators import schema
from factlake.sources import io


def test_read_lines_and_latin1(spark):
    d = tempfile.mkdtemp(prefix="factlake-io-")
    p = os.path.join(d, "t.txt")
    with open(p, "wb") as f:
        f.write("  primeira linha  \n\nação é\n".encode("latin-1"))
    got = [r["text"] for r in io.read_lines(spark, p, keep_blank=True, encoding="ISO-8859-1").orderBy("doc_id").collect()]
    assert got == ["primeira linha", "", "ação é"]
    got = io.read_lines(spark, p, keep_blank=False, encoding="ISO-8859-1").count()
    assert got == 2


def test_detect_format_and_splits(spark):
    assert io.detect_format("a.CSV") == "csv" and io.detect_format("b.jsonl") == "json"
    with pytest.raises(ValueError):
        io.detect_format("c.txt")
    d = tempfile.mkdtemp(prefix="factlake-io-")
    for split in ("train", "validation"):
        with open(os.path.join(d, f"{split}.jsonl"), "w") as f:
            f.write(json.dumps({"text": f"t {split}", "label": 1}) + "\n")
    df = io.read_splits(spark, {"train": os.path.join(d, "train.jsonl"), "validation": os.path.join(d, "validation.jsonl"),
                                "test": None})
    assert sorted(r["split"] for r in df.collect()) == ["train", "validation"]
    assert io.suffixed_path("/x/data.csv") == "/x/data.pt.csv"


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="factlake-io-")
    io.write_label_map(spark, {0: "Non-factual", 1: "Factual"}, os.path.join(d, "labels"))
    line = spark.read.text(os.path.join(d, "labels")).first()[0]
    assert json.loads(line) == {"id2label": {"0": "Non-factual", "1": "Factual"},
                                "label2id": {"Non-factual": 0, "Factual": 1}}
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    io.write_lines(df, os.path.join(d, "lines"))
    assert sorted(r[0] for r in spark.read.text(os.path.join(d, "lines")).collect()) == ["", "a"]
    io.write_table(df, os.path.join(d, "csv"), "csv")
    assert io.read_table(spark, os.path.join(d, "csv")).count() == 2


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, Claim string, other string")
    assert schema.infer_text_column(df) == "Claim"
    assert schema.infer_text_column(df, "OTHER") == "other"
    with pytest.raises(KeyError):
        schema.infer_text_column(df, "missing")
    with pytest.raises(ValueError):
        schema.require_columns(df, ["nope"])
    assert schema.require_columns(df, ["nope"], strict=False) is False


def test_csv_charset_fallback_and_pages(spark):
    d = tempfile.mkdtemp(prefix="factlake-io-")
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write("text,label\nação,1\n".encode("utf-8"))
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("text,label\ncoração,0\n".encode("latin-1"))
    got = sorted(r["text"] for r in io.read_csv_fallback(spark, d).collect())
    assert got == ["ação", "coração"]
    pages = io.read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    assert "fetch_failed" in pages.columns
    assert pages.where("fetch_failed").count() == pages.where("html IS NULL").count()
    assert io.select_ordinal(pages, 1).columns == ["url"]


def test_line_numbers_and_charset_per_file(spark):
    d = tempfile.mkdtemp(prefix="factlake io-")
    lines = [f"linha {i}" for i in range(5000)]
    with open(os.path.join(d, "a b.txt"), "w", encoding="utf-8") as f:
        f.write("\n".join([*lines, "fim ção"]) + "\n")
    with open(os.path.join(d, "c.txt"), "wb") as f:
        f.write("ação\n".encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {r["doc_id"]: r["text"] for r in io.read_lines(spark, d).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate([*lines, "fim ção", "ação"]))


def test_csv_file_names_with_spaces(spark):
    d = tempfile.mkdtemp(prefix="factlake-io-")
    with open(os.path.join(d, "a b.csv"), "wb") as f:
        f.write("text,label\ncoração,0\n".encode("latin-1"))
    assert [(r["text"], r["label"]) for r in io.read_csv_fallback(spark, d).collect()] == [("coração", 0)]
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write('text,label\n"a\nb",1\n')
    assert io.read_table(spark, os.path.join(d, "m.csv"), multi_line=True).first()["text"] == "a\nb"
    assert io.peek(spark.range(9).orderBy(F.desc("id")), 3).collect()[0]["id"] == 0


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    from factlake import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Cluster)
