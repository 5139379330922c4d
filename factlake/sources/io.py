"""Sources and sinks (S01-S15).  Line sources number their lines; every other
reader keeps the key columns of its input."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.functions import text as T


def _utf8_files(lines: DataFrame) -> DataFrame:
    """``(file_path, ok)``: files of which every line is valid UTF-8."""
    return lines.groupBy("file_path").agg(F.bool_and(F.coalesce(F.is_valid_utf8("value"), F.lit(True))).alias("ok"))


def read_lines(spark: SparkSession, path: str, keep_blank: bool = True, encoding: str | None = None,
               fallback: str = "ISO-8859-1") -> DataFrame:
    """One document per line, stripped, with ``doc_id`` = line number
    (0-based, in the order of file names and lines).

    Without ``encoding`` a file is read as UTF-8 if all of it is valid UTF-8,
    else with ``fallback`` (ISO-8859-1 cannot fail).  Lines are numbered from
    the counts of the file splits: one small row per split gets its offset,
    the lines themselves are neither sorted nor moved to one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"),
                                       F.col("_metadata.file_block_start").alias("start"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    per = raw.groupBy("file_path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file_path", "start").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file_path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    lines = raw.join(per, ["file_path", "start"])
    raw_bytes = F.col("value").cast("binary")
    if encoding:
        line = F.col("value") if encoding.upper().replace("_", "-") in ("UTF-8", "UTF8") else F.decode(raw_bytes, encoding)
    else:
        lines = lines.join(_utf8_files(raw), "file_path")
        line = F.when(F.col("ok"), F.col("value")).otherwise(F.decode(raw_bytes, fallback))
    out = lines.select((F.col("offset") + F.col("at") - F.col("first")).alias("doc_id"), T.strip(line).alias("text"))
    return out if keep_blank else out.where(F.length("text") > 0)


def read_csv_fallback(spark: SparkSession, path: str, fallback: str = "ISO-8859-1", multi_line: bool = False) -> DataFrame:
    """CSV files that are valid UTF-8 are read as UTF-8, the others with
    ``fallback``: a decision per whole file, made by a join on the file's name,
    so no list of files reaches the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    ok = _utf8_files(lines)
    schema = _csv(spark, multi_line).option("encoding", fallback).option("inferSchema", True).csv(path).schema
    # names of columns are taken from the files that are UTF-8, if there are any
    names = _csv(spark, multi_line).csv(path).schema.names

    def part(encoding, which):
        d = _csv(spark, multi_line).option("encoding", encoding).schema(schema).csv(path)
        d = d.select("*", F.col("_metadata.file_path").alias("_file"))
        return d.join(ok.where(which), F.col("_file") == F.col("file_path"), "left_semi").drop("_file")

    out = part("UTF-8", F.col("ok")).unionAll(part(fallback, ~F.col("ok")))
    return out.toDF(*names) if len(names) == len(out.columns) else out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table ``<page_id, url, html>``; a page whose fetch failed
    (NULL html) is kept and flagged, so keys never shift."""
    return spark.read.parquet(path).withColumn("fetch_failed", F.col("html").isNull())


def select_ordinal(df: DataFrame, k: int) -> DataFrame:
    """The ``k``-th column (0-based), e.g. 1 = links, 5 = "column F"."""
    return df.select(df.columns[k])


def _csv(spark: SparkSession, multi_line: bool = False, header: bool = True):
    r = spark.read.option("header", header).option("escape", '"')
    return r.option("multiLine", True) if multi_line else r


def read_table(spark: SparkSession, path: str, header: bool = True, schema=None, multi_line: bool = False) -> DataFrame:
    """Header-row delimited file (CSV) or columnar file (parquet).
    Only ``multi_line`` lets cells hold line breaks; without it large files
    are read in many tasks."""
    if isinstance(path, str) and path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    r = _csv(spark, multi_line, header)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json"}


def detect_format(path: str) -> str:
    """The format of a file name's suffix, in either case."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for '{suffix}' files; known: {', '.join(FORMATS)}")
    return FORMATS[suffix]


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by format (chosen from the suffix unless given)."""
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        return read_table(spark, path)
    return spark.read.json(path)


def read_splits(spark: SparkSession, paths: dict, fmt: str | None = None) -> DataFrame:
    """Train / validation / (test) files as one DataFrame with a
    ``split`` column; the format is decided from the train file."""
    fmt = fmt or detect_format(paths["train"])
    out = None
    for split, p in paths.items():
        if not p:
            continue
        df = read_any(spark, p, fmt).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def peek(df: DataFrame, n: int = 5, order: list | None = None) -> DataFrame:
    """First ``n`` rows (a limit is the feature here), by ``order`` or
    else by all columns that can be ordered, so that reruns agree."""
    order = order or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return df.orderBy(*order).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Table sink with header (CSV) or parquet; no index column."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def suffixed_path(input_path: str, suffix: str = ".pt") -> str:
    """Output name = input name without its suffix + ``suffix`` + .csv."""
    base, _ = os.path.splitext(input_path)
    return f"{base}{suffix}.csv"


def write_lines(df: DataFrame, path: str, col: str = "text", mode: str = "overwrite") -> None:
    """One value per line."""
    df.select(F.coalesce(F.col(col), F.lit("")).alias("value")).write.mode(mode).text(path)


def write_label_map(spark: SparkSession, id2label: dict, path: str) -> None:
    """``{"id2label": {...}, "label2id": {...}}`` as one JSON line."""
    keys = sorted(id2label)
    m1 = F.create_map(*[x for k in keys for x in (F.lit(str(k)), F.lit(id2label[k]))])
    m2 = F.create_map(*[x for k in keys for x in (F.lit(id2label[k]), F.lit(int(k)))])
    spark.range(1).select(F.to_json(F.struct(m1.alias("id2label"), m2.alias("label2id"))).alias("value")) \
         .write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
