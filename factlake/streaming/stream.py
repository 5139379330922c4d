"""Structured Streaming entry points.

The source pipeline is batch only (no stream, window or state in it); what
carries over unchanged are the stateless row operators (page text, clause
split, after-"que" clauses, labels, chunking ...).  These helpers apply
them to a file stream and write an exactly-once parquet sink whose
progress lives under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from factlake.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """File stream over the folder ``path`` (new files are new micro-batches);
    ``glob`` keeps only matching file names."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def apply_rows(stream: DataFrame, columns: dict, keep: list) -> DataFrame:
    """Project ``keep`` columns plus ``{name: Column}`` computed columns; only
    stateless expressions belong here (no aggregation, no window)."""
    return stream.select(*keep, *[c.alias(n) for n, c in columns.items()])


def write_parquet(df: DataFrame, out_path: str, name: str, once: bool = True):
    """Start a parquet sink; ``once`` processes what is available and stops
    (``availableNow``), else a micro-batch every 10 seconds."""
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    return w.start()
