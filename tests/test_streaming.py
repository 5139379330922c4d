"""Stateless operators on a file stream (exactly-once parquet sink)."""

import os
import tempfile

from factlake.functions import text as T
from factlake.streaming import stream


def test_page_text_stream(spark):
    src = "/root/testdata/sf0.001/pages.parquet"
    schema = spark.read.parquet(src).schema
    out = tempfile.mkdtemp(prefix="factlake-stream-")
    s = stream.read_stream(spark, os.path.dirname(src), schema, glob="pages.parquet")
    q = stream.write_parquet(stream.apply_rows(s, {"text": T.page_text("html")}, ["page_id"]),
                             os.path.join(out, "t"), "pages_" + os.path.basename(out))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(out, "t"))
    batch = spark.read.parquet(src).select("page_id", T.page_text("html").alias("text"))
    assert sorted(got.collect()) == sorted(batch.collect())
