"""Every stage against a brute-force version of its decisions, on its own input."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from factlake.llm import toxicity
from factlake.sources.tables import table
from tests.llm import test_line_dedup, test_near_dup, test_packing, test_secrets

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    outs = []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        outs.append((name, docs, out))
        if k + 1 < len(P.STAGES):
            assert out.columns == columns and out.dtypes == docs.dtypes
        docs = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = outs

    model = toxicity.fit(a, table(spark, SF, "labels"))
    s = toxicity.Scorer(*model)
    assert sorted(rows_of(b)) == sorted((i, t) for i, t in rows_of(a) if s.score(t) < 0.3)
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    left = {i for i, _ in rows_of(b)}
    assert len(clean & left) >= 0.95 * len(clean) and len(toxic & left) < 0.6 * len(toxic)

    rows = rows_of(b)
    assert sorted(rows_of(c), key=str) == test_line_dedup.expected(rows, test_line_dedup.keys_of(spark, rows))
    assert c.where(F.length("text") != F.col("n_chars")).join(b.where(F.length("text") == F.col("n_chars")), "doc_id", "left_semi").count() == 0

    kept = {r[0] for r in test_near_dup.expected(rows_of(c)) if r[3]}
    assert sorted(rows_of(d)) == sorted(x for x in rows_of(c) if x[0] in kept)

    masked = dict(rows_of(e))
    for i, t in rows_of(d):
        spans = test_secrets.reference(t)
        if spans:
            for x in spans.split(","):
                _, s0, e0 = x.split(":")
                assert t[int(s0):int(e0)] not in masked[i]
        if "[SECRET]" not in masked[i]:
            assert masked[i] == t
        else:
            parts = [re.escape(x) for x in masked[i].split("[SECRET]")]
            assert re.fullmatch(".+?".join(parts), t, re.S)

    tok = Tokenizer.from_file(P.TOKENIZER)
    got = f.collect()
    want = []
    for i, t in masked.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    n = test_packing.check_layout([(r.sequence_id, r.offset, r.length) for r in got])
    assert n <= -(-sum(w[3] for w in want) // 2048) * 1.02 + 1


def test_run_and_odd_rows(spark, tmp_path):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, None, None, None, None), (10_003, "x" * 50_000, "en", "s", 50_000),
                                 (10_004, "same words here", "en", "s", 15), (10_004, "same words here", "en", "s", 15)], docs.schema)
    for name in ("documents", "labels"):
        t = docs.unionAll(odd) if name == "documents" else table(spark, SF, name)
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert {None, 10_001, 10_002, 10_003, 10_004} <= {r.doc_id for r in got}
    test_packing.check_layout([(r.sequence_id, r.offset, r.length) for r in got])
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    table(spark, SF, "labels").limit(0).write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "empty")).count() == 0
