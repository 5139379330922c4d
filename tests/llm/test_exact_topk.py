import hashlib
import math
import re

import numpy as np

from factlake.llm import exact_dedup, topk
from factlake.sources.tables import table

import __spark_entry__ as E


def test_exact_dedup_odd_rows(docs_frame):
    rows = [(5, "a b"), (3, "ab"), (9, " a\tb\n"), (1, None), (2, ""), (None, "a  b "), (7, "é x"), (7, "é x"), (8, "éx"), (None, "solo"), (4, " " * 50_000 + "ab")]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    want = []
    for (i, t), n in zip(rows, norm):
        group = [(-len(u or ""), j is None, j or 0, j) for (j, u), m in zip(rows, norm) if m == n]
        keep = min(group)[3]
        want.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs_frame(rows), runs=5, fan_in=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs_frame([])).count() == 0


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (base[i % 6] + rng.normal(size=8) * 0.1) * rng.choice([0.01, 1, 1, 5])]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]                       # ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2010, [float("inf")] * 8), (2020, [0.0] * 8),
             (2030, [1.0, 2.0]), (2040, [3.0, 1.0]), (None, [1.0] * 8), (2050, []), (2030, [1.0, 2.0]), (2060, [-1e6] * 8)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, norm double")
    for bucket_rows, query_rows in ((8192, 4096), (50, 7)):
        got = topk.top_k(df, 5, 10, bucket_rows=bucket_rows, query_rows=query_rows).collect()
        assert sorted(map(tuple, got)) == brute(rows, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_fixture_has_all_queries(spark):
    got = topk.top_k(table(spark, "/root/testdata/sf0.001", "embeddings")).collect()
    assert len(got) == 50


def test_entry_lists_the_operators():
    names = [n for n in E.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in E.queries()
