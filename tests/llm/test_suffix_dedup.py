import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factlake.llm import suffix_dedup as S
from factlake.sources.tables import table

K = S.LENGTH


def expected(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(r[k:k + K] for _, r in raws for k in range(len(r) - K + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for k in range(len(r) - K + 1):
            if n[r[k:k + K]] > 1:
                gone[k] += 1
                gone[min(k + K, len(r))] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        edges = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, x in zip(r, gone) if not x)
        out.append((i, len(r), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passages = [words(n) for n in (60, 80, 150, 400)]
    rows = [(k, words(rng.randint(20, 300))) for k in range(20)]
    for k in range(20, 60):
        p = rng.choice(passages)
        a = rng.randint(0, len(p) // 3)
        b = rng.randint(a + 300, max(a + 300, len(p)))
        rows.append((k, words(rng.randint(0, 80)) + p[a:b] + words(rng.randint(0, 80))))
    base = words(300)
    for k in range(60, 75):       # near copies
        w = base.split(" ")
        for _ in range(k - 60):
            w[rng.randrange(len(w))] = "zz"
        rows.append((k, " ".join(w)))
    rows += [(80, base), (80, base), (None, base), (81, None), (82, ""), (83, "ab" * 900), (84, "x" * 399), (85, "x" * 400), (86, "x" * 401),
             (87, base[:K]), (88, base[5:K + 4]), (89, passages[3] + passages[3]), (90, "short")]
    return rows


@pytest.mark.parametrize("limits", [(S.BUCKET_ROWS, S.CHUNK_ROWS), (60, 3)])
def test_equals_brute_force(spark, limits):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, g string, th long").repartition(5)
    got = S.removed_digest(df, bucket_rows=limits[0], chunk_rows=limits[1]).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_fixture(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in S.removed_digest(df).collect()), key=str) == expected(rows)
    assert S.removed_digest(df.limit(0)).count() == 0


def test_leftmost_minima():
    rng = np.random.default_rng(0)
    for n, w in ((50, 7), (14, 7), (7, 7), (100, 1)):
        h = rng.integers(0, 9, n).astype(np.uint64)
        want = [i + int(np.argmin(h[i:i + w])) for i in range(n - w + 1)]
        assert S.leftmost_minima(h, w).tolist() == want


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 5, 3000), rng.integers(0, 3, 3000), rng.integers(0, 1000, 3000)]
    assert (S.multikey_quicksort(cols, small=10) == np.lexsort(cols[::-1])).all() or \
        [tuple(c[i] for c in cols) for i in S.multikey_quicksort(cols, small=10)] == sorted(zip(*cols))
