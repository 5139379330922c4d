import random

import numpy as np
import pandas as pd
import pytest

from factlake.llm import near_dup as N


def word_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def expected(rows, percent=85):
    sets = word_sets(rows)
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(seed=0, variants=120):
    rng = random.Random(seed)
    def words(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    rows = [(k, " ".join(words(rng.randint(1, 120)))) for k in range(40)]
    base = words(150)
    for k in range(variants):       # more and more edits: some only link to each other
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
        rows.append((100 + k, " ".join(w)))
    rows += [(7, None), (8, ""), (9, " \n\t"), (10, "one"), (11, "ONE"), (12, "one two"), (None, "one two"), (12, "one two"), (13, "É É É É É É"),
             (None, " ".join(base)), (14, "a\x0bb c d e f"), (15, "a b c d e f"), (16, "w " * 20_000)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n long")
    got = N.near_duplicates(df).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == expected(rows)
    kept = N.representatives(df).collect()
    want = [r for r in expected(rows) if r[3] or (r[0] is None and r[2] is None)]
    assert len(kept) == len(want) and set(kept[0].asDict()) == {"doc_id", "text", "node", "n"}
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.7, 0.85, 0.95):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            n = int(round(600 * 2 * share / (1 + share)))
            b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 600 - n).astype(np.uint64)])
            x, y = (np.frombuffer(N.odd_sketch(N.minhashes(N.mix(v))), np.uint64) for v in (a, b))
            errors.append(float(N.estimate(int(np.bitwise_count(x ^ y).sum()))) - n / (1200 - n))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < N.MARGIN + 0.03


def test_block_pairs_find_what_one_block_finds():
    rows = corpus(3, 60)
    sets = [N.shingles(t or "", N._WordHashes()) for _, t in rows]
    rec = [(N.set_digest(s), N.set_digest(s), s.tobytes(), N.odd_sketch(N.minhashes(s))) for s in sets if len(s)]
    pdf = pd.DataFrame(rec, columns=["node", "comp", "set", "sketch"]).drop_duplicates("node")
    def groups(links):
        root = {n: n for n in pdf["node"]}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(n for n in root if find(n) == r) for r in map(find, root)}
    one = N.bucket_links(pdf.assign(side=0), 85, 0.7)
    half = len(pdf) // 2
    many = (N.bucket_links(pdf[:half].assign(side=0), 85, 0.7) + N.bucket_links(pdf[half:].assign(side=0), 85, 0.7)
            + N.bucket_links(pdf.assign(side=[0] * half + [1] * (len(pdf) - half)), 85, 0.7))
    assert groups(one) == groups(many) and len(one) <= len(many)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    worst = 0
    for _ in range(6000):           # 185 shared of 200: a similarity of 0.8605
        a = rng.integers(0, 1 << 63, 215).astype(np.uint64)
        x, y = (np.frombuffer(N.odd_sketch(N.minhashes(N.mix(v))), np.uint64) for v in (a[:200], a[15:]))
        worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
    assert worst <= N._most_ones(0.85 - N.MARGIN)
