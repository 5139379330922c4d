"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from factlake.llm import queries, spelling as S
from factlake.sources.tables import table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def counted(rows, min_length=5, min_count=3, drop_every=97):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def expected(n):
    """All words that share a form with one letter left out, or have that form, are compared."""
    holes, near = {}, {w: set() for w in n}
    for w in n:
        for x in {w[:k] + w[k + 1:] for k in range(len(w))} | {w}:
            holes.setdefault(x, []).append(w)
    for group in holes.values():
        for a, b in combinations(group, 2):
            if distance(a, b) == 1:
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert S.one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("shard, leaf", [(20_000, 16), (5, 0), (200, 2)])
def test_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(S, "SHARD_WORDS", shard)
    monkeypatch.setattr(S, "LEAF_WORDS", leaf)
    rng = random.Random(shard)
    words = ["".join(rng.choices("abcqé×Ü", k=rng.randint(4, 8))) for _ in range(250)] + ["abcde" * 1000, "abcde" * 999 + "abcd"]
    rows = [(rng.choice([None, k, k % 7]), " ".join(rng.choices(words, k=60)) + ".Abcab, aBcab1abcabé") for k in range(60)]
    rows += [(5, None), (6, ""), (7, "  12 !"), (8, "q" * 50_000 + " " + ("q" * 50_000 + " ") * 3)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = sorted(map(tuple, S.spelling_variants(df, drop_every=97).collect()))
    n = counted(rows)
    assert any(len(w) == 50_000 for w in n)
    long = {w: c for w, c in n.items() if len(w) > 100}
    short = expected({w: c for w, c in n.items() if len(w) <= 100})
    assert [g for g in got if len(g[0]) <= 100] == short
    assert {g[0]: g[3] for g in got if len(g[0]) > 100} == long


def test_hot_leaf_and_chain(spark):
    # words of one vector (every permutation of a few letters), and forms that lead on
    from itertools import permutations
    words = ["".join(p) for p in permutations("abcdef")][:300]
    chain = [("x" * k + "y" * (12 - k), 3 * 2 ** k) for k in range(7)]
    text = " ".join(words * 3) + " " + " ".join(w for w, c in chain for w in [w] * c)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted(map(tuple, S.spelling_variants(df).collect()))
    assert got == expected(counted([(1, text)], drop_every=0))
    assert {g[2] for g in got if "y" in g[0] and "x" in g[0]} == {chain[-1][0]}


def test_empty_and_fixture(spark):
    t = table(spark, "/root/testdata/sf0.001", "documents")
    assert S.spelling_variants(t.limit(0)).count() == 0
    got = sorted(map(tuple, queries.op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()))
    assert got == expected(counted([(r.doc_id, r.text) for r in t.collect()]))
