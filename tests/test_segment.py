"""Word-piece re-join, similarity segmentation, factual share."""

import numpy as np
import pytest

from factlake.operators import segment


def test_wordpiece_golden(spark):
    df = spark.createDataFrame([(1, 0, "ab"), (1, 1, "##cd"), (1, 2, "ef"), (2, 0, "##x"), (2, 1, "##y")],
                               "doc_id long, pos long, piece string")
    got = {(r["doc_id"], r["grp"]): r["word"] for r in segment.wordpiece_rejoin(df).collect()}
    assert sorted(got.items()) == [((1, 1), "abcd"), ((1, 2), "ef"), ((2, 1), "##xy")]


def brute_segments(vecs):
    sims = [float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) for a, b in zip(vecs, vecs[1:])]
    if not sims:
        return [0] * len(vecs)
    thr = np.mean(sims) - np.std(sims)
    seg, out = 0, []
    for i in range(len(vecs)):
        out.append(seg)
        if i < len(sims) and sims[i] < thr:
            seg += 1
    return out


def test_similarity_segments_vs_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, expect = [], {}
    for g in range(4):
        n = int(rng.integers(1, 40))
        ids = sorted(rng.choice(1000, n, replace=False).tolist())
        vecs = rng.normal(size=(n, 8))
        rows += [(g, int(i), v.astype(float).tolist()) for i, v in zip(ids, vecs)]
        expect.update({(g, int(i)): s for i, s in zip(ids, brute_segments(list(vecs)))})
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    got = {(r["label"], r["vec_id"]): r["segment"] for r in
           segment.similarity_segments(df, n_buckets=16).collect()}
    assert got == expect


def test_factual_share(spark):
    df = spark.createDataFrame([(1, "Em 2022 e que nada."), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in segment.factual_share(df).collect()}
    assert got[1]["n_segments"] == 4 and got[1]["n_factual"] == 1
    assert got[1]["factual_share"] == pytest.approx(0.25)
    assert got[2]["factual_share"] == 0.0 and got[3]["factual_share"] == 0.0
    none = {r["doc_id"]: r["factual_share"] for r in segment.factual_share(df, label_fn=None).collect()}
    assert none[1] is None          # M08: no classifier -> NULL
