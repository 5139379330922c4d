"""Hierarchical language identification with linear support vector machines.

A text's features are hashed character n-gram frequencies.  A one-versus-rest
SVM per language family decides the family; then the one-versus-one SVMs of
that family's languages vote.  Models are fitted on a bounded sample of
labelled rows; every row is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import held_out

# FIXED VALUES: families of languages by ISO 639-1 code.  A code that is not
# listed is a family of its own.
FAMILIES = {"germanic": "af da de en fo fy is lb nl no nb nn sv yi", "romance": "ca es fr gl it oc pt rm ro",
            "slavic": "be bg bs cs hr mk pl ru sk sl sr uk", "uralic": "et fi hu se", "turkic": "az kk ky tk tr tt uz",
            "semitic": "am ar he mt", "baltic": "lt lv", "celtic": "br cy ga gd", "indic": "bn gu hi mr ne pa si ur"}
ORDERS = (1, 2, 3)
DIMS = 8192
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)
BATCH_BYTES = 500_000


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


def gram_index(raw: bytes) -> np.ndarray:
    """Feature index of the n-grams that start at each byte, one row per order."""
    b = _FOLD[np.frombuffer(raw + b"  ", dtype=np.uint8)]
    n = len(raw)
    out = np.empty((len(ORDERS), n), dtype=np.uint32)
    code = np.zeros(n, dtype=np.uint32)
    for i in range(len(ORDERS)):
        code = code * np.uint32(256) + b[i:i + n]
        out[i] = ((code + np.uint32(i * 0x51ED270B)) * np.uint32(2654435761)) >> np.uint32(19)   # 13 bits
    return out


def _text_bytes(text: str) -> bytes:
    return (" " + text.lower() + " ").encode("utf-8", "replace")


def frequencies(text: str) -> np.ndarray:
    g = gram_index(_text_bytes(text))
    return np.bincount(g.ravel(), minlength=DIMS).astype(np.float32) / g.size


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by
    accelerated gradient steps; classes weigh the same however many rows they have."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v, t = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), 1.0
    step = 1.0 / (2 * float((weight * ((x * x).sum(1) + 1)).sum()) + penalty)
    for _ in range(rounds):
        loss = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        g = -2 * weight * loss * y
        grad = np.concatenate([x.T @ g + penalty * v[:-1], [g.sum()]]).astype(np.float32)
        new = v - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + np.float32((t - 1) / t2) * (new - w)
        w, t = new, t2
    return w


class Model:
    """Family SVMs and, within each family, SVMs for pairs of languages."""

    def __init__(self, x: np.ndarray, langs: list):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        lang = np.array(langs)
        fam = np.array([family_of(v) for v in langs])
        scale = 1 / np.sqrt(x.mean(0) + 1e-7) if len(x) else np.ones(DIMS, np.float32)
        x = x * scale
        self.pairs = [(a, b) for f in self.families for a, b in combinations([v for v in self.langs if family_of(v) == f], 2)]
        cols = []
        if len(self.families) > 1:
            cols += [svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in self.families]
        for a, b in self.pairs:
            rows = (lang == a) | (lang == b)
            cols.append(svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32)))
        w = np.array(cols, dtype=np.float32).reshape(len(cols), DIMS + 1)
        self.weights = np.ascontiguousarray((w[:, :-1] * scale).T.astype(np.float32))     # dims x machines
        self.bias = w[:, -1]

    def margins(self, texts: list) -> np.ndarray:
        """One row per (non-empty) text, one column per machine."""
        raw = [_text_bytes(t) for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        g = gram_index(b"".join(raw))
        total = sum(self.weights[row] for row in g)
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        return sums / (len(ORDERS) * (ends - starts))[:, None] + self.bias

    def decide(self, m: np.ndarray) -> tuple:
        """``(language, score)`` from one row of margins."""
        nf = len(self.families) if len(self.families) > 1 else 0
        family, sure = self.families[0], 1.0
        if nf:
            k = int(np.argmax(m[:nf]))
            family, sure = self.families[k], _certainty(m[k])
        members = [v for v in self.langs if family_of(v) == family]
        votes = {v: [0, 0.0] for v in members}
        for (a, b), margin in zip(self.pairs, m[nf:]):
            if a in votes:
                win = a if margin >= 0 else b
                votes[win][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        best = max(members, key=lambda v: (votes[v][0], votes[v][1], v))
        if len(members) > 1:
            sure *= _certainty(votes[best][1] / (len(members) - 1))
        return best, float(sure)

    def predict(self, texts: list) -> list:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return out
        todo, size = [], 0
        for i, t in enumerate(texts):
            if t is not None and _LETTER.search(t):
                todo.append(i)
                size += len(t)
            if todo and (size >= BATCH_BYTES or i + 1 == len(texts)):
                if self.weights.shape[1]:
                    rows = self.margins([texts[j] for j in todo])
                else:
                    rows = np.zeros((len(todo), 0))
                for j, m in zip(todo, rows):
                    out[j] = self.decide(m)
                todo, size = [], 0
        return out


def _certainty(margin: float) -> float:
    return float(1 / (1 + np.exp(-2.0 * np.clip(margin, -30, 30))))


def fit(docs: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Fit on about ``per_language`` rows of each language (all, if it has
    fewer), chosen by a hash of the id among the rows that are not held out.
    That bound is fixed: what reaches the driver does not grow with the table."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, DIMS), np.float32), [])
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in counts.items()])
    d = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < rate * float(1 << 53))

    def run(batches):
        for b in batches:
            rows = [frequencies(t) for t in b.column(0).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                 pa.array([r[a] for r, a in zip(rows, at)], pa.list_(pa.float32()))], names=["lang", "at", "value"])

    t = d.select("text", "lang").mapInArrow(run, "lang string, at array<int>, value array<float>").toArrow()
    x = np.zeros((t.num_rows, DIMS), np.float32)
    for i, (a, v) in enumerate(zip(t["at"], t["value"])):
        x[i, a.values.to_numpy()] = v.values.to_numpy()
    order = np.lexsort((x.sum(1), t["lang"].to_numpy(zero_copy_only=False).astype(str)))
    return Model(x[order], [t["lang"][int(i)].as_py() for i in order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per input row.

    A text that is null or has no letter, or any text when no language was
    learned, is ``und`` with score 0.  Null ids are not held out; repeated rows
    repeat; an empty table gives an empty result.
    """
    # arrays and lists only: a broadcast object would name its class by module, which executors need not have.
    # DIMS weights per machine: fixed size
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = object.__new__(Model)
        vars(m).update(shared.value)
        for b in batches:
            got = m.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"),
                    F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
