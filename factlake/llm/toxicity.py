"""Toxicity scoring of noisy text: decode first, then score.

A writer's intended word passes a noisy channel: letters become look-alike
digits and signs, separators are put between letters, letters are repeated.
For every token that could be noisy a character lattice holds the readings of
each sign, and a Viterbi search finds the cheapest path under channel costs
and a character trigram model.  The trigram model counts every document.
Restored words then go to a logistic regression on words and word beginnings,
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import held_out, worker_state

# FIXED VALUES: look-alikes of letters.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c"}
SEPARATORS = ".-_*~^'`·•:;,/\\#%&= "
LOOK_COST, DROP_COST, REPEAT_COST, KEEP_COST = 1.5, 0.5, 0.3, 2.0
BEGINNINGS = (4, 5, 6)      # lengths of word beginnings that are features
LONGEST = 40                # a longer token is no word; after so many characters the search sets settled text aside
SYMBOLS = 32                # 0 space, 1..26 letters, 27 other signs, 28 other letters
CACHE = 300_000             # tokens that a worker remembers as plain
FLUSH = 60_000              # features that a task counts before it passes them on

_LOOK = "".join(re.escape(c) for c in LOOKS)
_SEP = "".join(re.escape(c) for c in SEPARATORS.strip())
_NOISY = re.compile(rf"[{_LOOK}]|([^\W\d_])\1\1|[^\W\d_][{_SEP}]+[^\W\d_]")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def symbol(c: str) -> int:
    """The trigram model's symbol of one lower-case character."""
    if c.isspace():
        return 0
    base = unicodedata.normalize("NFKD", c)[0]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 28 if c.isalpha() else 27


_TABLE = np.array([symbol(chr(i).lower()[0]) if not 0xD800 <= i < 0xE000 else 27 for i in range(0x3000)], dtype=np.uint8)


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.full(len(code), 28, np.uint8)
    low = code < len(_TABLE)
    out[low] = _TABLE[code[low]]
    return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigram counts over all documents: one row per task and
    trigram is shuffled, the result has SYMBOLS ** 3 cells."""
    def run(batches):
        worker_state("trigrams", dict)     # lets go of what another operator cached
        n = np.zeros(SYMBOLS ** 3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    s = symbols(t).astype(np.int32)
                    n += np.bincount(s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["gram", "n"])

    rows = (docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gram long, n long")
                .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(SYMBOLS ** 3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out.reshape((SYMBOLS,) * 3)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities, interpolated with bigrams and unigrams."""
    uni = counts.sum((0, 1)) + 1.0
    uni /= uni.sum()
    bi = counts.sum(0)
    bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
    tri = (counts + 5 * bi[None]) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(tri)


class Decoder:
    """Viterbi search through a token's character lattice."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known = {}

    def symbol(self, c):
        s = self.known.get(c)
        if s is None:
            s = self.known[c] = symbol(c)
        return s

    def edges(self, token: str, i: int) -> list:
        """Readings of ``token[i]``: ``(output, channel cost)``."""
        c = token[i]
        if c.isalpha():
            out = [(c, 0.0)]
            if i and token[i - 1] == c and (token[i - 2:i - 1] == c or token[i + 1:i + 2] == c):
                out.append(("", REPEAT_COST))      # three or more in a row
            return out
        out = [(a, LOOK_COST) for a in LOOKS.get(c, "")]
        if i and token[i - 1] == c:
            out.append(("", REPEAT_COST))
        if c in SEPARATORS:
            out += [("", DROP_COST), (" ", KEEP_COST)]
        else:
            out.append((c, KEEP_COST))
        return out

    def decode(self, token: str) -> str:
        """The cheapest reading of a token; ties go to the smaller output."""
        paths, settled = {(0, 0): (0.0, "")}, []
        for i in range(len(token) + 1):
            if i and i % LONGEST == 0:      # what all paths begin with is set aside: texts stay short
                same = commonprefix([text for _, text in paths.values()])
                settled.append(same)
                paths = {k: (total, text[len(same):]) for k, (total, text) in paths.items()}
            new = {}
            for out, cost in self.edges(token, i) if i < len(token) else [(" ", 0.0)]:
                for (a, b), (total, text) in paths.items():
                    if not out:
                        key, step = (a, b), (total + cost, text)
                    else:
                        s = self.symbol(out)
                        key, step = (b, s), (total + cost + self.costs[a][b][s], text + out)
                    if key not in new or step < new[key]:
                        new[key] = step
            paths = new
        return ("".join(settled) + min(paths.values())[1]).strip()

    def restore(self, token: str) -> str:
        """The reading of a lower-case token.  A token with nothing noisy in it
        has a lattice of one path, which is the token."""
        if not _HAS_LETTER.search(token) and not (2 < len(token) <= LONGEST and any(c in LOOKS for c in token)):
            return token
        if " " not in token and not _NOISY.search(token):
            return token
        return self.decode(token)


def _trim(chunk: str) -> str:
    """Without the signs around a word; a look-alike before it stays."""
    end = len(chunk)
    while end and not chunk[end - 1].isalnum():
        end -= 1
    start = 0
    while start < end and not chunk[start].isalnum():
        start += 1
    if start and start < end and chunk[start - 1] in "$@€£!" and chunk[start - 2:start - 1] != chunk[start - 1]:
        start -= 1
    return chunk[start:end]


def spaced_runs(text: str) -> list:
    """Runs of single signs set apart by blanks, e.g. ``i d i o t``, as tokens."""
    out, run = [], []
    for w in text.split():
        core = w.strip(".,;:!?") if len(w) > 1 else w
        if len(core) == 1 and (core.isalpha() or core in LOOKS):
            run.append(core)
            continue
        if len(run) > 2:
            out.append(" ".join(run))
        run = []
    if len(run) > 2:
        out.append(" ".join(run))
    return out


_SINGLES = re.compile(r"(?<!\S)\S\s+\S[.,;:!?]?\s+\S(?!\w)")


def words_of(chunk: str, decoder: Decoder) -> list:
    return [w for w in re.split(r"[\W_]+", decoder.restore(_trim(chunk))) if w]


def features_of(words: list) -> set:
    out = set()
    for w in words:
        out.add(w)
        for n in BEGINNINGS:
            if len(w) >= n:
                out.add(w[:n] + "*")
    return out


def chunks_of(text: str) -> set:
    """A text's distinct tokens in lower case, spaced-out runs as one token each."""
    low = text.lower()
    out = set(low.split())
    if _SINGLES.search(low):
        out.update(spaced_runs(low))
    return out


class Scorer:
    def __init__(self, costs, weights: dict, bias: float):
        self.decoder = Decoder(costs)
        self.weights, self.bias = weights, bias
        self.plain: set = set()      # tokens without a weighted feature
        self.hits: dict = {}         # the others, with their features

    def score(self, text) -> float:
        chunks = chunks_of(text or "") - self.plain
        found = set()
        for c in chunks:
            f = self.hits.get(c)
            if f is None:
                f = [x for x in features_of(words_of(c, self.decoder)) if x in self.weights]
                if f:
                    if len(self.hits) >= CACHE:
                        self.hits.clear()
                    self.hits[c] = f
                else:
                    if len(self.plain) >= CACHE:
                        self.plain.clear()
                    self.plain.add(c)
            found.update(f)
        z = self.bias + math.fsum(self.weights[x] for x in found)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _labelled(docs, labels, sample_rows):
    """Distinct texts of at most ``sample_rows`` labelled rows, chosen by a hash
    of the id, none of them held out.  The ids are bounded, so they may be broadcast."""
    ids = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
                 .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                 .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna().join(
        F.broadcast(ids), "doc_id").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def _logistic(rows: list, y: np.ndarray, n: int, penalty: float = 0.00005, rounds: int = 400) -> tuple:
    """Weights and bias of a logistic regression on sets of feature numbers."""
    at = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r, np.int64) for r in rows]])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v, t = np.zeros(n + 1), np.zeros(n + 1), 1.0
    step = 1.0 / (0.25 * (1 + max((len(r) for r in rows), default=0)) + penalty)
    for _ in range(rounds):
        z = np.bincount(row, v[at], len(rows)) + v[-1]
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        grad = np.concatenate([np.bincount(at, g[row], n) + penalty * v[:-1], [g.sum()]])
        new = v - step * grad
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, max_features: int = 4096) -> tuple:
    """``(trigram costs, weights, bias)``.

    The character model counts all documents.  The regression sees at most
    ``sample_rows`` labelled documents and keeps the ``max_features`` features
    that tell the classes apart best; both bounds are fixed, so what reaches
    the driver does not grow with the tables.
    """
    costs = trigram_costs(trigram_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(costs)     # SYMBOLS ** 3 numbers
    sample = _labelled(docs, labels, sample_rows)

    def text_features(decoder, text):
        return features_of([w for c in chunks_of(text) for w in words_of(c, decoder)])

    def count(batches):
        decoder, n, pos = Decoder(shared.value), Counter(), Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([pos[k] for k in n], pa.int64()),
                                               pa.array(list(n.values()), pa.int64())], names=["feature", "pos", "n"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = text_features(decoder, text) | {""}      # the empty feature counts documents
                n.update(f)
                if toxic:
                    pos.update(f)
                if len(n) >= FLUSH:
                    yield counted()
                    n, pos = Counter(), Counter()
        yield counted()

    stats = (sample.select("text", "toxic").mapInArrow(count, "feature string, pos long, n long")
                   .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    # log-likelihood ratio of the classes given the feature against the classes' rates; a
    # feature is kept when that outweighs twice the usual penalty for one more parameter
    k, n, rate = F.col("pos").cast("double"), F.col("n").cast("double"), F.col("all.pos") / F.col("all.n")
    ratio = 2 * (k * F.log(k / (n * rate)) + F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(0.0))
    total = stats.where("feature = ''").select(F.struct("pos", "n")).scalar()
    names = [r["feature"] for r in stats.where("feature <> '' AND pos > 0").withColumn("all", total)
             .where(k > n * rate).withColumn("ratio", ratio).where(F.col("ratio") >= 2 * F.log(F.col("all.n")))
             .orderBy(F.col("ratio").desc(), "feature").limit(max_features).select("feature").collect()]
    number = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def vector(batches):
        decoder = Decoder(shared.value)
        for b in batches:
            rows = [sorted(number.value[x] for x in text_features(decoder, t) if x in number.value) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "at"])

    got = sorted((tuple(r["at"]), r["toxic"]) for r in sample.select("text", "toxic").mapInArrow(vector, "toxic int, at array<int>").collect())
    if not got:
        return costs, {}, -3.0
    w, bias = _logistic([g[0] for g in got], np.array([float(g[1] > 0) for g in got]), len(names))
    return costs, {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(bias)


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``predicted``.

    A null or empty text gets the score of no words; repeated rows repeat; an
    empty table gives an empty result.  Columns of ``docs`` with these two
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # at most max_features weights and the trigram costs
    docs = docs.drop("score", "predicted")
    at, key = docs.columns.index(text_col), f"toxicity_{uuid.uuid4().hex}"     # caches belong to one model

    def run(batches):
        s = worker_state(key, lambda: Scorer(*shared.value))
        for b in batches:
            v = [s.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.float64()), pa.array([int(x >= threshold) for x in v], pa.int32())],
                                             names=[*b.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double, predicted int"
    return docs.mapInArrow(run, schema)
