"""Spelling variants by a trie of letter-group counts.

A word's letters fall into ``GROUPS`` groups; its vector says how many it has of
each.  One inserted, deleted or replaced letter adds at most one to one group
(surplus) and takes at most one from one (deficit).  Words are arranged in a
trie by successive counts; a depth-first search follows the counts of a word
and may spend one surplus and one deficit.  Words at the leaves are verified.

The first levels of the trie are its shards: a word lives in one and visits
those that its budget reaches, of each two only the later one, so that a pair
meets once.  The number of these levels follows from the vocabulary: no shard
holds more than ``SHARD_WORDS`` words unless all levels are used.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.suffix_dedup import stored

RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")     # in UTF-8: A-Z, a-z, U+00C0 to U+00FF
GROUPS = 32                 # a letter's group is its code point modulo this: a to z are told apart
SHARD_WORDS = 20_000
LEAF_WORDS = 16             # larger leaves are looked up by halves of words
COUNT_WORDS = 300_000       # distinct words a task adds up before it passes them on


# ------------------------------------------------------------------------ words
def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                drop_every: int = 97) -> DataFrame:
    """``(word, n)``: letter runs of whole texts in lower case (A-Z only).  Of a
    run whose crc32 ``h`` of ``<id>:<run>`` is divisible by ``drop_every`` (0: none)
    the code point ``h % length`` is deleted."""
    def run(batches):
        total = {}

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                seen = {}
                for w in RUN.findall(text.encode("utf-8", "replace").lower()):
                    seen[w] = seen.get(w, 0) + 1
                for w, n in seen.items():
                    if len(w) < min_length:         # bytes: never fewer than code points
                        continue
                    h = zlib.crc32(w, start)
                    if drop_every and h % drop_every == 0:
                        s = w.decode()
                        k = h % len(s)
                        w = (s[:k] + s[k + 1:]).encode()
                    total[w] = total.get(w, 0) + n
                if len(total) >= COUNT_WORDS:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------- trie
def vectors(words: list, order=slice(None)) -> np.ndarray:
    """Letter-group counts, one row per word, levels in the given order."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * GROUPS + raw % GROUPS, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)[:, order]


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Leaf:
    """Words of one vector, hence of one length."""

    def __init__(self):
        self.words, self.halves = [], {}

    def near(self, word: str, h: int, head: str, tail: str):
        """The words one edit away.  They share the first or the last ``h``
        letters of ``word``, ``h`` being half of the shortest length that is near."""
        words = self.words
        if len(words) > LEAF_WORDS:
            if h not in self.halves:
                table = self.halves[h] = {}
                for x in words:
                    table.setdefault((0, x[0][:h]), []).append(x)
                    table.setdefault((1, x[0][len(x[0]) - h:]), []).append(x)
            table = self.halves[h]
            words = {x[0]: x for k in ((0, head), (1, tail)) for x in table.get(k, ())}.values()
        return [x for x in words if (x[0].startswith(head) or x[0].endswith(tail)) and one_edit(word, x[0])]


class Trie:
    """Words by their counts from level ``depth`` on (those before are alike)."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, {}

    def add(self, vector: list, word: str, n: int):
        node = self.root
        for c in vector[self.depth:-1]:
            node = node.setdefault(c, {})
        node.setdefault(vector[-1] if self.depth < GROUPS else 0, Leaf()).words.append((word, n))

    def near(self, vector: list, word: str, surplus: int, deficit: int) -> list:
        """``(word, n)`` of the words one edit away, with the budget that is left."""
        h = (len(word) - 1) // 2
        head, tail = word[:h], word[len(word) - h:]
        tail_levels = vector if self.depth < GROUPS else [*vector, 0]      # all levels used up: one leaf
        todo, out = [(self.root, self.depth, surplus, deficit)], []
        while todo:
            node, level, s, d = todo.pop()
            while type(node) is dict:       # follow the word's own count, leave the ways that spend for later
                c = tail_levels[level]
                level += 1
                if s and (x := node.get(c + 1)) is not None:
                    todo.append((x, level, 0, d))
                if d and (x := node.get(c - 1)) is not None:
                    todo.append((x, level, s, 0))
                node = node.get(c)
            if node is not None:
                out += node.near(word, h, head, tail)
        return out


# ----------------------------------------------------------------------- shards
def _paths(v: np.ndarray) -> list:
    """Shard names: counts as big-endian numbers, so that names sort like counts."""
    raw = v.astype(">u4").tobytes()
    size = 4 * v.shape[1]
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def level_order(words: DataFrame) -> list:
    """Letter groups by falling variance of their counts: the first levels of the
    trie then tell the most words apart.  Two sums per group are collected."""
    def run(batches):
        total = np.zeros((2, GROUPS), np.int64)
        for b in batches:
            v = vectors(b.column(0).to_pylist())
            total += np.array([v.sum(axis=0), (v * v).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"g": pa.array(range(GROUPS), pa.int32()), "s": total[0], "q": total[1]})

    sums = words.select("word").mapInArrow(run, "g int, s long, q long").groupBy("g").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    n = max(1, words.count())
    spread = {r["g"]: r["q"] - r["s"] ** 2 / n for r in sums}
    return sorted(range(GROUPS), key=lambda g: (-spread.get(g, 0), g))


def shard_depth(words: DataFrame, order: list) -> int:
    """Levels of the trie that name a shard: the fewest with which none is too large."""
    def run(batches):
        for b in batches:
            v = vectors(b.column(0).to_pylist(), order)
            for depth in range(2, GROUPS + 1):
                path, n = np.unique(v[:, :depth], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), depth), pa.int32()), pa.array(_paths(path), pa.binary()), pa.array(n, pa.int64())],
                                                 names=["depth", "path", "n"])

    load = words.select("word").mapInArrow(run, "depth int, path binary, n long").groupBy("depth", "path").agg(F.sum("n").alias("n"))
    fits = load.groupBy("depth").agg(F.max("n").alias("n")).where(F.col("n") <= SHARD_WORDS).agg(F.min("depth").alias("depth")).first()
    return fits["depth"] if fits["depth"] is not None else GROUPS


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, na, b, nb)``: each pair of words ``(word, n)`` one edit apart, once."""
    order = level_order(words)
    depth = shard_depth(words, order)
    steps = [(0, 0, 0)] + [(i + 1, 0, 1) for i in range(depth)] + [(0, i + 1, 2) for i in range(depth)] + [
        (i + 1, j + 1, 3) for i in range(depth) for j in range(depth) if i != j]

    def deal(batches):
        for b in batches:
            words_, n = b.column(0), b.column(1)
            v = vectors(words_.to_pylist(), order)[:, :depth]
            home = _paths(v)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.binary()), pa.array(np.full(len(home), -1), pa.int32()), words_, n], names=["path", "kind", "word", "n"])
            for up, down, kind in steps:
                # later shards only: the first level that differs has one more
                if kind == 2 or (kind == 3 and down < up):
                    continue
                w = v.copy()
                if up:
                    w[:, up - 1] += 1
                if down:
                    w[:, down - 1] -= 1
                ok = pa.array((w >= 0).all(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(_paths(w), pa.binary()), pa.array(np.full(len(home), kind), pa.int32()), words_, n],
                                                 names=["path", "kind", "word", "n"]).filter(ok)

    def search(batches):
        key, trie = None, None
        rows = ((*r, v) for b in batches for r, v in zip(zip(*(c.to_pylist() for c in b.columns)), vectors(b.column(2).to_pylist(), order).tolist()))
        out = []
        for path, group in groupby(rows, key=lambda r: r[0]):
            trie, some = Trie(depth), False
            for _, kind, word, n, v in group:       # a shard's own words come first
                if kind < 0:
                    trie.add(v, word, n)
                    some = True
                elif some:
                    near = trie.near(v, word, int(kind in (0, 2)), int(kind in (0, 1)))
                    out += [(word, n, w, m) for w, m in near if kind or word < w]
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out = []
        yield batch_of(out)

    def batch_of(out):
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64()) * 2)], names=["a", "na", "b", "nb"])

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("word", "n").mapInArrow(deal, "path binary, kind int, word string, n long")
    return dealt.repartition(parts, "path").sortWithinPartitions("path", "kind").mapInArrow(search, "a string, na long, b string, nb long")


# --------------------------------------------------------------------- variants
def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: forms followed to the last.  Each
    round doubles the steps; a form is at least twice as frequent as its word,
    so the chain is at most as long as a count has bits."""
    cur = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(cur.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        cur = new.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3,
                      ratio: int = 2, drop_every: int = 0) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per distinct word of at
    least ``min_length`` letters and ``min_count`` occurrences.

    Two words are near if one letter is inserted, deleted or replaced.  A
    word's form is its commonest near word (ties: the smallest in code-point
    order) if that is ``ratio`` times as common, else null; its root is where
    forms lead.  Null and empty texts have no words, a null id counts as an empty one in the
    checksum of ``drop_every``, repeated rows count repeatedly, very long words
    are words, and an empty table gives an empty result.
    """
    words = stored(word_counts(docs, id_col, text_col, min_length, drop_every).where(F.col("n") >= min_count))
    pairs = near_pairs(words)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    near = (pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("word")
                 .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")))
    good = F.col("best.m") * -1 >= ratio * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(good, -F.col("best.m")).alias("form_n")))
    root = roots(rows.where("form IS NOT NULL"))
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
