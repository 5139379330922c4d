"""Near-duplicate detection with MinHash bands and odd sketches.

A document's set is its distinct 5-word shingles.  Documents with one and the
same set are one class from the start, so copies cost nothing further.  Per
class, MinHash samples give band keys and are folded into a parity bitmap (an
odd sketch): two bitmaps' XOR has as many ones as unequal samples leave, which
estimates high similarities closely at a few bytes per document.  Classes that
share a band key are candidates:

1. every class is held against the first and the last class of its buckets;
2. buckets whose classes are not all connected by then are searched in full,
   block by block, for links between different components.

Sketches drop candidates far below the threshold; all others are confirmed on
the full sets.  Only links that connect something are passed on, so a group of
near copies yields about as many links as it has members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import components, id_text, worker_state
from factlake.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 20, 5         # a pair of similarity 0.85 shares no band once in 100,000 times,
LOW_ROWS = 4                # one of 0.80 in 25 bands of four samples twice in a million
SKETCH_WORDS = 4            # 64-bit words of an odd sketch
MARGIN = 0.27               # a pair is dropped on sketches only if it seems this far below the threshold: rarer than sharing no band
CACHE_WORDS = 500_000
BLOCK = 2048                # classes of a bucket that are compared at once
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "replace").lower().split()      # on bytes: A-Z only, and [\x20\x09-\x0D]
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:n - size + 1 + i])
    return np.unique(out)


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def minhashes(s: np.ndarray) -> np.ndarray:
    """One sample per seed: the smallest product of any shingle and the seed."""
    out = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(out, (s[k:k + 2048, None] * _SEEDS).min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray, rows: int = ROWS) -> np.ndarray:
    k = np.arange(1, len(m) // rows + 1, dtype=np.uint64)
    for i in range(rows):
        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + m[i::rows])
    return k.view(np.int64)


def odd_sketch(m: np.ndarray) -> bytes:
    """Parity bitmap of the samples: each flips one bit."""
    at = mix(m ^ (_SEEDS << np.uint64(1))) % np.uint64(64 * SKETCH_WORDS)
    bits = np.bincount(at.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def estimate(ones):
    """Similarity from the number of ones in two sketches' XOR."""
    m = 64.0 * SKETCH_WORDS
    left = np.maximum(1 - 2 * np.asarray(ones, dtype=np.float64) / m, 1e-9)
    return 1 + m * np.log(left) / (4 * BANDS * ROWS)


def linked(inter, na, nb, percent):
    return 100 * inter >= percent * (na + nb - inter)


def signatures(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n, node, bands, sketch, text_hash)`` of ``(doc_id, text)``;
    node is the digest of the set, null for a text without words."""
    def run(batches):
        cache = worker_state("near_dup_words", _WordHashes)
        for b in batches:
            n, node, bands, sketch = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, cache)
                n.append(len(s))
                m = minhashes(s) if len(s) else None
                node.append(set_digest(s) if len(s) else None)
                bands.append(band_keys(m, rows) if len(s) else None)
                sketch.append(odd_sketch(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(sketch, pa.binary()), b.column(2)], names=["doc_id", "n", "node", "bands", "sketch", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, n long, node binary, bands array<long>, sketch binary, text_hash long")


def full_sets(docs: DataFrame) -> DataFrame:
    """``(node, n, set)``: the whole shingle sets, as bytes of sorted hashes."""
    def run(batches):
        cache = worker_state("near_dup_words", _WordHashes)
        for b in batches:
            sets = [s for s in (shingles(t, cache) for t in b.column(1).to_pylist()) if len(s)]
            for k in range(0, len(sets), 500):
                part = sets[k:k + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_digest(s) for s in part], pa.binary()), pa.array([len(s) for s in part], pa.int64()),
                     pa.array([s.tobytes() for s in part], pa.binary())], names=["node", "n", "set"])

    return docs.mapInArrow(run, "node binary, n long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                keep.append(bool(linked(int((t[at] == s).sum()), len(s), len(t), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
                 .mapInArrow(run, "a binary, b binary").distinct())


def _ones(a, b):
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def bucket_links(pdf: pd.DataFrame, percent: int, least: float) -> list:
    """Links that join different components among the rows of one block pair.
    ``side`` 0 and 1 are compared with each other, or all rows if there is one side."""
    pdf = pdf.drop_duplicates(["side", "node"]).reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
    size = np.array([len(s) for s in sets])
    sketch = np.array([np.frombuffer(x, np.uint64) for x in pdf["sketch"]]).reshape(len(pdf), -1)
    side = pdf["side"].to_numpy()
    comp = pd.factorize(pdf["comp"])[0].copy()
    two = side.max(initial=0) > 0
    out = []
    for i in range(len(pdf)):
        if two and side[i]:
            continue
        js = np.flatnonzero((comp != comp[i]) & ((side == 1) if two else (np.arange(len(pdf)) > i)))
        # sizes alone bound the similarity; sketches drop what seems far below
        js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
        js = js[estimate(_ones(sketch[js], sketch[i])) >= least]
        for k in range(0, len(js), 256):
            part = js[k:k + 256]
            part = part[comp[part] != comp[i]]
            if not len(part):
                continue
            flat = np.concatenate([sets[j] for j in part])
            at = np.searchsorted(sets[i], flat)
            at[at == size[i]] = 0
            hit = np.add.reduceat(sets[i][at] == flat, np.concatenate([[0], np.cumsum(size[part])[:-1]]), dtype=np.int64)
            for j in part[linked(hit, size[i], size[part], percent)]:
                if comp[j] != comp[i]:
                    out.append((pdf["node"][i], pdf["node"][j]))
                    comp[comp == comp[j]] = comp[i]
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)``, one row per input row.

    Documents are linked when ``100 * intersection >= percent * union`` of
    their shingle sets; ``component_id`` is the smallest id reachable.  A text
    that is null or has no word has no set and is linked with nothing.  Null
    ids never become a component id unless all of a component are null.  Rows
    that repeat an id and a text are marked alike.  An empty table gives an
    empty result.
    """
    docs = id_text(docs, id_col, text_col)
    least = percent / 100 - MARGIN
    rows = cut_lineage(signatures(docs, ROWS if percent >= 85 else LOW_ROWS))
    classes = cut_lineage(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    # buckets with company
    keys = classes.select("node", F.explode("bands").alias("key"))
    ends = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    buckets = cut_lineage(keys.join(ends, "key"))
    who = buckets.select("node").distinct()
    sources = classes.join(who, "node").select(F.col("rep_id").alias("id")).distinct()
    sets = cut_lineage(full_sets(docs.join(sources, docs["doc_id"].eqNullSafe(sources["id"]), "left_semi")))

    # 1. the ends of every bucket
    star = (buckets.select("node", F.explode(F.array("lo", "hi")).alias("end")).where("node <> end")
                   .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct())
    sk = classes.select("node", "n", "sketch")
    star = (star.join(sk.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "a")
                .join(sk.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "b")
                .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
                .where(_sketch_ones("ka", "kb") <= _most_ones(least)).select("a", "b"))
    first = cut_lineage(confirmed(star, sets, percent))
    roots = components(first)

    # 2. buckets that still hold several components
    held = buckets.select("key", "node").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).where(
        "x <> y AND m > 2").select("key", "m")      # two classes have met already
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    member = (held.join(mixed, "key").withColumn("blocks", blocks)
                  .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # block pairs (i, j), i <= j, that a member's block takes part in
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    member = member.withColumn("pair", F.explode(pair)).select(
        "key", "node", "comp", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"),
        ((F.col("pair.i") != F.col("pair.j")) & (F.col("block") == F.col("pair.j"))).cast("int").alias("side"))
    member = member.join(classes.select("node", "sketch"), "node").join(sets.select("node", "set"), "node")

    def search(key, pdf):
        return pd.DataFrame(bucket_links(pdf, percent, least), columns=["a", "b"])

    more = member.groupBy("key", "i", "j").applyInPandas(search, "a binary, b binary")
    final = components(first.unionAll(more))
    best = (classes.select("node", "rep_id").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = best.groupBy("root").agg(F.min("rep_id").alias("component_id")).join(
        best.select("root", "node"), "root").select("node", "component_id")
    out = rows.select("doc_id", "n", "node", "text_hash").join(best, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"),
                      "text_hash")


def representatives(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the kept one of their
    component.  Rows are told apart by id and text; where the kept id of a
    component is null, all its rows stay."""
    gone = (near_duplicates(docs, percent, id_col, text_col).where("NOT kept")
            .select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct())
    same = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_gone_text")
    return docs.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("_gone")) & same, "left_anti")


def _most_ones(least: float) -> int:
    """The largest XOR count whose estimate still reaches ``least``."""
    return max(k for k in range(64 * SKETCH_WORDS + 1) if estimate(k) >= least)


def _sketch_ones(a: str, b: str):
    """Population count of two binary sketches' XOR, word by word."""
    def word(c, i):
        return F.conv(F.hex(F.substring(F.col(c), 8 * i + 1, 8)), 16, -10).cast("bigint")

    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(SKETCH_WORDS)), F.lit(0))


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
