"""Removal of long repeated byte strings by a sparse suffix array.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else goes.
Sorting a suffix at every byte is not needed: suffixes start at anchors, the
positions whose ``GRAM``-byte string has the smallest hash of some window.  All
grams of a repeated string are repeated, so both occurrences have an anchor at
the same place.  A suffix's tokens are the hash of its gram and of the context
on both sides that a repeated string through the gram can reach.

1. Tasks find anchors; equal tokens within a batch of texts meet at once.
2. Sampled splitters range-partition the suffixes by leading tokens.  Buckets
   sort locally by multikey quicksort and compare neighbours; runs that reach
   a bucket's end are compared across the boundary.  Suffixes alike in both
   tokens are repeated as far as they reach.
3. Suffixes alike in the gram only are compared byte by byte, offset by offset.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import id_text, task_count
from factlake.session import checkpoint_dir

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM           # bytes of context on each side
BATCH_BYTES = 250_000
BUCKET_ROWS = 400_000
CHUNK_ROWS = 32_768             # contexts of one gram that are compared in one task; beyond it Spark groups the windows
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder and read again: cuts
    lineage like a checkpoint, at a column format's size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------- anchors
class Hasher:
    """Hashes of any range of a buffer from prefix sums: byte i weighs ODD ** i."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power = np.full(n + 1, _ODD, np.uint64)
        power[0] = 1
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[buf] * np.multiply.accumulate(power)[:n], out=self.sums[1:])

    def __call__(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values the index of its leftmost minimum."""
    n = len(h) - w + 1
    size = -(-len(h) // w) * w
    a = np.full(size, _TOP, np.uint64)
    a[:len(h)] = h
    a = a.reshape(-1, w)
    col = np.arange(w)

    def running(b, strict):
        low = np.minimum.accumulate(b, axis=1)
        better = np.ones(b.shape, bool)
        better[:, 1:] = b[:, 1:] < low[:, :-1] if strict else b[:, 1:] <= low[:, :-1]
        return low.ravel(), np.maximum.accumulate(np.where(better, col, 0), axis=1).ravel()

    block = np.repeat(np.arange(len(a)) * w, w)
    pre, at = running(a, True)
    pre_at = block + at
    suf, at = running(a[:, ::-1], False)
    suf = suf.reshape(-1, w)[:, ::-1].ravel()
    suf_at = block + (w - 1 - at.reshape(-1, w)[:, ::-1].ravel())
    i = np.arange(n)
    j = i + w - 1
    return np.where(suf[i] <= pre[j], suf_at[i], pre_at[j])


def anchors(texts: list) -> tuple:
    """Anchors of byte strings: ``(text, position, gram token, context token)``."""
    size = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(size) - size
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = Hasher(buf)
    pos = np.arange(len(buf) - GRAM + 1)
    h = hasher(pos, pos + GRAM)
    owner = np.repeat(np.arange(len(texts)), size)
    inside = owner[:len(buf) - LENGTH + 1] == owner[LENGTH - 1:]     # windows within one text
    at = np.unique(leftmost_minima(h, REACH + 1)[inside])
    text = owner[at]
    left = np.minimum(at - start[text], REACH)
    right = np.minimum(start[text] + size[text] - at - GRAM, REACH)
    c = mix(hasher(at - left, at) * _ODD + hasher(at + GRAM, at + GRAM + right) + mix((left * (REACH + 1) + right).astype(np.uint64)))
    return text, at - start[text], h[at], c


def reach(pos, size):
    """Bytes of context that a text of ``size`` bytes has on each side."""
    return np.minimum(pos, REACH), np.minimum(size - pos - GRAM, REACH)


def merged(starts, ends) -> list:
    """Maximal runs of a union of intervals."""
    out = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


RECORD = "kind int, g long, c long, m long, doc_id long, th long, size long, pos long, stop long"


def suffix_records(docs: DataFrame) -> DataFrame:
    """Kind 0: suffixes, one per pair of tokens and batch, ``m`` of them.
    Kind 1: ranges ``pos..stop`` of a text that are repeated within the batch."""
    def batch(ids, texts):
        raw = [t.encode("utf-8", "replace") for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        th = np.array([xxhash.xxh64_intdigest(r, seed=42) for r in raw], np.uint64).view(np.int64)
        text, pos, g, c = anchors(raw)
        order = np.lexsort((c, g))
        new = np.ones(len(order), bool)
        new[1:] = (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1])
        first = np.flatnonzero(new)
        m = np.diff(np.append(first, len(order)))
        rep = order[first]
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(m > 1, m)
        left, right = reach(pos, size[text])
        again &= left + right >= REACH
        rows = [(1, 0, 0, 0, None, int(th[k]), int(size[k]), s, e)
                for k in np.unique(text[again])
                for s, e in merged((pos - left)[again & (text == k)].tolist(), (pos + GRAM + right)[again & (text == k)].tolist())] \
            if again.any() else []
        k = text[rep]
        null = np.array([i is None for i in ids])
        doc = pa.array(np.array([0 if i is None else i for i in ids], np.int64)[k], mask=null[k])
        cols = [np.zeros(len(rep), np.int32), g[rep].view(np.int64), c[rep].view(np.int64), m, doc, th[k], size[k], pos[rep],
                np.zeros(len(rep), np.int64)]
        names = [x.split()[0] for x in RECORD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)
        if rows:
            kinds = [pa.int32()] + [pa.int64()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        ids, texts, total = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                total += len(t)
                if total >= BATCH_BYTES:
                    yield from batch(ids, texts)
                    ids, texts, total = [], [], 0
        if texts:
            yield from batch(ids, texts)

    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(run, RECORD)


# ------------------------------------------------------------- sorted buckets
def multikey_quicksort(columns: list, small: int = 4096) -> np.ndarray:
    """Order of rows by token columns: split three ways by the first token,
    go on to the next token only among equal ones.  Short stretches, and the
    last token, are sorted directly."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2:
            continue
        part = order[a:b]
        if b - a <= small or depth == len(columns) - 1:
            order[a:b] = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
            continue
        key = columns[depth][part]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, same = key < pivot, key == pivot
        order[a:b] = np.concatenate([part[less], part[same], part[~(less | same)]])
        x, y = a + int(less.sum()), a + int(less.sum() + same.sum())
        todo += [(a, x, depth), (x, y, depth + 1), (y, b, depth)]
    return order


SUFFIX = "g long, c long, doc_id long, th long, size long, pos long, gm long, cm long, cs long, bucket long, ends int"


def compare_bucket(t: pa.Table, bucket: int) -> pa.Table:
    """Suffixes whose gram a neighbour shares, with the run's size ``gm``, the
    number ``cm`` alike in both tokens and the number ``cs`` of different
    contexts; runs at the bucket's ends (``ends``: 1 gram, 2 also context) are
    kept for the comparison across the boundary."""
    g, c, m = (t[x].to_numpy() for x in ("g", "c", "m"))
    order = multikey_quicksort([g, c, t["th"].to_numpy(), t["pos"].to_numpy()])
    g, c, m = g[order], c[order], m[order]
    n = len(order)
    new_g = np.append(True, g[1:] != g[:-1])
    new_c = new_g | np.append(True, c[1:] != c[:-1])
    gi, ci = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    gm = np.bincount(gi, m).astype(np.int64)[gi]
    cm = np.bincount(ci, m).astype(np.int64)[ci]
    cs = np.bincount(gi, new_c).astype(np.int64)[gi]
    ends = ((gi == 0) | (gi == gi[-1])).astype(np.int32) + ((ci == 0) | (ci == ci[-1]))
    keep = (gm > 1) | (ends > 0)
    t = t.take(pa.array(order[keep]))
    out = {x: t[x] for x in ("g", "c", "doc_id", "th", "size", "pos")}
    return pa.table(out | {"gm": gm[keep], "cm": cm[keep], "cs": cs[keep], "bucket": np.full(int(keep.sum()), bucket, np.int64),
                           "ends": ends[keep].astype(np.int32)}) if n else None


def repeated_suffixes(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(g, c, doc_id, th, size, pos, gm, cm, cs)`` of suffixes with company."""
    suffixes = records.where("kind = 0").drop("kind", "stop")
    n = task_count(records.sparkSession, suffixes.count(), bucket_rows)

    def run(batches):
        from pyspark import TaskContext
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from compare_bucket(pa.Table.from_batches(rows), TaskContext.get().partitionId()).to_batches(max_chunksize=50_000)

    found = stored(suffixes.repartitionByRange(n, "g", "c", "th", "pos").mapInArrow(run, SUFFIX))
    # across boundaries: at most two runs of each kind per bucket, so these tables are bounded by the number of buckets
    over_g = (found.where("ends >= 1").select("bucket", "g", "gm", "cs").distinct()
                   .groupBy("g").agg(F.sum("gm").alias("gm2"), F.sum("cs").alias("cs2")))
    over_c = (found.where("ends = 2").select("bucket", "g", "c", "cm").distinct().groupBy("g", "c").agg(F.sum("cm").alias("cm2")))
    out = found.join(F.broadcast(over_g), "g", "left").join(F.broadcast(over_c), ["g", "c"], "left")
    return out.select("g", "c", "doc_id", "th", "size", "pos", F.coalesce("gm2", "gm").alias("gm"), F.coalesce("cm2", "cm").alias("cm"),
                      F.coalesce("cs2", "cs").alias("cs")).where("gm > 1")


# ------------------------------------------------------------------- contexts
def window_keys(g, left, right):
    """Yields, for each offset o, which rows have a window reaching o bytes to
    the left of the gram, and the windows' hashes."""
    rows = len(g)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    pad_l = np.frombuffer(b"".join(x[::-1].ljust(REACH, b"\0") for x in left), np.uint8).reshape(rows, REACH)
    pad_r = np.frombuffer(b"".join(x.ljust(REACH, b"\0") for x in right), np.uint8).reshape(rows, REACH)
    to_right = np.empty((REACH + 1, rows), np.uint64)
    to_right[0] = mix(g.view(np.uint64) + _ODD)
    for i in range(REACH):
        to_right[i + 1] = mix(to_right[i] * _ODD + pad_r[:, i])
    to_left = mix(g.view(np.uint64) ^ _ODD)
    for o in range(REACH + 1):
        yield o, (size_l >= o) & (size_r >= REACH - o), mix(to_left + to_right[REACH - o] * _ODD)
        if o < REACH:
            to_left = mix(to_left * _ODD + pad_l[:, o])


def shared_offsets(g, left, right) -> tuple:
    """Smallest and largest offset of each row's windows that another row has too; -1 if none."""
    low, high = np.full(len(g), -1, np.int64), np.full(len(g), -1, np.int64)
    for o, valid, key in window_keys(g, left, right):
        at = np.flatnonzero(valid)
        _, inverse, count = np.unique(key[at], return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return low, high


def partial_ranges(found: DataFrame, docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ranges ``(th, size, pos, stop)`` of suffixes alike in the gram only."""
    many = found.where("cs > 1")
    reps = many.groupBy("g", "c").agg(F.min(F.struct("doc_id", "th", "size", "pos")).alias("r"), F.max("cm").alias("cm"), F.max("cs").alias("cs"))
    places = (reps.select("g", "c", "cm", "cs", "r.*").groupBy("doc_id", "th", "size")
                  .agg(F.collect_list(F.struct("g", "c", "cm", "cs", "pos")).alias("at"))
                  .select(F.col("doc_id").alias("_d"), "th", "size", "at"))

    def cut(batches):
        for b in batches:
            for text, th, size, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = text.encode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["g"] for x in at], pa.int64()), pa.array([x["cm"] for x in at], pa.int64()),
                    pa.array([x["cs"] for x in at], pa.int64()), pa.array([th] * len(at), pa.int64()), pa.array([size] * len(at), pa.int64()),
                    pa.array([x["pos"] for x in at], pa.int64()),
                    pa.array([raw[max(0, x["pos"] - REACH):x["pos"]] for x in at], pa.binary()),
                    pa.array([raw[x["pos"] + GRAM:x["pos"] + LENGTH] for x in at], pa.binary())],
                    names=["g", "cm", "cs", "th", "size", "pos", "left", "right"])

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.octet_length("text").cast("bigint").alias("size"))
    d = d.join(places, (d["th"] == places["th"]) & (d["size"] == places["size"]) & d["doc_id"].eqNullSafe(places["_d"]))
    # rows that repeat id and text give a context twice: one is enough
    contexts = stored(d.select("text", places["th"], places["size"], "at").mapInArrow(
        cut, "g long, cm long, cs long, th long, size long, pos long, left binary, right binary"))
    unique = contexts.dropDuplicates(["g", "th", "size", "pos"])

    def search(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        g = t["g"].to_numpy()
        order = np.argsort(g, kind="stable")
        t, g = t.take(pa.array(order)), g[order]
        starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        a = 0
        for k in range(1, len(starts)):       # whole grams, about chunk_rows at a time
            if k + 1 < len(starts) and starts[k + 1] - starts[a] <= chunk_rows:
                continue
            s = t.slice(starts[a], starts[k] - starts[a])
            a = k
            low, high = shared_offsets(s["g"].to_numpy(), s["left"].to_pylist(), s["right"].to_pylist())
            hit = (high >= 0) & (s["cm"].to_numpy() == 1)
            pos = s["pos"].to_numpy()[hit]
            yield pa.RecordBatch.from_arrays([pa.array(s["th"].to_numpy()[hit]), pa.array(s["size"].to_numpy()[hit]),
                                              pa.array(pos - high[hit]), pa.array(pos - low[hit] + LENGTH)], names=["th", "size", "pos", "stop"])

    out = "th long, size long, pos long, stop long"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = unique.where(F.col("cs") <= chunk_rows).drop("cs").repartition(n, "g").mapInArrow(search, out)

    def windows(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                x = b.slice(s, 2048)
                for o, valid, key in window_keys(x.column(0).to_numpy(), x.column(6).to_pylist(), x.column(7).to_pylist()):
                    at = pa.array(valid)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), x.column(0), x.column(1), x.column(3), x.column(4), x.column(5),
                                                      pa.array(np.full(x.num_rows, o))], names=["w", "g", "cm", "th", "size", "pos", "o"]).filter(at)

    # more contexts of one gram than a task compares: their windows are grouped by Spark, with partial counts
    win = unique.where(F.col("cs") > chunk_rows).mapInArrow(windows, "w long, g long, cm long, th long, size long, pos long, o long")
    common = win.groupBy("w", "g", "o").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lots = (win.where("cm = 1").join(common, ["w", "g", "o"], "left_semi").groupBy("g", "th", "size", "pos")
               .agg(F.min("o").alias("low"), F.max("o").alias("high"))
               .select("th", "size", (F.col("pos") - F.col("high")).alias("pos"), (F.col("pos") - F.col("low") + LENGTH).alias("stop")))
    return few.unionAll(lots)


# -------------------------------------------------------------------- removal
def repeated_ranges(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(th, size, ranges array<struct<pos, stop>>)`` for texts with repeated
    strings; a text is known by its hash and length."""
    records = stored(suffix_records(docs))
    found = stored(repeated_suffixes(records, bucket_rows))
    left = F.least(F.col("pos"), F.lit(REACH))
    right = F.least(F.col("size") - F.col("pos") - GRAM, F.lit(REACH))
    whole = (found.where("cm > 1").where(left + right >= REACH)
                  .select("th", "size", (F.col("pos") - left).alias("pos"), (F.col("pos") + GRAM + right).alias("stop")))
    ranges = records.where("kind = 1").select("th", "size", "pos", "stop").unionAll(whole).unionAll(partial_ranges(found, docs, chunk_rows))
    return ranges.groupBy("th", "size").agg(F.collect_set(F.struct("pos", "stop")).alias("ranges"))


def _with_ranges(docs, bucket_rows, chunk_rows, make, fields):
    """One row per document from ``make(id, bytes, merged ranges)``."""
    ranges = repeated_ranges(docs, bucket_rows, chunk_rows).select(F.col("th").alias("_th"), F.col("size").alias("_size"), "ranges")
    d = docs.join(ranges, (F.xxhash64("text") == F.col("_th")) & (F.octet_length("text") == F.col("_size")), "left")

    def run(batches):
        for b in batches:
            rows = []
            for i, t, r in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = t.encode("utf-8", "replace")
                rows.append(make(i, raw, merged([x["pos"] for x in r], [x["stop"] for x in r]) if r else []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), fields)], names=[f[0] for f in fields])

    return d.select("doc_id", "text", "ranges").mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in fields))


def removed_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row.

    Null and empty texts, and texts shorter than ``LENGTH`` bytes, lose
    nothing.  Repeated rows are repeated texts: all of a long one goes.  A null
    id stays null; an empty table gives an empty result.
    """
    def make(i, raw, runs):
        at, h = 0, hashlib.sha256()
        for s, e in runs:
            h.update(raw[at:s])
            at = e
        h.update(raw[at:])
        return i, len(raw), sum(e - s for s, e in runs), len(runs), h.hexdigest()

    return _with_ranges(id_text(docs, id_col, text_col), bucket_rows, chunk_rows, make,
                     [*((n, pa.int64(), "long") for n in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string(), "string")])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<start, end>>)``: the maximal removed byte runs."""
    return _with_ranges(id_text(docs, id_col, text_col), BUCKET_ROWS, CHUNK_ROWS,
                        lambda i, raw, runs: (i, [{"start": s, "end": e} for s, e in runs]),
                        [("doc_id", pa.int64(), "long"), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                                                          "array<struct<start: long, end: long>>")])
