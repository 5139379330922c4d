"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Rows stay in their Spark partition; nothing is shuffled.  Texts are cut into
units (white space plus the non-space run behind it; no match of the split
pattern crosses such a cut), units into pattern matches, and the distinct
units not met before are encoded by a recursive query: token-position rows
join the merge table, and each round contracts every word's leftmost pair of
minimum rank until no pair of any word is in the table.  An ordered
aggregation over the vocabulary turns ids back into bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factlake.llm.common import WHITE, coded, id_text, worker_state

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_OUT = "doc_id long, ids array<int>"
CACHE_UNITS = 600_000       # distinct units in each of the two generations that a worker remembers
BATCH_CHARS = 8_000_000     # text looked at together
WORDS_PER_QUERY = 60_000    # words that one recursive query contracts
ROUNDS = 64                 # rounds of one query: a longer word goes through several, so its rows stay bounded
_RANK = 1 << 32

# A row is a token at a position of a word, with the position and id of its
# successor (-1: none).  b: each word's best (rank, position) and the position
# it swallows; e: what stands behind that; then the swallowed row goes and its
# neighbours are joined up.
ENCODE = f"""
WITH RECURSIVE step(i, w, pos, tok, next_pos, next_tok) AS (
  SELECT 0, w, pos, tok, next_pos, next_tok FROM start
  UNION ALL
  (WITH b AS (SELECT w, min(g.m::BIGINT * {_RANK} + pos) AS best, arg_min(next_pos, g.m::BIGINT * {_RANK} + pos) AS gone
              FROM step JOIN merges g ON g.pair = step.tok::BIGINT * {_RANK} + step.next_tok WHERE i < {ROUNDS} GROUP BY w),
   e AS (SELECT b.w, (best % {_RANK})::INTEGER AS hit, (best // {_RANK})::INTEGER AS m, gone, s.next_pos AS end_pos,
                s.next_tok AS end_tok FROM b JOIN step s ON s.w = b.w AND s.pos = b.gone)
   SELECT s.i + 1, s.w, s.pos, CASE WHEN s.pos = hit THEN m ELSE s.tok END,
          CASE WHEN s.pos = hit THEN end_pos ELSE s.next_pos END,
          CASE WHEN s.pos = hit THEN end_tok WHEN s.next_pos = hit THEN m ELSE s.next_tok END
   FROM step s JOIN e ON e.w = s.w WHERE s.pos <> gone))
SELECT s.w, s.pos, s.tok, s.next_pos, s.next_tok, s.i
FROM step s JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) z ON z.w = s.w AND z.i = s.i
"""
DECODE = """
SELECT w, string_agg(' ' || tok::VARCHAR, '' ORDER BY pos) AS ids, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM tokens JOIN vocabulary v USING (tok) GROUP BY w ORDER BY w
"""
_COLUMNS = ("w", "pos", "tok", "next_pos", "next_tok")


class Codec:
    """The merge and vocabulary tables of one rank file in a DuckDB connection."""

    def __init__(self, rank_lines: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        merges = [(ranks[t[:i]] * _RANK + ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self._table("merges", {"pair": np.array([m[0] for m in merges], dtype=np.int64),
                               "m": np.array([m[1] for m in merges], dtype=np.int32)}, keep=True)
        self._table("vocabulary", {"tok": np.array(list(ranks.values()), dtype=np.int32), "hex": [t.hex() for t in ranks]}, keep=True)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.pattern = regex.compile(pattern)
        # what a unit, or a match of the pattern by itself, becomes: ids, each after a space, and bytes
        self.ids, self.bytes = {}, {}
        self.old = {}, {}      # the generation before

    def _table(self, name, columns, keep=False):
        t = pa.table(columns)
        self.con.register("arrow_" + name if keep else name, t)
        if keep:
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_{name}")
            self.con.unregister("arrow_" + name)

    def encode_words(self, words: list) -> tuple:
        """Ids and decoded bytes of each byte string."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        tok = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        end = np.append(w[1:] != w[:-1], True)
        rows = (w, pos, tok, np.where(end, -1, pos + 1).astype(np.int32), np.where(end, -1, np.append(tok[1:], 0)).astype(np.int32))
        done = []
        while len(rows[0]):
            self._table("start", dict(zip(_COLUMNS, rows)))
            r = self.con.execute(ENCODE).fetchnumpy()
            on = np.asarray(r["i"]) == ROUNDS     # these words may have pairs left
            done.append([np.asarray(r[c])[~on] for c in _COLUMNS[:3]])
            rows = [np.asarray(r[c])[on] for c in _COLUMNS]
        self._table("tokens", dict(zip(_COLUMNS, (np.concatenate(x) for x in zip(*done)))))
        r = self.con.execute(DECODE).fetchnumpy()
        return r["ids"].tolist(), list(map(bytes.fromhex, r["hex"].tolist()))

    def learn(self, units: list) -> None:
        """Encode units, each match of the pattern by itself, and remember them."""
        ids, raw = self.ids, self.bytes
        many, words = {}, {}
        for u in units:
            if u[0] == " " and u[1:].isalpha() and u.isascii():
                words[u] = None
                continue
            parts = self.pattern.findall(u)
            words.update(dict.fromkeys(parts))
            if len(parts) > 1:
                many[u] = parts
        self._recall(words)
        new = [p for p in words if p not in ids]
        for s in range(0, len(new), WORDS_PER_QUERY):
            chunk = new[s:s + WORDS_PER_QUERY]
            a, b = self.encode_words([p.encode() for p in chunk])
            ids.update(zip(chunk, a))
            raw.update(zip(chunk, b))
        for u, parts in many.items():
            at = itemgetter(*parts)
            ids[u] = "".join(at(ids))
            raw[u] = b"".join(at(raw))

    def _recall(self, units):
        """Carry over what the generation before knows."""
        ids, raw = self.old
        for u in units:
            if u in ids:
                self.ids[u], self.bytes[u] = ids[u], raw[u]

    def texts(self, texts: list):
        """``(number of ids, ids after spaces, decoded bytes)`` of each text,
        the last two as buffers."""
        ends, codes, units = coded([self.units.findall(t) for t in texts])
        new = [u for u in units if u not in self.ids]
        if len(self.ids) + len(new) > CACHE_UNITS and self.ids:
            self.old = self.ids, self.bytes
            self.ids, self.bytes = {}, {}
            new = units
        self._recall(new)
        new = [u for u in new if u not in self.ids]
        if new:
            self.learn(new)
        ids = [self.ids[u] for u in units]
        n = np.append(0, np.cumsum(np.array([i.count(" ") for i in ids], dtype=np.int64)[codes])) if ids else np.zeros(1, np.int64)
        flat = [pa.array(v, pa.large_binary()).take(pa.array(codes)) for v in (ids, [self.bytes[u] for u in units])]
        at = [np.frombuffer(f.buffers()[1], np.int64)[f.offset:] for f in flat]
        raw = [memoryview(f.buffers()[2] or b"") for f in flat]
        for a, b in zip(ends[:-1], ends[1:]):
            yield int(n[b] - n[a]), *(r[o[a]:o[b]] for r, o in zip(raw, at))


def _groups(ids, texts):
    """Rows in groups of about BATCH_CHARS characters; a text is never cut."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield ids[a:i + 1], texts[a:i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]


def _over(docs, ranks_file, pattern, make, schema):
    spark = docs.sparkSession
    with open(ranks_file, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())    # a vocabulary file: its size does not depend on the data
    key = "codec_" + hashlib.sha256(lines.value + pattern.encode()).hexdigest()[:16]

    def run(batches):
        codec = worker_state(key, lambda: Codec(lines.value, pattern))
        for b in batches:
            for ids, texts in _groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield make(ids, codec.texts(texts))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text."""
    def make(ids, rows):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
            [[int(x) for x in bytes(r).split()] for _, r, _ in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _over(id_text(docs, id_col, text_col), ranks_file, pattern, make, IDS_OUT)


def encode_decode_digest(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row.

    Null and empty texts have no tokens and the digests of nothing.  Repeated
    rows give repeated results; a null id stays null; an empty table gives an
    empty result.  A match of the pattern takes as many rounds as it has
    merges, so a single unbroken run of letters costs the square of its length.
    """
    def make(ids, rows):
        n, a, b = [], [], []
        for k, r, raw in rows:
            n.append(k)
            a.append(hashlib.sha256(r[1:]).hexdigest())
            b.append(hashlib.sha256(raw).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over(id_text(docs, id_col, text_col), ranks_file, pattern, make, OUT)
