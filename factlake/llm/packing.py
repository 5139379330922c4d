"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents become token ids (plus a separator), longer ones are cut into whole
sequences and a rest.  Pieces are dealt to groups in turn, so a group has a
bounded number of pieces whatever the input; each group packs its own with the
best-two-fit rule: fill a bin greedily with the largest piece that fits, then
take the bin's smallest piece out again if two unpacked pieces fill the gap so
expanded more tightly.  A group leaves about one bin part empty, so the loss
is one sequence in thousands.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from factlake.llm.common import WHITE, coded, id_text, task_count, worker_state
from factlake.session import cut_lineage

CACHE_UNITS = 700_000
BATCH_CHARS = 8_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class UnitTokenizer:
    """Token ids of texts through a cache of white-space-delimited units: the
    tokenizer drops white space and never looks across it.  New units go to
    the tokenizer in long lines; tokens that end a word part them again."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.odd = re.compile("[\x1c-\x1f]")      # str.split() would also split at these
        self.split = re.compile(f"[^{WHITE}]+")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # units of one match of the split pattern, or two: as many word ends
        signs = r'[!-&(-/:;=?@\[-`{}~]+'
        self.simple = regex.compile(rf"\p{{L}}+|{signs}")
        self.letter = regex.compile(r"\p{L}+")
        self.tail = regex.compile(rf"(\p{{L}}+)({signs})")
        self.cache: dict = {}

    def one_by_one(self, words: list) -> list:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def words(self, words: list) -> list:
        """Ids of words that should have one word end each; a line where that
        does not come out is taken word by word."""
        parts = [words[i:i + 100] for i in range(0, len(words), 100)]
        out = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(part) or at[-1] != len(ids):
                out += self.one_by_one(part)
                continue
            raw = ids.tobytes()
            out += [raw[4 * i:4 * j] for i, j in zip([0, *at[:-1].tolist()], at.tolist())]
        return out

    def letters(self, word: str) -> bool:
        """Whether a word of letters is one after the tokenizer's NFC and lower
        case too: both may put a combining mark into it, which ends a word."""
        return word.isascii() or bool(self.letter.fullmatch(unicodedata.normalize("NFC", word).lower()))

    def learn(self, units) -> None:
        simple, tails, rest = {}, [], []
        for u in units:
            if (u.isalpha() or self.simple.fullmatch(u)) and self.letters(u):
                simple[u] = None
            elif (m := self.tail.fullmatch(u)) and self.letters(m[1]):
                tails.append((u, m[1], m[2]))
                simple[m[1]] = simple[m[2]] = None
            else:
                rest.append(u)
        new = [u for u in simple if u not in self.cache]
        self.cache.update(zip(new, self.words(new)))
        self.cache.update(zip(rest, self.one_by_one(rest)))
        for u, a, b in tails:
            self.cache[u] = self.cache[a] + self.cache[b]

    def units(self, text: str) -> list:
        if self.odd.search(text):
            return self.split.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.lower().split()     # the tokenizer lowers case too; here that leaves fewer units

    def texts(self, texts: list):
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        ends, codes, units = coded([self.units(t) for t in texts])
        new = [u for u in units if u not in self.cache]
        if len(self.cache) + len(new) > CACHE_UNITS and self.cache:
            self.cache = {}
            new = units
        self.learn(new)
        values = [self.cache[u] for u in units]
        ids = np.frombuffer(b"".join(values), dtype="<u4")
        length = np.array([len(v) // 4 for v in values], dtype=np.int64)
        n = length[codes]
        until = np.append(0, np.cumsum(n))
        ids = ids[np.repeat((np.cumsum(length) - length)[codes] - until[:-1], n) + np.arange(until[-1])]
        for a, b in zip(until[ends[:-1]], until[ends[1:]]):
            yield ids[a:b].tobytes()


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: every document's
    ids and the separator, cut at ``capacity``.  A null or empty text is the
    separator alone."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())     # a vocabulary file: not sized by the data
    key = f"tokenizer_{zlib.crc32(spec.value.encode())}"
    end = np.array([separator], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        tok = worker_state(key, lambda: UnitTokenizer(spec.value))
        for b in batches:
            all_ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            a, size = 0, 0
            for i, t in enumerate(all_texts):
                size += len(t)
                if size < BATCH_CHARS and i + 1 < len(all_texts):
                    continue
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, raw in zip(all_ids[a:i + 1], tok.texts(all_texts[a:i + 1])):
                    raw += end
                    for k in range(0, len(raw), width):
                        part = raw[k:k + width]
                        doc.append(d)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                a, size = i + 1, 0
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple:
    """``(bin, offset)`` of each piece.  Equal lengths are interchangeable, so
    the unpacked pieces are one count per length."""
    order = np.argsort(lengths, kind="stable")
    top = np.searchsorted(lengths[order], np.arange(capacity + 2))   # order[top[n]:top[n+1]] have length n
    left, used = np.diff(top), np.zeros(capacity + 1, np.int64)
    present = np.flatnonzero(left)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def largest(limit):
        nonlocal present
        while True:
            i = np.searchsorted(present, limit, side="right") - 1
            if i < 0:
                return 0
            if left[present[i]]:
                return int(present[i])
            present = present[left[present] > 0]

    b = 0
    while True:
        n = largest(capacity)
        if not n:
            return bins, offsets
        room, held = capacity, []
        while n:
            left[n] -= 1
            held.append(n)
            room -= n
            n = largest(room) if room else 0
        if room and len(held) > 1:
            small = held[-1]                  # greedy takes lengths in falling order
            gap = room + small
            live = present[left[present] > 0]
            live = live[live < gap]
            if len(live):
                # for each first piece the largest second one that still fits
                j = np.searchsorted(live, gap - live, side="right") - 1
                alone = (j >= 0) & (live[j] == live) & (left[live] < 2)
                j = np.where(alone, j - 1, j)
                total = np.where(j >= 0, live + live[j], 0)
                k = int(np.argmax(total))
                if total[k] > small:
                    held[-1:] = [int(live[k]), int(live[j[k]])]
                    left[live[k]] -= 1
                    left[live[j[k]]] -= 1
                    left[small] += 1
                    if left[small] == 1:
                        present = np.union1d(present, [small])
        at = 0
        for n in held:
            i = order[top[n] + used[n]]
            used[n] += 1
            bins[i], offsets[i] = b, at
            at += n
        b += 1


def pack(table: DataFrame, capacity: int = 2048, group_pieces: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces (other columns
    stay).  Offsets are gapless from 0 in every sequence; sequence ids are
    unique but not consecutive.  Repeated rows are pieces of their own."""
    n = table.count()
    groups = task_count(table.sparkSession, n, group_pieces)
    columns = table.columns
    schema = StructType([*table.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key, pdf):
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf[columns].assign(sequence_id=int(key[0]) * (1 << 32) + bins, offset=offsets)

    return (table.withColumn("_group", F.monotonically_increasing_id() % groups)
                 .groupBy("_group").applyInPandas(run, schema))


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, input_ids array<int>)`` from packed pieces with ids."""
    return (placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
                  .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids")))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Null and empty texts are one separator; a null id is packed like any
    other; repeated rows are packed each; an empty table gives no rows.
    """
    return pack(cut_lineage(pieces(docs, tokenizer_file, capacity, separator, id_col, text_col)), capacity)
