"""Chat formatting by columnar byte assembly.

Turns are range-partitioned by conversation and turn, so a conversation that
holds a third of all turns spreads over tasks like any other rows.  A task lays
out many turns at once: the lengths of all segments (marks, roles, texts, escape
bytes) give cumulative offsets, these give the source of every output byte, and
one indexed copy fills one preallocated Arrow buffer.

A turn reads ``<s>[INST] role [/INST]text</s>``.  Where a role or text holds a
control string, with any number of backslashes behind its first character, one
more backslash goes there; taking one away restores it, so no text can open or
close a turn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.suffix_dedup import stored

OPEN, MIDDLE, CLOSE = b"<s>[INST] ", b" [/INST]", b"</s>"
CONTROL = re.compile(rb"[<\[](?=\\*(?:/?s>|/?INST\]))")      # first byte of a control string in a text
ESCAPED = re.compile(r"([<\[])\\(?=\\*(?:/?s>|/?INST\]))")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
CONSTANTS = b"\\" + OPEN + MIDDLE + CLOSE
SLICE = 4 << 20             # text bytes laid out at once; also the size from which a conversation is cut
BLOCK = 1 << 20             # output bytes whose sources are held at once
PREFIX = 32                 # characters of a text that take part in range partitioning
PIECES = "conv_id long, part long, whole boolean, n_turns long, text string, loss_start array<long>, loss_end array<long>"


def _flat(column) -> tuple:
    """Offsets (from 0) and bytes of a string column, null as empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _marks(offsets: np.ndarray, data: np.ndarray) -> tuple:
    """Rows and byte positions at which an escape byte goes in."""
    # the first pass over the bytes of all rows may look into the next row; such finds are checked alone
    raw = data.tobytes()
    found = [m.end() for m in CONTROL.finditer(raw)]
    at = np.array(found, np.int64)
    row = np.searchsorted(offsets, at - 1, side="right") - 1
    ends = offsets[row + 1].tolist()
    ok = [CONTROL.match(raw, p - 1, z) is not None for p, z in zip(found, ends)]
    return row[ok], at[ok]


def assemble(roles, texts) -> tuple:
    """``(buffer, turn_ends, text_start, text_end, lead)`` of turns laid end to end:
    an Arrow buffer, the byte at which each turn ends, and where its text
    lies, counted in code points from the start, with code points at turn ends."""
    n = len(roles)
    parts = [_flat(roles), _flat(texts)]
    pool = np.concatenate([np.frombuffer(CONSTANTS, np.uint8), parts[0][1], parts[1][1]])
    base = [len(CONSTANTS), len(CONSTANTS) + len(parts[0][1])]
    marks = [_marks(*p) for p in parts]
    count = [np.bincount(m[0], minlength=n) for m in marks]
    # segments of a turn: OPEN, role runs and escapes, MIDDLE, text runs and escapes, CLOSE
    first = np.concatenate([[0], np.cumsum(5 + 2 * count[0] + 2 * count[1])])
    start, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)

    def constant(at, k):
        sizes = np.cumsum([0, 1, len(OPEN), len(MIDDLE), len(CLOSE)])
        start[at], end[at] = sizes[k], sizes[k + 1]

    lead = first[:-1]
    constant(lead, 1)
    runs = [lead + 1, lead + 3 + 2 * count[0]]
    constant(lead + 2 + 2 * count[0], 2)
    constant(first[1:] - 1, 3)
    for (offsets, _), b, (row, at), c, run in zip(parts, base, marks, count, runs):
        start[run] = b + offsets[:-1]
        end[run + 2 * c] = b + offsets[1:]
        k = np.arange(len(row)) - (np.cumsum(c) - c)[row]       # number of the escape within its row
        constant(run[row] + 2 * k + 1, 0)
        end[run[row] + 2 * k] = b + at
        start[run[row] + 2 * k + 2] = b + at
    length = end - start
    ends = np.cumsum(length)
    out = pa.allocate_buffer(int(ends[-1]) if n else 0, resizable=False)
    to = np.frombuffer(out, np.uint8)
    shift = start - (ends - length)
    for a in range(0, len(to), BLOCK):
        z = min(a + BLOCK, len(to))
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, z, side="left") + 1
        size = np.minimum(ends[i:j], z) - np.maximum(ends[i:j] - length[i:j], a)
        to[a:z] = pool[np.arange(a, z) + np.repeat(shift[i:j], np.maximum(size, 0))]
    # code points up to the end of every segment
    some = np.flatnonzero(length)
    points = np.zeros(len(length), np.int64)
    if len(some):
        points[some] = np.add.reduceat((to & 0xC0) != 0x80, (ends - length)[some], dtype=np.int64)
    points = np.cumsum(points)
    text_end = points[first[1:] - 2]
    text_start = points[runs[1] - 1]
    return out, ends[first[1:] - 1], text_start, text_end, points[first[1:] - 1]


def _pieces(t: pa.Table, new: np.ndarray, loss_role: str, part: int, whole: list) -> pa.RecordBatch:
    """Pieces of the rows of ``t``; ``new`` says where another conversation begins."""
    at = np.flatnonzero(new)
    last = np.append(at[1:], t.num_rows) - 1
    buf, byte, a, z, point = assemble(t["role"], t["text"])
    offsets = np.concatenate([[0], byte[last]])
    lost = pc.fill_null(pc.equal(t["role"], loss_role), False).to_numpy()
    before = np.concatenate([[0], point[last]])[np.cumsum(new) - 1]
    per = np.concatenate([[0], np.cumsum(np.add.reduceat(lost, at, dtype=np.int64))])
    lists = [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array((x - before)[lost], pa.int64())) for x in (a, z)]
    text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), buf).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [t["conv_id"].combine_chunks().take(pa.array(at)), pa.array(np.arange(part, part + len(at)), pa.int64()), pa.array(whole, pa.bool_()),
         pa.array(last - at + 1, pa.int64()), text, *lists],
        names=["conv_id", "part", "whole", "n_turns", "text", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, part, whole, n_turns, text, loss_start, loss_end)``: formatted
    conversations with the code-point spans that are under the loss mask (the
    texts of ``loss_role``).

    A conversation is one row with ``whole`` set, unless it crosses the edge of
    a partition or exceeds ``SLICE`` bytes: then its rows, in order of ``part``, are
    joined end to end (an uncut one at an edge has ``whole`` false too).  Turns
    go by number, a null one first; rows of one number go by role, then text.
    Null roles and texts are empty, and rows without a conversation id are one
    conversation.  Repeated rows are repeated turns; an empty table gives an
    empty result.
    """
    t = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        held = None             # rows of a conversation that may go on
        opened = None           # (id,) of a conversation of which a piece is out already
        edge = True             # the next piece's conversation is the partition's first

        def emit(rows, new, whole):
            nonlocal part
            p = _pieces(rows, new, loss_role, part, whole)
            part += p.num_rows
            return p

        for x in (s for b in batches for s in _slices(b)):
            rows = x if held is None else pa.concat_tables([held, x])
            ids = rows["conv_id"].combine_chunks()
            new = np.ones(rows.num_rows, bool)
            same = pc.equal(ids[1:], ids[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            new[1:] = ~(same | (none[1:] & none[:-1]))
            at = np.flatnonzero(new)
            cut = at[-1]
            if cut:
                whole = [True] * (len(at) - 1)
                whole[0] = not edge and opened != (ids[0].as_py(),)
                yield emit(rows.slice(0, cut), new[:cut], whole)
                edge, opened = False, None
            held = rows.slice(cut)
            if pc.sum(pc.binary_length(held["text"])).as_py() >= SLICE:
                yield emit(held, np.arange(held.num_rows) == 0, [False])
                held, edge, opened = None, False, (ids[int(cut)].as_py(),)
        if held is not None:
            yield emit(held, np.arange(held.num_rows) == 0, [False])

    return t.drop("turn").mapInArrow(run, PIECES)


def _slices(batch: pa.RecordBatch):
    """Tables of consecutive rows with about ``SLICE`` text bytes at most."""
    if not batch.num_rows:
        return
    t = pa.Table.from_batches([batch])
    size = np.cumsum(pc.binary_length(t["text"]).to_numpy() + np.int64(64))
    cuts = np.flatnonzero(np.diff(size // SLICE)) + 1
    for a, z in zip([0, *cuts], [*cuts, t.num_rows]):
        yield t.slice(a, z - a)


def turns_of(text: str) -> list:
    """``(role, text)`` of every turn of a formatted conversation or piece."""
    return [(unescape(r), unescape(x)) for r, x in TURN.findall(text)]


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, one row each:
    turns, a digest of all roles and texts, and the text under the loss mask.

    Whole conversations are read where they lie.  The others' pieces, at most
    two conversations per partition and those beyond ``SLICE`` bytes, are hashed in order as a stream.
    """
    def read(batches):
        for b in batches:
            out = []
            for conv, part, whole, _, text, start, end in zip(*(c.to_pylist() for c in b.columns)):
                turns = turns_of(text)
                said = "".join(f"{r}\n{x}\n" for r, x in turns).encode()
                lost = "".join(unescape(text[a:z]) for a, z in zip(start, end))
                raw = lost.encode()
                out.append((conv, part, whole, len(turns), hashlib.sha256(said).hexdigest() if whole else None, len(lost),
                            hashlib.sha256(raw).hexdigest() if whole else None, len(text), None if whole else said, None if whole else raw))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    def join(batches):
        key, state = None, None

        def row(key, state):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), final)], schema=final)

        for b in batches:
            for conv, _, _, n, _, chars, _, size, said, raw in zip(*(c.to_pylist() for c in b.columns)):
                if key != (conv,):
                    if key is not None:
                        yield row(key, state)
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(said)
                state[2] += chars
                state[3].update(raw)
                state[4] += size
        if key is not None:
            yield row(key, state)

    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
              ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    final = pa.schema(fields)
    schema = pa.schema([fields[0], ("part", pa.int64()), ("whole", pa.bool_()), *fields[1:], ("said", pa.binary()), ("lost", pa.binary())])
    cols = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read_back = stored(pieces.mapInArrow(read, f"conv_id long, part long, whole boolean, {cols}, said binary, lost binary"))
    names = [f[0] for f in fields]
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = (read_back.where("NOT whole").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(join, f"conv_id long, {cols}"))
    return read_back.where("whole").select(*names).unionAll(cut)


SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*(/?s>|/?INST\]))', '\1\\\2', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*(/?s>|/?INST\]))', '\1\\\2', 'g')) + 22 AS size FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
