"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

The patterns give the base spans.  The novelty pass then looks at strings that
stand near a sensitive word: a zstandard dictionary is primed with common
identifiers and the text around the candidate, and the bytes the candidate
adds to a compressed frame are held against its length and against what a
random string of the same length over the same characters costs there.  A
string that neither its surroundings nor everyday identifiers explain
compresses no better than that: it is reported as ``novel``, to the end of its
run of characters.  Everything is row by row: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from factlake.llm.common import id_text

KINDS = ["assign", "access", "hex", "novel"]
# FIXED VALUES: the base patterns.  Keyword letters are spelled in both cases, as
# ignoring case would also accept letters outside ASCII.  For access and hex a
# maximal run long enough equals a match that is not dropped.
_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
_BOTH = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", w) for w in _WORDS)
ASSIGN = re.compile(rf"(?:{_BOTH})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
ASSIGN_LEAST = 6
# Words that make their surroundings sensitive.
CONTEXT = re.compile(r"(?i)passw|passphrase|secret|token|api[_-]?key|credential|auth|bearer|private[_ -]?key|access[_ -]?key|pwd")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Everyday identifiers that a novel string must differ from.
IDENTIFIERS = ("password passwd secret token api_key access_key private_key client_id client_secret authorization bearer "
               "username user_name config settings database connection string example default localhost undefined null "
               "true false function return import class public static void const let var self this https http www com "
               "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ")
NEAR = 64           # characters before a candidate in which a sensitive word counts
AROUND = 512        # characters on each side that prime the dictionary
NOVEL_RATIO = 0.70  # marginal bytes per character from which a string is novel (random base64 costs 0.75 and more)
RANDOM_SHARE = 0.95  # share of a random string's marginal bytes from which a string is novel (small alphabets, long strings)
LEAST = 16          # characters of the shortest candidate
OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list:
    """``(start, kind index, end)`` in code points, leftmost first per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _frame(context: bytes, payload: bytes) -> int:
    """Bytes of a frame of the payload under a dictionary of identifiers and context."""
    d = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False)
    return len(c.compress(payload))


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` adds as many bytes to a frame as a string
    without pattern would: NOVEL_RATIO a character, or, where entropy coding
    alone goes below that, RANDOM_SHARE of what evenly drawn characters of the
    string's own alphabet cost at the same place."""
    around = (text[max(0, start - AROUND):start] + "\n" + text[end:end + AROUND]).encode()
    n, piece = end - start, text[start:end]
    empty = _frame(around, b"")
    cost = _frame(around, piece.encode()) - empty
    if cost >= NOVEL_RATIO * n:
        return True
    drawn = "".join(random.Random(n).choices(sorted(set(piece)), k=n))
    return cost >= RANDOM_SHARE * (_frame(around, drawn.encode()) - empty)


def novel_spans(text: str, base: list) -> list:
    """Incompressible candidates near a sensitive word that no base span covers.
    One pass finds the runs of candidate characters, of any length."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends = [e for _, e in runs]
    out, at = [], 0
    for w in CONTEXT.finditer(text):
        at = max(at, w.start())
        for i in range(bisect_right(ends, at), len(runs)):
            s, e = max(runs[i][0], at), ends[i]
            if s > w.end() + NEAR:
                break
            if e - s < LEAST:
                continue
            at = e
            piece = text[s:e]
            has = sum(bool(re.search(p, piece)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
            if has < 2 or not re.search("[0-9]", piece) or any(b[0] < e and s < b[2] for b in base):
                continue
            if is_novel(text, s, e):
                out.append((s, 3, e))
    return out


def find_spans(text: str) -> tuple:
    """``(base spans, all spans)``, each ordered by start, then kind."""
    base = base_spans(text)
    more = novel_spans(text, base) if CONTEXT.search(text) else []
    return base, sorted(base + more)


def _digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _by_text(docs, fn, fields, schema):
    """Map ``(doc_id, text)`` batches; ``fn`` gives one tuple per text."""
    def run(batches):
        for b in batches:
            rows = [fn(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, fields))],
                                             names=["doc_id", *(n for n, _ in fields)])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)`` of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return _by_text(id_text(docs, id_col, text_col),
                    lambda t: ([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t)[1]],),
                    [("spans", kind)], "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per
    input row.  Null and empty texts have no spans (the digest is that of
    nothing); a null id stays null; repeated rows repeat; an empty table gives
    an empty result."""
    def row(t):
        base, spans = find_spans(t)
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        return (*n, hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans))

    return _by_text(id_text(docs, id_col, text_col), row,
                    [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                     ("base_sha256", pa.string()), ("spans", pa.string())], OUT)


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mask``."""
    out, at, until = [], 0, 0
    for s, _, e in find_spans(text)[1]:
        if s >= until:
            out += [text[at:s], mask]
        at = until = max(until, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs`` with secrets masked in ``text_col`` (null stays
    null) and ``count_col``, if there is one, set to the new length of masked
    texts."""
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(count_col) if count_col and count_col in docs.columns else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t if t is None else masked(t, mask) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if n_at is not None:
                cols[n_at] = pa.array([n if o == t else len(t) for o, t, n in zip(old, new, cols[n_at].to_pylist())],
                                      b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
