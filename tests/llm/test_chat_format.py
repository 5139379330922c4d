"""Chat formatting against a plain formatter, and read back."""

import hashlib
import random

import pyarrow as pa
import pytest

from factlake.llm import chat_format as C, queries
from factlake.sources.tables import table

ODD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "", "<", "s>", "/s>", "[INST", "]x", "é<s>ü[/INST]日本", "<<s>>[[INST]]", "\\", "a\n\nb", "plain"]


def escape(text):
    """By scanning: one more backslash where a control string, or an escaped one, begins."""
    out = ""
    for i, c in enumerate(text):
        out += c
        if c in "<[":
            rest = text[i + 1:].lstrip("\\")
            if any((c + rest).startswith(k) for k in ("<s>", "</s>", "[INST]", "[/INST]")):
                out += "\\"
            elif any((c + rest).startswith(k) for k in ("</INST]", "<INST]", "[s>", "[/s>")):
                out += "\\"     # mixed brackets are escaped as well, and undone alike
    return out


def formatted(rows):
    """``conv_id -> (text, loss spans)`` by string concatenation."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        s, spans = out.get(conv, ("", []))
        s += f"<s>[INST] {escape(role or '')} [/INST]"
        body = escape(text or "")
        if role == "assistant":
            spans = spans + [(len(s), len(s) + len(body))]
        out[conv] = (s + body + "</s>", spans)
    return out


def joined(pieces):
    out = {}
    for p in sorted(pieces, key=lambda p: p.part):
        s, spans = out.get(p.conv_id, ("", []))
        spans = spans + [(len(s) + a, len(s) + z) for a, z in zip(p.loss_start, p.loss_end)]
        out[p.conv_id] = (s + p.text, spans)
    return out


def rows_of(rng, n):
    return [(rng.choice([1, 2, 3, None, 5, 5, 5]), rng.choice([0, 1, 2, 2, None, 7]), rng.choice(["user", "assistant", "system", None, "[INST]"]),
             rng.choice([None, *ODD]) if rng.random() < 0.5 else "".join(rng.choices("<>[]/\\sINST é日", k=rng.randint(0, 12)))) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes, block", [(4 << 20, 1 << 20), (60, 7)])
def test_equals_plain_concatenation(spark, monkeypatch, slice_bytes, block):
    monkeypatch.setattr(C, "SLICE", slice_bytes)
    monkeypatch.setattr(C, "BLOCK", block)
    rows = rows_of(random.Random(slice_bytes), 300)
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn int, role string, text string, part string, whole boolean")
    pieces = C.format_conversations(df)
    want = formatted(rows)
    got = pieces.collect()
    assert joined(got) == want
    # a whole piece is all there is of its conversation
    seen = [p.conv_id for p in got]
    assert all(seen.count(p.conv_id) == 1 for p in got if p.whole)
    for r in C.conversation_digests(pieces).collect():
        turns = [(a or "", t or "") for c, _, a, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())) if c == r.conv_id]
        lost = "".join(t for a, t in turns if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(lost), len(want[r.conv_id][0]))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()


def test_no_text_forges_a_turn(spark):
    for text in ODD:
        once = escape(text)
        assert C.unescape(once) == text
        assert not any(k in once for k in ("<s>", "</s>", "[INST]", "[/INST]"))
        buf, *_ = C.assemble(pa.chunked_array([["user"]]), pa.chunked_array([[text]]))
        assert C.turns_of(buf.to_pybytes().decode()) == [("user", text)]


def test_hot_conversation_and_long_text(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"{k} " + "abc[INST] é " * 200) for k in range(4000)] + [(k, 0, "user", "hi") for k in range(2, 60)]
    rows.append((99, 0, "assistant", "</s>x" * 2_000_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    pieces = C.format_conversations(df)
    sizes = [r.n_turns for r in pieces.where("conv_id = 1").select("n_turns").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 3500
    got = {r.conv_id: r for r in C.conversation_digests(pieces).collect()}
    assert len(got) == 60 and got[99].loss_chars == 10_000_000 and got[99].formatted_chars == 10_000_000 + 2_000_000 + 9 + 22
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for c, _, a, t in rows if c == 1).encode()).hexdigest()


def test_empty_table_and_fixture(spark):
    t = table(spark, "/root/testdata/sf0.001", "conversations")
    assert C.format_conversations(t.limit(0)).count() == 0 and C.conversation_digests(C.format_conversations(t.limit(0))).count() == 0
    got = {r.conv_id: r for r in queries.op11_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert len(got) == t.select("conv_id").distinct().count() + 1
