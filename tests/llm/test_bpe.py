import base64
import hashlib

import public_tokenizers as P
import tiktoken

from factlake.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "Hello there, it's  fine.\n\n  \tEnd ", "ÀÉ ñandú \U0001f600 x\x1cy\x85z a b", "don't we'LL  'tis\r\n", "a" * 300 + " 123456789" * 50,
         " ", "\n", "  lead", "trail  ", "<|endoftext|> $$$!! 42nd", "日本語のテキスト ﬁ ́x"]


def expected(t):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = enc.encode_ordinary(t)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest(), ids


def test_matches_the_tokenizer_library(docs_frame):
    rows = [*enumerate(TEXTS), (100, None), (None, "null id"), (1, TEXTS[1])]
    got = bpe.encode_decode_digest(docs_frame(rows), RANKS, P.PATTERN).collect()
    want = sorted(((i, *expected(t or "")[:3]) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    ids = {r.doc_id: r.ids for r in bpe.encode(docs_frame([*enumerate(TEXTS)]), RANKS, P.PATTERN).collect()}
    assert all(ids[i] == expected(t)[3] for i, t in enumerate(TEXTS))


def test_long_words_take_several_queries(docs_frame):
    t = "thequickbrownfoxjumps" * 40
    got = bpe.encode_decode_digest(docs_frame([(1, t)]), RANKS, P.PATTERN).first()
    assert tuple(got)[1:] == expected(t)[:3]


def test_empty_table(docs_frame):
    assert bpe.encode_decode_digest(docs_frame([]), RANKS, P.PATTERN).count() == 0
