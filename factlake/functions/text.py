"""Row-level text functions: every function maps Column(s) to a Column and
stays inside Spark's JVM expressions (whole-stage codegen / HOFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions import vocab

SEP = "\u0001"        # part separator used inside one value, never in text
# White space as Python's ``\\s`` and ``str.strip`` have it, in a form that Java
# and RE2 both read (their own ``\\s`` is ASCII only).
WS = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
TRIMMED = 100_000     # characters up to which a text is trimmed by a set, which holds eight bytes a character
SENTENCE_END = rf"(?<=[.?!])[{WS}]+"
WORD_RUN = r"[\p{L}\p{M}\p{N}_]"
TOKEN2 = WORD_RUN + "{2,}"                         # words of 2+ chars
WORD_OR_PUNCT = WORD_RUN + rf"+|[^{WS}\p{{L}}\p{{M}}\p{{N}}_]"  # words and single marks


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Trim all leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(x), rf"^[{WS}]+|[{WS}]+\z", "")


def _strip_named(c) -> Column:
    """``strip`` of a column or lambda variable: its value is named twice."""
    return F.when(F.length(c) <= TRIMMED, F.btrim(c, F.lit(WS_CHARS))).otherwise(strip(c))


def squash(x) -> Column:
    """Collapse whitespace runs to one space, trim, lower-case."""
    return F.lower(strip(F.regexp_replace(_c(x), f"[{WS}]+", " ")))


def sentences(x) -> Column:
    """Split after ``.``, ``?`` or ``!`` followed by whitespace."""
    return F.split(_strip_named(F.coalesce(_c(x), F.lit(""))), SENTENCE_END)


def tokens(x) -> Column:
    """Vectoriser tokens: lower-cased runs of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN2), 0)


def word_tokens(x) -> Column:
    """Words and punctuation marks as separate tokens."""
    return F.regexp_extract_all(_c(x), F.lit(WORD_OR_PUNCT), 0)


def remove_stop_words(arr, stop) -> Column:
    """Drop tokens present in ``stop`` (a Python list).  ``isin`` over
    more than a few literals is planned as a hash-set lookup (InSet)."""
    stop = list(stop)
    if not stop:
        return _c(arr)
    return F.filter(_c(arr), lambda t: ~t.isin(*stop))


def quoted_spans(x) -> Column:
    """Text between matching double or single quotes on one line
    (``(?d)``: only ``\\n`` ends a line, as in Python's ``.``)."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?d)([\"'])(.*?)\1"), 2)


def _nonblank_parts(arr) -> Column:
    return F.filter(F.transform(arr, _strip_named), lambda p: F.length(p) > 0)


def clause_split(x, keep_separators: bool = True, marks: str = vocab.CLAUSE_MARKS) -> Column:
    """Cut a text on connectives and sentence marks.

    Connectives are kept as parts of their own (``keep_separators``), marks
    are dropped; parts are trimmed and blank parts removed.  Case-sensitive.
    """
    pat = vocab.clause_pattern_java(marks)
    repl = (SEP + "$1" + SEP) if keep_separators else (SEP + SEP)
    marked = F.regexp_replace(F.coalesce(_c(x), F.lit("")), pat, repl)
    return _nonblank_parts(F.split(marked, SEP))


def after_que(x, terminator: str = vocab.QUE_TERMINATOR) -> Column:
    """Clauses following the word "que" up to the next connective or the
    terminator; case-insensitive; empty captures dropped."""
    pat = vocab.after_que_pattern_java(terminator)
    return _nonblank_parts(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pat), 1))


ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _code_point(digits, base: int) -> Column:
    """The character of a code point given as text; NULL if there is none."""
    n = F.conv(digits, base, 10).cast("bigint")
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def html_unescape(x) -> Column:
    """Named (HTML 4) and numeric entities in one pass, so ``&amp;lt;`` becomes
    ``&lt;``; an unknown entity stays as it is."""
    names = F.create_map(*[F.lit(v) for pair in vocab.html_entities().items() for v in pair])

    def one(part):
        e = F.regexp_extract(part, "^" + ENTITY, 1)
        char = (F.when(e == "", None).when(e.rlike("^#[xX]"), _code_point(F.substring(e, 3, 9), 16))
                .when(e.startswith("#"), _code_point(F.substring(e, 2, 9), 10)).otherwise(F.try_element_at(names, e)))
        return F.coalesce(F.concat(char, F.substr(part, F.length(e) + 3)), part)

    plain = _c(x)
    return F.when(plain.contains("&"), F.array_join(F.transform(F.split(plain, "(?=&)"), one), "")).otherwise(plain)


BLOCK_END = r"<p[\s>]|</p>|</article>|</body>|<footer|<div"


def _element_text(parts) -> Column:
    return F.transform(parts, lambda p: F.regexp_replace(p, "<[^>]*>", ""))


def page_text(html) -> Column:
    """Text of the ``<p>`` elements (each followed by a space),
    ``<span>`` text as fallback, whitespace collapsed, trimmed, lower-cased;
    NULL when neither yields text.  A new ``<p>`` closes an open one."""
    clean = F.regexp_replace(_c(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    p_parts = F.regexp_extract_all(
        clean, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=" + BLOCK_END + r"|\z)"), 1)
    span_parts = F.regexp_extract_all(clean, F.lit(r"(?is)<span(?:\s[^>]*)?>(.*?)</span>"), 1)
    p_text = squash(html_unescape(F.array_join(_element_text(p_parts), " ")))
    span_text = squash(html_unescape(F.array_join(_element_text(span_parts), " ")))
    return (F.when(F.length(p_text) > 0, p_text)
            .when(F.length(span_text) > 0, span_text))


def chunks(x, max_chars: int = 1200) -> Column:
    """Greedy sentence packing into pieces of at most ``max_chars``;
    over-long pieces are hard-cut.  NULL -> [""]; short texts are one piece."""
    t = strip(F.coalesce(_c(x), F.lit("")))
    sents = F.split(t, SENTENCE_END)
    init = F.struct(F.array().cast("array<string>").alias("c"), F.lit("").alias("b"))

    def step(acc, s):
        fits = F.length(acc["b"]) + F.length(s) + 1 <= max_chars
        # neither a stripped text's sentences nor what they add up to have white space around them
        joined = F.when(acc["b"] == "", s).otherwise(F.concat(acc["b"], F.lit(" "), s))
        flushed = F.when(acc["b"] != "", F.array_append(acc["c"], acc["b"])).otherwise(acc["c"])
        return F.when(fits, F.struct(acc["c"].alias("c"), joined.alias("b"))) \
                .otherwise(F.struct(flushed.alias("c"), s.alias("b")))

    def finish(acc):
        return F.when(acc["b"] != "", F.array_append(acc["c"], acc["b"])).otherwise(acc["c"])

    packed = F.aggregate(sents, init, step, finish)
    cut = F.flatten(F.transform(packed, lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(max_chars)),
        lambda i: F.substring(c, i, max_chars))))
    return F.when(F.length(t) <= max_chars, F.array(t)).otherwise(cut)


def list_cell_text(x) -> Column:
    """X11: a cell holding a list or tuple literal becomes its items joined by
    a space, a quoted string its content; NULL -> ""; any other text is kept."""
    c = _c(x)
    items = F.transform(F.regexp_extract_all(c, F.lit(LITERAL_ITEM), 0), _unquoted)
    return (F.when(c.rlike(LITERAL_LIST), F.array_join(items, " "))
             .when(c.rlike(rf"^[{WS}]*(?:{LITERAL_STRING})[{WS}]*\z"), _unquoted(strip(c)))
             .otherwise(F.coalesce(c, F.lit(""))))


LITERAL_STRING = r"'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\""
LITERAL_ITEM = LITERAL_STRING + r"|[+-]?[0-9]+(?:\.[0-9]+)?|True|False|None"
_GAP = f"[{WS}]*"
LITERAL_LIST = (rf"^{_GAP}(?:\[{_GAP}(?:(?:{LITERAL_ITEM}){_GAP}(?:,{_GAP}|(?=\])))*\]"
                rf"|\({_GAP}\)|\({_GAP}(?:{LITERAL_ITEM}){_GAP},{_GAP}(?:(?:{LITERAL_ITEM}){_GAP}(?:,{_GAP}|(?=\))))*\)){_GAP}\z")


def _unquoted(item) -> Column:
    """A literal's text: quotes off, escapes resolved, numbers and names as written."""
    body = F.substr(item, F.lit(2), F.length(item) - 2)
    for raw, escaped in [("\u0002", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("'", "\\'"), ('"', '\\"'), ("\\", "\u0002")]:
        body = F.replace(body, F.lit(escaped), F.lit(raw))
    return F.when(item.startswith("'") | item.startswith('"'), body).otherwise(item)


# escapes of a quoted list item, backslash first
LITERAL_ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("'", "\\'")]


def list_literal(arr) -> Column:
    """Printable list literal ``['a', 'b']`` of a string array (items
    single-quoted, backslash, newline, return, tab and quote escaped)."""
    def quote(s):
        for a, b in LITERAL_ESCAPES:
            s = F.replace(s, F.lit(a), F.lit(b))
        return F.concat(F.lit("'"), s, F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), quote), ", "), F.lit("]"))


def strip_brackets(x) -> Column:
    """Remove ``[``, ``]`` and ``'`` then trim."""
    return strip(F.regexp_replace(_c(x), r"[\[\]']", ""))


def keyword_set(x) -> Column:
    """Keyword cell -> lower-cased distinct set; split on ; , | / newline."""
    parts = F.split(F.coalesce(_c(x), F.lit("")), r"[;,|/\n]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(strip(p))),
                                     lambda p: F.length(p) > 0))


def jaccard(a, b) -> Column:
    """|a∩b| / max(|a∪b|, 1); two empty sets give 0."""
    return (F.size(F.array_intersect(_c(a), _c(b)))
            / F.greatest(F.size(F.array_union(_c(a), _c(b))), F.lit(1)))


def compression_ratio(summary, original) -> Column:
    """Summary length / max(original length, 1), in characters."""
    return F.length(_c(summary)) / F.greatest(F.length(_c(original)), F.lit(1))


def sorted_join(arr, sep: str = "; ") -> Column:
    """Sorted set as one string; empty set -> ""."""
    return F.coalesce(F.array_join(F.array_sort(_c(arr)), sep), F.lit(""))


def prompt(x) -> Column:
    """Summarisation prompt."""
    return F.concat(F.lit(vocab.SUMMARY_PROMPT), _c(x))


def first_nonblank(*cols) -> Column:
    """First non-blank of the given text columns, else ""."""
    return F.coalesce(*[F.nullif(strip(_c(c)), F.lit("")) for c in cols], F.lit(""))
