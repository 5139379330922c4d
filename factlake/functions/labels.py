"""Label normalisers (X14-X16) and the fixed class-id map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions import vocab
from factlake.functions.text import strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _norm(x) -> Column:
    return F.lower(strip(_c(x).cast("string")))


def _lits(values):
    return [F.lit(v) for v in values]


def gold_label(x) -> Column:
    """Factual / non-factual / NULL.  Word lists first; numeric text
    is truncated to an integer (1 -> factual, any other -> non-factual);
    NaN, infinities and unknown text -> NULL."""
    s = _norm(x)
    num = F.when(s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?$"), s.try_cast("double"))
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != float("inf"))
    return (F.when(_c(x).isNull(), F.lit(None).cast("string"))
             .when(s.isin(*_lits(vocab.GOLD_FACTUAL)), F.lit("factual"))
             .when(s.isin(*_lits(vocab.GOLD_NON_FACTUAL)), F.lit("non-factual"))
             .when(finite & (num >= 1.0) & (num < 2.0), F.lit("factual"))
             .when(finite, F.lit("non-factual")))


def three_class_label(x) -> Column:
    """NULL -> non-factual; listed spellings; anything else ->
    factual-checkworthy (so "1.0" is check-worthy, as in the source rule)."""
    s = _norm(x)
    return (F.when(_c(x).isNull(), F.lit("non-factual"))
             .when(s.isin(*_lits(vocab.THREE_CLASS_NON_FACTUAL)), F.lit("non-factual"))
             .when(s.isin(*_lits(vocab.THREE_CLASS_NON_IMPORTANT)), F.lit("factual-non-important"))
             .otherwise(F.lit("factual-checkworthy")))


def class_id(label) -> Column:
    """Fixed id map (never frequency-ordered): 0, 1, 2."""
    m = F.create_map(*[a for i, lab in enumerate(vocab.THREE_CLASS_LABELS) for a in (F.lit(lab), F.lit(i))])
    return m[_c(label)]


def binary_label(x) -> Column:
    """1/0 with the substring fallback ("fact" and not "non" -> 1), so
    "not-factual" maps to 1 as in the source rule.  NULL reads as "none"."""
    s = F.coalesce(_norm(x), F.lit("none"))
    return (F.when(s.isin(*_lits(vocab.BINARY_POSITIVE)), F.lit(1))
             .when(s.isin(*_lits(vocab.BINARY_NEGATIVE)), F.lit(0))
             .when(s.contains("fact") & ~s.contains("non"), F.lit(1))
             .otherwise(F.lit(0)))


def argmax(scores) -> Column:
    """0-based index of the largest class score (first on ties)."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")
