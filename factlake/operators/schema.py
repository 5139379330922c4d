"""Schema-level checks (P03, P04, P16): pure functions of ``df.schema``
evaluated on the driver before any job runs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factlake.functions import vocab


def require_columns(df: DataFrame, cols: list, strict: bool = True) -> bool:
    """Error (or warn and return False) when a needed column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        msg = f"column(s) {missing} not found; columns: {df.columns}"
        if strict:
            raise ValueError(msg)
        warnings.warn(msg)
        return False
    return True


def infer_text_column(df: DataFrame, user_col: str | None = None) -> str:
    """Every column gets the rank of the best rule it meets, the lowest
    rank wins.  With ``user_col``: that name, then that name in another case.
    Without: each candidate name (as written before another case), then any
    string column."""
    wanted = [user_col] if user_col else vocab.TEXT_COLUMN_CANDIDATES
    order = {name: i for i, name in reversed(list(enumerate(wanted)))}
    folded = {name.lower(): i for name, i in sorted(order.items(), key=lambda x: -x[1])}
    ranked = []
    for at, f in enumerate(df.schema.fields):
        ranked += [(order[f.name], 0, at)] if f.name in order else []
        ranked += [(folded[f.name.lower()], 1, at)] if f.name.lower() in folded else []
        if not user_col and isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)):
            ranked.append((len(wanted), 2, at))
    if not ranked:
        raise KeyError(f"no text column{f' named {user_col}' if user_col else ''} among {df.columns}")
    return df.columns[min(ranked)[2]]


def require_nonempty(df: DataFrame, what: str = "result") -> DataFrame:
    """Fail when a (small, aggregated) result is empty."""
    if df.isEmpty():
        raise SystemExit(f"no rows in {what}")
    return df
