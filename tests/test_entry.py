"""Driver contract."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "rk", "sid", "score", "sentence"]
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    rows_only = {q for q in set(E.queries()) - set(E.oracle_sql()) if not q.startswith("op") and q != "pipeline"}
    assert rows_only == {"cluster_summary", "classify_batch", "classify_report", "scoreboard_variants", "training_rounds", "tradeoff_timed"}


def test_entry_needs_no_jars_and_builds_oracles_late():
    """The word lists are package data: listing queries reads no jar and no SQL module."""
    import subprocess
    import sys
    code = ("import glob, zipfile\n"
            "def no(*a, **k): raise AssertionError('jar opened')\n"
            "zipfile.ZipFile = no\n"
            "import sys, __spark_entry__ as e\n"
            "assert len(e.queries()) >= 49 and 'factlake.plans.oracle' not in sys.modules\n"
            "assert len(e.oracle_sql()) >= 46\n")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
