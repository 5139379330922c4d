from factlake.llm import langid
from factlake.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(9_000_001, None, "en"), (9_000_002, "", "en"), (9_000_003, "12 34 ²!", "en"), (None, "the of and that", None),
                                 (0, "x" * 200_000, None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionAll(odd).unionAll(odd)
    got = langid.predict(both, model).toPandas()
    assert len(got) == docs.count() + 10
    assert set(got[got.doc_id.isin([9_000_001, 9_000_002, 9_000_003])].lang_pred) == {"und"}
    assert got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    m = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id").drop_duplicates("doc_id")
    held = m[m.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() >= 0.99


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "xx" if i % 2 else "yy") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F
    from factlake.llm.common import held_out
    wrong = d.withColumn("lang", F.when(held_out("doc_id"), "zz").otherwise(F.col("lang")))
    assert langid.fit(wrong).langs == ["xx", "yy"]


def test_no_rows_or_one_language(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    one = spark.createDataFrame([(1, "abc", "en"), (2, "...", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(one, langid.fit(one)).orderBy("doc_id").collect()] == ["en", "und"]
    none = langid.predict(one, langid.fit(empty)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_what_travels_to_executors_names_no_module_of_ours(spark, monkeypatch):
    """Executors have no copy of the package: broadcasts are pickled by reference, functions by value."""
    import pickle

    from pyspark import cloudpickle
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "xx" if i % 2 else "yy") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    sent = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(v) or broadcast(v))
    frames = []
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, schema: frames.append(f) or self)
    langid.predict(d, model)
    assert len(sent) == len(frames) == 1
    assert b"factlake" not in pickle.dumps(sent[0])
    code = "import sys, pickle; f = pickle.load(sys.stdin.buffer); assert not [m for m in sys.modules if m.startswith('factlake')]; print(f(['alpha beta', None]))"

    def outside(texts, state=vars(model), make=langid.Model):
        m = object.__new__(make)
        vars(m).update(state)
        return m.predict(texts)

    import subprocess
    import sys
    got = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(outside), capture_output=True, cwd="/", env={"PATH": "/usr/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
    assert got.returncode == 0, got.stderr.decode()[-800:]
    assert "'xx'" in got.stdout.decode() and "'und'" in got.stdout.decode()
