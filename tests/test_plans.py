"""Plan checks: no cartesian products, no Python in the expression
operators, one document shuffle for the centrality chain at scale."""

import pytest

from conftest import SF001
from factlake.plans import queries as E

EXPRESSION_QUERIES = ["clause_split", "after_que_clauses", "quoted_spans", "page_paragraphs", "text_chunks",
                      "factual_share", "normalize_gold", "sentence_centrality_top5"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_no_cartesian(spark, name):
    p = plan(E.QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", EXPRESSION_QUERIES)
def test_no_python_in_expression_operators(spark, name):
    p = plan(E.QUERIES[name](spark, SF001))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_centrality_single_document_shuffle(spark):
    """With broadcasts off (large-data shape), the whole centrality chain
    shuffles only the raw documents (hash on doc_id), nothing else."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.QUERIES["sentence_centrality_top5"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [ln for ln in p.splitlines() if "Exchange" in ln]
    assert exchanges and all("REPARTITION_BY_NUM" in ln or "ReusedExchange" in ln for ln in exchanges), exchanges


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_no_single_partition_window(spark, name):
    """Every window has a partition key (no window over a whole table)."""
    assert not whole_table_windows(E.QUERIES[name](spark, SF001))


def whole_table_windows(df):
    """Window operators of the optimised logical plan without a partition key.
    The printed physical plan leaves an empty list out, so it cannot tell."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Window" and p.partitionSpec().isEmpty():
            found.append(p.simpleStringWithNodeId())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_the_window_check_sees_a_window_over_a_whole_table(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    d = spark.range(5)
    assert whole_table_windows(d.select(F.row_number().over(Window.orderBy("id"))))
    assert not whole_table_windows(d.select(F.row_number().over(Window.partitionBy("id").orderBy("id"))))


def test_similarity_pieces_count_terms_once(spark):
    """Cosines of neighbouring sentences come from one table of term counts, not from a join of it with itself."""
    p = E.QUERIES["factual_pieces"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Generate explode(regexp_extract_all" in ln for ln in p.splitlines()) == 1


def test_news_record_makes_summaries_once(spark):
    """Three columns come from a summary; the plan behind them reads it and cuts no sentences again."""
    p = E.QUERIES["news_record"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in p
