"""Links and categories: the page behind a link (J05), categories in the
order in which the data first show them (A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import text as T


def address(url) -> Column:
    """A url without its ``#fragment``, which only names a place in the page."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(c, r"(?s)#.*", "")


def link_texts(links: DataFrame, pages: DataFrame, url: str = "url", html: str = "html", order: str = "page_id") -> DataFrame:
    """All columns of ``links`` plus ``<order>`` and ``text`` of the page
    behind each, joined on the address.  Of several pages of one address the
    one with the smallest ``order`` counts.  A link without a page, or a null
    one, keeps its row with nulls; repeated links repeat.  The text is taken
    from a page once (X01-X03), before the join, so html is not shuffled."""
    text = pages.where(F.col(order).isNotNull()).select(address(url).alias("_a"), F.col(order).alias("_o"), T.page_text(html).alias("_t"))
    first = text.groupBy("_a").agg(F.min_by("_t", "_o").alias("_t"), F.min("_o").alias("_o"))
    mine = [links[c] for c in links.columns if c not in (order, "text")]
    return (links.select(*mine, address(url).alias("_a")).join(first, "_a", "left")
                 .drop("_a").withColumnsRenamed({"_o": order, "_t": "text"}))


def first_appearance(df: DataFrame, category: str, order: str, by: list) -> DataFrame:
    """A10: ``<by..., category, first, position>``, the distinct categories of
    each group in the order of their first row (from 1; equal firsts in
    category order; null is a category).  Only distinct categories are sorted."""
    first = df.groupBy(*by, category).agg(F.min(order).alias("first"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("first").asc_nulls_last(), category))
    return first.withColumn("position", at.cast("bigint"))
