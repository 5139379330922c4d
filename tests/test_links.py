"""Links joined to pages on their address; categories by first appearance."""

from factlake.operators import links


def test_link_texts(spark):
    pages = spark.createDataFrame([(5, "http://a/x", "<p>late</p>"), (1, "http://a/x#top", "<p>Early  one</p>"), (2, "http://a/y", "<div>none</div>"),
                                   (3, None, "<p>no address</p>"), (4, "http://a/z", None), (None, "http://a/w", "<p>w</p>")],
                                  "page_id long, url string, html string")
    rows = spark.createDataFrame([(0, "http://a/x#end", 7, "own"), (1, "http://a/x", 7, "own"), (2, "http://a/y", 7, "own"), (3, None, 7, "own"),
                                  (4, "http://a/z", 7, "own"), (5, "http://gone", 7, "own"), (6, "http://a/x", 7, "own"), (7, "http://a/w", 7, "own")],
                                 "n long, url string, page_id long, text string")
    got = {r["n"]: (r["url"], r["page_id"], r["text"]) for r in links.link_texts(rows, pages).collect()}
    assert got == {0: ("http://a/x#end", 1, "early one"), 1: ("http://a/x", 1, "early one"), 2: ("http://a/y", 2, None), 3: (None, None, None),
                   4: ("http://a/z", 4, None), 5: ("http://gone", None, None), 6: ("http://a/x", 1, "early one"), 7: ("http://a/w", None, None)}
    assert links.link_texts(rows, pages.limit(0)).where("page_id IS NULL AND text IS NULL").count() == 8
    assert links.link_texts(rows.limit(0), pages).count() == 0


def test_first_appearance(spark):
    df = spark.createDataFrame([("g", "b", 3), ("g", "a", 5), ("g", "b", 1), ("g", None, 4), ("g", "c", None), (None, "a", 2), (None, "z", 2)],
                               "grp string, cat string, n long")
    got = sorted(((r["grp"] or "", r["position"], r["cat"], r["first"]) for r in links.first_appearance(df, "cat", "n", ["grp"]).collect()),
                 key=lambda r: r[:2])
    assert got == [("", 1, "a", 2), ("", 2, "z", 2), ("g", 1, "b", 1), ("g", 2, None, 4), ("g", 3, "a", 5), ("g", 4, "c", None)]
