"""Feed markup with entities of all kinds, and without a limit."""

import duckdb
from pyspark.sql import functions as F

from millrace.functions import headlines, text
from millrace.plans import catalog

PAGES = {
    "<p>caf&eacute;&nbsp;&copy; it&#8217;s &#x27;so&#x27;</p>": "café © it’s 'so'",
    "&lt;b&gt;R&amp;D &quot;x&quot; &#39;y&#39;&lt;/b&gt;": "R&D \"x\" 'y'",
    "&amp;eacute; &amp;amp;lt; &amp;#8217;": "&eacute; &amp;lt; &#8217;",
    "&copy 2024 &ampx &unknown; a&b": "© 2024 &x &unknown; a&b",
    "&lt;script&gt;&eacute;&lt;/script&gt;&Eacute;": "É",
    None: "",
}


def test_all_entities_are_decoded(spark):
    rows = spark.createDataFrame([(x,) for x in PAGES], "html string")
    assert {r.html: r.c for r in rows.select("html", text.clean_text(F.col("html"), 280).alias("c")).collect()} == PAGES


def test_categories_are_decoded(spark):
    rows = spark.createDataFrame([(1, ["Caf&eacute;", "R&amp;D", None, "&nbsp;", "&#x41;I"]), (2, ["R&amp;D", "&lt;i&gt;"]), (3, None)], "k int, v array<string>")
    got = {r.k: r.v for r in rows.select("k", text.clean_strings(F.col("v"), 20, 80).alias("v")).collect()}
    assert got == {1: ["Café", "R&D", "AI"], 2: ["R&D"], 3: []}


def test_titles_are_decoded(spark):
    rows = spark.createDataFrame([("Show HN: Caf&eacute; &#8211; menus &hearts;",)], "t string").select(headlines.show_title(F.col("t")).alias("s"))
    assert [(r.s.name, r.s.tagline) for r in rows.collect()] == [("Café", "menus ♥")]


def test_whole_text_has_no_limit(spark):
    n = 10_000_050
    row = spark.range(1).select(F.repeat(F.lit("x"), n).alias("html")).select(F.length(text.clean_text(F.col("html"))).alias("n"))
    assert row.first().n == n


def test_pages_cut_in_an_entity_are_as_their_sql_has_them(spark, tmp_path):
    cut = ["<title>token = &quot</title><p>&copy;</p>", "<title>a &lt</title> b &gt", "x &amp y &ampz &amplt; &am &quo", "it&#39 s &#3", "&copy 2024 &middot;", "R&amp;D &amp;lt; &quot;x&quot;", "&lt;b&gt;&quot &lt;/b&gt;"]
    spark.createDataFrame(list(enumerate(cut)), "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.clean, r.whole) for r in catalog.queries()["clean_feed_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == {k: (c, w) for k, c, w in con.execute("SELECT page_id, clean, whole FROM (" + catalog.oracle_sql()["clean_feed_text"] + ")").fetchall()}
    rows = spark.createDataFrame([("&eacute;&nbsp;&#8217;&#x27; &notit; &copyx;",)], "t string")
    assert rows.select(text.clean_text(F.col("t"), closed=True)).first()[0] == "é ’' &notit; &copyx;"
