"""Feed bodies that strict and lax parsers take differently, and white space of all kinds."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import delivery, quality, render
from millrace.sources import feeds


def rss(items: str, head: str = "", channel: str = "<channel>{0}</channel>") -> str:
    return f'{head}<rss version="2.0">{channel.format(items)}</rss>'


ITEM = "<item><title>{0}</title></item>"
FAILS = {
    rss(ITEM, '<!DOCTYPE rss>'): "invalid_xml",
    rss(ITEM, '<!DOCTYPE rss [<!ENTITY a "b">]>'): "invalid_xml",
    rss(ITEM, channel=""): "unsupported_xml",
    rss(ITEM, channel="<channel>{0}</channel><channel></channel>"): "unsupported_xml",
    rss(ITEM)[:-8]: "invalid_xml",
    rss(ITEM * 101): "too_many_items",
    rss(ITEM) + " " * (1 << 20): "response_size",
    "<html></html>": "unsupported_xml",
    "": "invalid_xml",
}
TITLES = {
    rss("<item><title><![CDATA[a <!DOCTYPE b> c]]></title></item>"): "a <!DOCTYPE b> c",
    rss(ITEM.format("x"), "<!-- <!ELEMENT a> -->"): "x",
    rss("<item><title>one</title><title>two</title></item>"): "two",
    rss("<item><title>a<b>x</b>c</title></item>"): "ac",
    rss('<item><title>a</title><t:title xmlns:t="urn:t">no</t:title></item>'): "a",
    rss(ITEM.format("Café €"), '<?xml version="1.0" encoding="ISO-8859-1"?>'): "Café €",
    '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>a</title><title>b<i>c</i>d</title></entry></feed>': "bd",
}


def test_bodies(spark):
    rows = [(k, body) for k, body in enumerate([*FAILS, *TITLES])]
    got = {r.source_id: r for r in feeds.feed_items(spark.createDataFrame([*rows, (99, None)], "source_id long, body string")).collect()}
    assert [got[k].error for k in range(len(FAILS))] == list(FAILS.values()) and got[99].error == "invalid_xml"
    assert [(got[k + len(FAILS)].title, got[k + len(FAILS)].error) for k in range(len(TITLES))] == [(t, None) for t in TITLES.values()]


def test_all_white_space_is_trimmed(spark):
    for white in ("\t", "\n", "\u00a0", "\u2003", "\u3000", "\x85"):
        assert spark.range(1).select(text.trimmed(F.lit(f"{white}a b{white} ")).alias("t")).first().t == "a b"
    one = feeds.sample(spark).withColumn("source_id", F.lit("\t\u2003"))
    assert [r.reason for r in quality.gated(one, 1_704_067_200 * 10**9, None, None).collect()] != [None]


@pytest.mark.parametrize("limit", [2, 3, 20, 60, 110, 150, 400])
def test_headers_and_empty_digests_stay_within_the_limit(spark, limit):
    item = "struct<place:int,startup_name:string,description:string,signal_type:string,region:string,categories:array<string>,funding:struct<round:string,amount:string,currency:string,investors:array<string>>,sources:array<struct<source_id:string,source_url:string>>>"
    full = (1, "A & B", "d " * 300, "launch", "ASIA", ["AI"], ("", "", "", []), [("s", "https://x.example/")])
    rows = spark.createDataFrame([(1, "2024-01-08", "Europe/Berlin", []), (2, "2024-01-08", "Europe/Berlin", [full]), (3, "", "", [])], f"k int, digest_date string, timezone string, items array<{item}>")
    got = {r.k: r.text for r in render.messages(rows, limit).collect()}
    assert set(got) == {1, 2, 3} and all(len(t.encode()) <= limit for t in got.values())
    whole = "🚀 <b>Стартапы дня</b>\n<i>8 января 2024 · Europe/Berlin</i>"
    plain = "🚀 Стартапы дня\n8 января 2024 · Europe/Berlin"
    said = f"{whole}\n\n{render.EMPTY}" if limit >= len(whole.encode()) else None
    if said and len(said.encode()) <= limit:
        assert got[1] == said
    else:
        bare = f"{plain}\n\n{render.EMPTY}"
        assert got[1] == ("." * limit if limit < 3 else bare if len(bare.encode()) <= limit else f"{got[1][:-1]}…") and (limit < 3 or bare.startswith(got[1].removesuffix("…")))


REPORTS = "delivery_id long, attempt_id string, attempted_nano long, status string, sequence int, total int"


def test_refused_reports_are_judged_anew(spark):
    """A report with a gap is refused and forgotten; accepted ones are answered as before; ids of others conflict."""
    rows = [
        (1, "x", 1, "success", 2, 3), (1, "y", 2, "success", 1, 3), (1, "x", 3, "success", 2, 3), (1, "y", 4, "success", 1, 3),
        (2, "y", 5, "success", 1, 3), (2, "z", 6, "failed", 0, 3), (2, "z", 7, "failed", 0, 3), (2, "v", 8, "success", 0, 3), (2, "v", 9, "success", 0, 3), (2, "w", 10, "success", 0, 3),
    ]
    got = {r.delivery_id: r for r in delivery.outcomes(spark.createDataFrame(rows, REPORTS), "attempted_nano").collect()}
    assert (got[1].status, got[1].confirmed_through, got[1].accepted, got[1].duplicate, got[1].conflict) == ("due", 2, 2, 1, 1)
    assert (got[2].status, got[2].confirmed_through, got[2].accepted, got[2].duplicate, got[2].terminal, got[2].conflict) == ("sent", 3, 2, 2, 1, 1)
