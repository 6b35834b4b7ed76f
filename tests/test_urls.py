"""URLs beyond the simple form: normal forms, the gate, identity keys, address literals."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity, urls
from millrace.operators import delivery, quality
from millrace.sources import feeds

NORMAL = {
    "https://X.example/a%20b": "https://x.example/a%20b",
    "https://x.example/a:b,c+d@e": "https://x.example/a:b,c+d@e",
    "https://x.example/?q=a%2fb&utm_source=y&b=c,d": "https://x.example?b=c%2Cd&q=a%2Fb",
    "https://x.example/p?z=1+2&%75tm_x=1&a=%FF#t": "https://x.example/p?a=%FF&z=1+2",
    "https://x.example/é?ü=1": "https://x.example/%C3%A9?%C3%BC=1",
    "https://x.example/a b": "https://x.example/a%20b",
    "https://Bücher.example": "https://b%C3%BCcher.example",
    "https://[2606:4700::1111]:443/a": "https://[2606:4700::1111]/a",
    "https://8.8.8.8:8443/": "https://8.8.8.8:8443",
    "\thttps://x.example/a\n": "https://x.example/a",
    "https://x.example/%zz": None,
    "https://x.example/?a=%z": None,
    "https://x.example/?a;b": None,
    "https://u@x.example/%20": None,
    "https://x|y.example/": None,
    "https://x.example:0/a,b": None,
    "http://x.example/%20": None,
    "": None,
    None: None,
}
WHOLE = ["https://x.example/a%20b", "https://x.example/a:b", "https://x.example/?q=a%2Fb", "https://8.8.8.8/a"]


def test_normal_forms(spark):
    rows = spark.createDataFrame([(u,) for u in NORMAL], "url string")
    assert {r.url: r.n for r in rows.select("url", urls.normal_url(F.col("url")).alias("n")).collect()} == NORMAL


@pytest.mark.parametrize("column", ["source_url", "canonical_url"])
def test_gate_passes_sound_urls(column, spark):
    one = feeds.sample(spark)
    records = one.drop(column).crossJoin(spark.createDataFrame([(u,) for u in WHOLE], f"{column} string"))
    got = quality.gated(records, 1_704_067_200 * 10**9, None, None).collect()
    assert [r.reason for r in got] == [None] * len(WHOLE) and len({r.id for r in got}) == len(WHOLE)


def test_identity_keeps_sound_urls(spark):
    none = F.struct(*[F.lit("").alias(k) for k in ("round", "amount", "currency")])
    rows = spark.createDataFrame([(u,) for u in WHOLE], "url string")
    keys = rows.select("url", identity.identity(F.lit("Acme"), F.lit(""), F.lit(""), F.col("url"), F.col("url"), none).alias("k")).collect()
    assert {(k.k.url, k.k.event) for k in keys} == {(f"url:{NORMAL.get(u, u)}", NORMAL.get(u, u)) for u in (x.replace("/?", "?") for x in WHOLE)}


def test_public_literals_are_shown(spark):
    cited = {
        "https://8.8.8.8/a": True, "https://[2606:4700::1111]:8443/a": True, "https://x.example/a%20b": True, "https://10.0.0.1/": False, "https://127.0.0.1:80/": False, "https://[::1]/": False,
        "https://[::ffff:10.0.0.1]/": False, "https://203.0.113.9/": False, "https://localhost/": False,
    }
    items = spark.createDataFrame([(u, [("s", u)]) for u in cited], "id string, attributions array<struct<source_id:string,source_url:string>>")
    got = delivery.display(items, spark.createDataFrame([("s",)], "source_id string"), "id").collect()
    assert {r.id: r.allowed for r in got} == cited
