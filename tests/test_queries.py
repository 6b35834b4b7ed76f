"""Every query against its SQL; those without SQL against what they must satisfy."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalog, services

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"render_messages"}


def test_messages_hold_every_item_once_in_order_within_the_limit(spark, sf):
    digests = {(r.window_id, r.owner): r.n for r in services.stored_digests(spark, sf).select("window_id", "owner", F.size("items").alias("n")).collect()}
    texts: dict = {}
    for r in QUERIES["render_messages"](spark, sf).orderBy("sequence").collect():
        assert len(r.text.encode()) <= 3000 and r.text.startswith("🚀 <b>Стартапы дня</b>")
        texts.setdefault((r.window_id, r.owner), []).append((r.sequence, r.text))
    assert set(texts) == set(digests)
    for key, parts in texts.items():
        assert [n for n, _ in parts] == list(range(1, len(parts) + 1))
        blocks = [b for _, t in parts for b in t.split("\n\n")[1:]]
        assert [b.split(".")[0] for b in blocks] == [str(k + 1) for k in range(digests[key])]
