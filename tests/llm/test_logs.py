"""Chat logs and URL lists against plain folds."""

import datetime
import random

import brute
from pyspark.sql import functions as F

from millrace.llm import chat_format, url_lists

KINDS = ["message", "delta", "delta", "delta", "edit", "regenerate"]
LOG = "conv_id long, seq long, kind string, turn long, role string, text string, message long"


def fold(events):
    """One event after another."""
    out, begun = {}, set()
    for _, _, kind, turn, role, text in sorted(events, key=lambda e: e[1]):
        text = text or ""
        if kind == "message":
            out[turn] = [role, text]
            begun.add(turn)
        elif turn in begun:
            if kind == "regenerate":
                out = {t: m for t, m in out.items() if t <= turn}
            if turn in out:
                out[turn][1] = out[turn][1] + text if kind == "delta" else text
    return [(t, *out[t]) for t in sorted(out)]


def test_folded_logs(spark):
    r = random.Random(11)
    logs = {}
    for conv in range(60):
        n, events = 0, []
        for seq in range(r.randrange(1, 25)):
            if not n or r.random() < 0.35:
                n += 1
                events.append((conv, seq, "message", n, r.choice(["user", "assistant"]), r.choice([None, "", "hi </turn>", "\\o <turn:x>"])))
            else:
                events.append((conv, seq, r.choice(KINDS[1:]), n if r.random() < 0.8 else r.randrange(1, n + 1), None, r.choice([None, "ab", " c"])))
        logs[conv] = events
    rows = [(*e, 0) for events in logs.values() for e in events]
    r.shuffle(rows)
    got = {}
    for m in chat_format.folded(spark.createDataFrame(rows, LOG)).collect():
        got.setdefault(m.conv_id, []).append((m.turn, m.role, m.text))
    assert {c: sorted(m) for c, m in got.items()} == {c: want for c, e in logs.items() if (want := fold(e))}


def test_long_logs_fold_over_many_parts(spark):
    """A conversation of hundreds of turns: regenerations drop what began before them, in their own part and later ones."""
    r, events = random.Random(14), []
    for seq in range(900):
        kind = r.choices(["message", "delta", "edit", "regenerate"], [50, 30, 10, 1])[0]
        turn = seq // 2 + 3 if kind == "message" else r.randrange(max(1, seq // 2 - 150), seq // 2 + 3)
        events.append((1, seq, kind, turn, "user", f"t{seq}"))
    got = chat_format.folded(spark.createDataFrame([(*e, 0) for e in events], LOG).repartition(5))
    want = fold(events)
    assert 50 < len(want) < 400 and sorted((m.turn, m.role, m.text) for m in got.collect()) == want


def test_derived_logs_have_all_kinds_and_fold_to_the_table(spark, sf):
    odd = [(-1, None, "assistant", "x" * 700), (-1, 1, "assistant", "y"), (-1, 1, "assistant", "y"), (None, 0, "user", None), (-2, 70, None, "a\x00b"), (-2, 10**9, "assistant", "z" * 300_000), (-3, -5, "assistant", "")]
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    log = chat_format.events_of(given)
    kinds = {x.kind: x["count"] for x in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(KINDS) and kinds["message"] > given.count() and kinds["regenerate"] > 30
    assert log.where("kind = 'delta'").agg(F.max(F.length("text"))).first()[0] == 300
    got = sorted(repr(tuple(m)) for m in chat_format.folded(log).collect())
    assert got == sorted(repr((m.conv_id, m.turn, m.role, m.text or "")) for m in given.collect())


def test_format_reads_back(spark):
    r = random.Random(12)
    parts = ["\\", "\\e", "<turn:", "</turn>", "\n", ">", "o", "\\c", "🙂", "</turn>\n<turn:user>"]
    said = {c: [(r.choice(["user", "assistant", "a>b", "</turn>"]), "".join(r.choices(parts, k=r.randrange(8)))) for _ in range(r.randrange(1, 150))] for c in range(12)}
    rows = [(c, t, role, text) for c, turns in said.items() for t, (role, text) in enumerate(turns)]
    got = {x.conv_id: x for x in chat_format.digests(chat_format.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c, turns in said.items():
        lost = "".join(text for role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(lost), brute.sha(lost))


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, None, None, None), (3, 5, "assistant", "long " * 50_000)]
    messages = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, seq long")
    got = {x.conv_id: x.n_turns for x in chat_format.digests(chat_format.rendered(chat_format.folded(chat_format.events_of(messages)))).collect()}
    assert got == {1: 2, None: 1, 2: 1, 3: 1}
    assert chat_format.digests(chat_format.rendered(chat_format.folded(chat_format.events_of(messages.limit(0))))).count() == 0


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_url_lists_as_of(spark):
    r = random.Random(13)
    patterns = ["a.example", "b.a.example", "b.a.example/x", "b.a.example/x/y", "example", "c.example/x", "other.test"]
    changes = sorted({(r.choice(patterns), r.choice(["block", "allow"]), day(r.randrange(40)), r.choice(["add", "remove"])) for _ in range(60)})
    urls = ["https://b.a.example/x/y/z?q", "http://A.example", "https://c.example:8080/x", "https://xc.example/x", "https://u:p@b.a.example./xx", "nothing", None, "", "https://other.test/x/y"]
    captures = [(k, r.choice(urls), None if k % 20 == 0 else day(r.randrange(50)), 1) for k in range(400)] + [(5, urls[0], day(20), 1)] * 3
    log = {}
    for p, a, at, c in changes:
        log.setdefault((p, a), {})
        log[p, a][at] = max(c, log[p, a].get(at, ""))

    def decide(url, at):
        host, path = {"https://b.a.example/x/y/z?q": ("b.a.example", "/x/y/z"), "http://A.example": ("a.example", ""), "https://c.example:8080/x": ("c.example", "/x"), "https://xc.example/x": ("xc.example", "/x"),
                      "https://u:p@b.a.example./xx": ("b.a.example", "/xx"), "https://other.test/x/y": ("other.test", "/x/y")}.get(url, (None, ""))
        if host is None:
            return None, "invalid", None
        best = None
        for (p, a), events in log.items():
            domain, _, rest = p.partition("/")
            begun = [t for t in events if at and t <= at]
            if not begun or events[max(begun)] != "add" or not (host == domain or host.endswith("." + domain)) or not (not rest or (path + "/").startswith(f"/{rest}/")):
                continue
            found = (len(p), max(begun), a == "block", p, a)
            best = found if best is None else max(best, found)
        return (host, best[4], best[3]) if best else (host, "pass", None)

    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, pattern int")
    got = url_lists.filtered(df, spark.createDataFrame([*changes, (None, "block", day(1), "add"), changes[0]], "pattern string, action string, at timestamp, change string"))
    want = sorted(repr((i, u, *decide(u, at))) for i, u, at, _ in captures)
    assert sorted(repr((x.page_id, x.url, x.host, x.decision, x.pattern)) for x in got.collect()) == want
    assert url_lists.filtered(df.limit(0), df.select(F.lit("a").alias("pattern"), F.lit("block").alias("action"), F.col("fetched_at").alias("at"), F.lit("add").alias("change"))).count() == 0


def test_url_lists_of_any_depth(spark):
    host = "h.g.f.e.d.c.b.a.test"
    patterns = ["x.example/a/b/c/d/e", "x.example/a", "b.a.test", "f.e.d.c.b.a.test", f"{host}/p/q/r/s", "g.f.e.d.c.b.a.test/p"]
    patterns += ["[2001:db8::1]", "[2001:db8::2]/x"]
    changes = [(p, "allow" if p == "x.example/a" else "block", day(0), "add") for p in patterns]
    want = {
        "https://x.example/a/b/c/d/e/f": ("block", "x.example/a/b/c/d/e"), "https://y.x.example/a/b/c/d/e": ("block", "x.example/a/b/c/d/e"), "https://x.example/a/b/c/d/ee": ("allow", "x.example/a"),
        f"https://{host}/": ("block", "f.e.d.c.b.a.test"), f"https://{host}/p/q": ("block", "g.f.e.d.c.b.a.test/p"), f"https://{host}/p/q/r/s/t": ("block", f"{host}/p/q/r/s"),
        "https://i.b.a.test/p/q/r/s": ("block", "b.a.test"), "https://a.test/p": ("pass", None),
        "https://[2001:db8::1]:8443/x": ("block", "[2001:db8::1]"), "https://u@[2001:DB8::2]/x/y": ("block", "[2001:db8::2]/x"), "https://[2001:db8::2]/y": ("pass", None),
    }
    df = spark.createDataFrame([(k, u, day(1)) for k, u in enumerate(want)], "page_id long, url string, fetched_at timestamp")
    got = url_lists.filtered(df, spark.createDataFrame(changes, "pattern string, action string, at timestamp, change string"))
    assert {x.url: (x.decision, x.pattern) for x in got.collect()} == want


def test_patterns_as_lists_write_them(spark):
    """Case, final dots, ports, schemes, users and slashes at the end make no difference."""
    t = datetime.datetime(2024, 1, 1)
    patterns = ["Slash.com/a/", "dot.com.", "h.com:8443", "UPPER.com", "https://scheme.com/x//y/", "//rel.com", "user@mail.com", "q.com/p?x=1#f", "/no/host", "", None, " .", "[::1]:80"]
    changes = spark.createDataFrame([(p, "block", t, "add") for p in patterns] + [("dot.com", "block", t + datetime.timedelta(days=3), "remove")], "pattern string, action string, at timestamp, change string")
    urls = {"http://slash.com/a/b": "slash.com/a", "http://x.dot.com/": "dot.com", "http://h.com:9/": "h.com", "http://a.upper.com": "upper.com", "http://scheme.com/x/y/z": "scheme.com/x/y", "http://rel.com/": "rel.com", "http://mail.com": "mail.com", "http://q.com/p": "q.com/p", "http://no.com/no/host": None, "http://slash.com/": None, "http://[::1]/": "[::1]"}
    captures = spark.createDataFrame([(k, u, t + datetime.timedelta(days=1)) for k, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    got = {r.url: (r.decision, r.pattern) for r in url_lists.filtered(captures, changes).collect()}
    assert got == {u: ("block" if p else "pass", p) for u, p in urls.items()}
    late = captures.withColumn("fetched_at", F.lit(t + datetime.timedelta(days=4)))
    assert {r.url: r.decision for r in url_lists.filtered(late, changes).collect()}["http://x.dot.com/"] == "pass"


def test_lists_of_too_many_shapes_are_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(url_lists, "SHAPES", 3)
    changes = spark.createDataFrame([("/".join(["a.com", *"x" * k]), "block", datetime.datetime(2024, 1, 1), "add") for k in range(4)], "pattern string, action string, at timestamp, change string")
    with pytest.raises(ValueError, match="shapes"):
        url_lists.filtered(spark.createDataFrame([], "page_id long, url string, fetched_at timestamp"), changes)
