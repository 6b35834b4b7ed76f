"""Deliveries: what is due, what a report changes, what is suppressed.

Reports are folded in order through the states due, retry, sent, failed, blocked, suppressed. A delivery accepts one
report for each message and attempt at most, however many are sent, and between two accepted ones its state stands
still. So the fold goes from one accepted report to the next, for all deliveries at once: of the reports that its state
would accept, each delivery takes the first, a minimum. States meet reports by shuffles, as neither side need be small;
reports of a delivery that has very many are dealt to parts. No delivery's reports are ever together in an array, and what
each refused report is told follows from the accepted ones.

An attempt id belongs to the delivery that accepted it first. A report that was refused owns nothing, and is judged anew
when it comes again. Where several deliveries use an id, who owns it depends on what the others accepted before; deliveries
that took, or were denied, what the owners say otherwise are folded again with these, until there are none. What a report is told
depends on earlier reports alone, so each round settles at least the next report in dispute, and nothing else is stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import canonical_list
from millrace.functions.urls import public_url
from millrace.session import apart, dropped, staged

TERMINAL = ("sent", "failed", "blocked", "suppressed")
PAGE = 100
ATTEMPTS = 3
DELAY = 15 * 60 * 10**9


def due(deliveries: DataFrame, subscribers: DataFrame, now_nano: int, page: int = PAGE) -> DataFrame:
    """The oldest deliveries to send now: due or to be tried again, of active subscribers."""
    ready = deliveries.where(F.col("status").isin("due", "retry") & (F.col("next_attempt_nano").isNull() | (F.col("next_attempt_nano") <= now_nano)))
    return ready.join(subscribers.where("active").select("telegram_id"), "telegram_id").orderBy("created_nano", "id").limit(page)


def pending(messages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Messages (delivery_id, sequence) that their delivery has not confirmed."""
    return messages.join(deliveries.select(F.col("id").alias("delivery_id"), "confirmed_through"), "delivery_id").where("sequence > confirmed_through")


def decided(status: Column, previous: Column, attempted_nano: Column) -> Column:
    """struct(status, attempt, next_attempt_nano, inactive) after a final report."""
    attempt = previous + 1
    again = (status == "failed") & (attempt < ATTEMPTS)
    new = F.when(status == "blocked", "blocked").when(status == "success", "sent").when(again, "retry").otherwise("failed")
    return F.struct(new.alias("status"), attempt.alias("attempt"), F.when(again, attempted_nano + DELAY).alias("next_attempt_nano"), (status == "blocked").alias("inactive"))


#: What is kept of a delivery, and of an id that a delivery accepted. `at` is the place of its last accepted report.
STATE = ["delivery_id", "status", "attempt", "confirmed_through", "next_attempt_nano", "inactive", "at"]
OWNED = ["attempt_id", "owner", "owned_at"]
COUNTS = ["accepted", "duplicate", "terminal", "conflict"]
#: Reports of a delivery that meet its state in one task, about.
MOST = 50_000


def fits() -> Column:
    """Whether a report is legal for its delivery's state, both in one row."""
    expected = (F.col("sequence") == 0) | (F.col("sequence") == F.col("confirmed_through") + 1)
    sound = F.col("status").isin("success", "failed", "blocked") & (F.col("total") > 0) & F.col("sequence").between(0, F.col("total"))
    return sound & (F.col("confirmed_through") <= F.col("total")) & expected


def accepted_by(state: DataFrame, first: DataFrame) -> DataFrame:
    """States of the deliveries that accept a report, after the first that each accepts (delivery_id, r: its place): a success
    before the last message only moves the cursor, any other report decides."""
    r = F.col("r")
    step = (r["status"] == "success") & (r["sequence"] > 0) & (r["sequence"] < r["total"])
    done = decided(r["status"], F.col("attempt"), r["attempted_nano"])
    pick = lambda name, moved, final: F.when(step, moved).otherwise(final).alias(name)
    return state.join(apart(first), "delivery_id").select(
        "delivery_id",
        pick("status", F.lit("due"), done["status"]),
        pick("attempt", F.col("attempt"), done["attempt"]),
        pick("confirmed_through", r["sequence"], F.when(r["status"] == "success", r["total"]).otherwise(F.col("confirmed_through"))),
        pick("next_attempt_nano", F.lit(None).cast("long"), done["next_attempt_nano"]),
        pick("inactive", F.col("inactive"), F.col("inactive") | done["inactive"]),
        r.alias("at"),
        "parts",
    )


def by_part(state: DataFrame, *values: Column) -> DataFrame:
    """A row with values for each part of a delivery."""
    return state.select("delivery_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *values)


def folded(reports: DataFrame, state: DataFrame, owned: DataFrame, rivals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, accepted) after reports (delivery_id, part, attempt_id, at). No report is accepted of an id that is owned before
    them, or that another delivery has from an earlier place on, as rivals say. There are as many steps as a delivery accepts
    reports at most; a step reads what its deliveries have left, and asks none again that accepted nothing."""
    left = reports.join(apart(owned.select("attempt_id")), "attempt_id", "left_anti")
    if rivals is not None:
        left = left.join(apart(rivals.select("attempt_id", "owner", "owned_at")), "attempt_id", "left")
        left = left.where(F.col("owner").isNull() | (F.col("owner") == F.col("delivery_id")) | (F.col("at") < F.col("owned_at")))
    left = left.select("delivery_id", "part", "at").where(F.col("at.status").isin("success", "failed", "blocked") & (F.col("at.total") > 0))
    now, had, states, old = state, F.lit(None).cast("string"), [state], None
    while True:
        of = by_part(now.where(~F.col("status").isin(*TERMINAL)), F.col("confirmed_through"), F.col("at").alias("last"), had.alias("had"))
        rows = left.join(apart(of), ["delivery_id", "part"]).where(F.col("last").isNull() | (F.col("at") > F.col("last")))
        rows = staged(rows.where(F.coalesce(F.col("at.attempt_id") != F.col("had"), F.lit(True))).select("delivery_id", "part", "at", "confirmed_through"))
        if old is not None:
            dropped(old)
        fit = rows.select("delivery_id", "at", "confirmed_through", "at.status", "at.sequence", "at.total").where(fits())
        now, had = staged(accepted_by(now, fit.groupBy("delivery_id").agg(F.min("at").alias("r")))), F.col("at.attempt_id")
        old, left = rows, rows.drop("confirmed_through")
        if now.isEmpty():
            break
        states.append(now)
    dropped(old)
    accepted = now.select("delivery_id", F.col("at.attempt_id").alias("attempt_id"), "at")
    for some in states[1:]:
        accepted = accepted.unionByName(some.select(accepted.columns[0], F.col("at.attempt_id").alias("attempt_id"), "at"))
    return last_of(states), accepted


def last_of(states: list[DataFrame]) -> DataFrame:
    """Each delivery's row in the last of states that has one."""
    rest = [c for c in states[0].columns if c != "delivery_id"]
    rows = [s.select("delivery_id", F.lit(k).alias("k"), F.struct(*rest).alias("s")) for k, s in enumerate(states)]
    every = rows[0]
    for some in rows[1:]:
        every = every.unionByName(some)
    return staged(every.groupBy("delivery_id").agg(F.max_by("s", "k").alias("s")).select("delivery_id", "s.*"))


def owners(accepted: DataFrame) -> DataFrame:
    """(attempt_id, owner, owned_at): the delivery that accepted an id first."""
    return accepted.groupBy("attempt_id").agg(F.min(F.struct("at", "delivery_id")).alias("o")).select("attempt_id", F.col("o.delivery_id").alias("owner"), F.col("o.at").alias("owned_at"))


def new_states(reports: DataFrame) -> DataFrame:
    at = reports.schema["at"].dataType
    return reports.select("delivery_id").distinct().select("delivery_id", F.lit("due").alias("status"), F.lit(0).alias("attempt"), F.lit(0).alias("confirmed_through"), F.lit(None).cast("long").alias("next_attempt_nano"), F.lit(False).alias("inactive"), F.lit(None).cast(at).alias("at"))


def placed(reports: DataFrame, *order: str) -> DataFrame:
    """reports with `at`, their place among all: by `order`, then by what they say, so that no two places are the same."""
    said = ["attempt_id", "delivery_id", "attempted_nano", "status", "sequence", "total"]
    return reports.select(*said, F.struct(*order, *[c for c in said if c not in order]).alias("at"))


def in_parts(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staged reports with part, the states of their deliveries with parts): reports of a delivery that has very many meet its
    state in parts, a task for each. There is one such delivery for MOST reports at most."""
    sizes = staged(rows.groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n")))
    before = state.join(apart(sizes.select("delivery_id")), "delivery_id", "left_semi").select(*STATE)
    none = F.lit(None).cast(rows.schema["at"].dataType)
    new = new_states(sizes.select("delivery_id", none.alias("at"))).join(apart(state.select("delivery_id")), "delivery_id", "left_anti")
    start = before.unionByName(new)
    many = sizes.where(F.col("n") > MOST).select("delivery_id", F.ceil(F.col("n") / MOST).cast("int").alias("parts"))
    if many.isEmpty():
        return rows.withColumn("part", F.lit(0)), staged(start.withColumn("parts", F.lit(1)))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(F.broadcast(many), "delivery_id", "left").withColumn("part", F.pmod(F.xxhash64("at"), parts).cast("int")).drop("parts")
    return staged(rows), staged(start.join(F.broadcast(many), "delivery_id", "left").withColumn("parts", parts))


def continued(reports: DataFrame, state: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state of the reports' deliveries, newly owned ids, counts of what reports were told) of placed() reports, given the
    states and owners before them."""
    rows, start = in_parts(staged(reports), state)
    asked = staged(owned.join(apart(rows.select("attempt_id").distinct()), "attempt_id", "left_semi").select(*OWNED))
    if asked.isEmpty():
        asked = asked.where(F.lit(False))  # known to be empty before anything moves to meet it
    now, accepted = folded(rows, start, asked)
    given, earlier = staged(owners(accepted).select(*OWNED)), None
    while True:
        # what the owners take from a delivery, and what the owners before them took and may not take any more
        theirs = (F.col("owner") != F.col("delivery_id")) & (F.col("at") > F.col("owned_at"))
        again = accepted.join(apart(given), "attempt_id").where(theirs).select("delivery_id")
        if earlier is not None:
            again = again.union(rows.join(staged(earlier.exceptAll(given)), "attempt_id").where(theirs).select("delivery_id"))
        again = staged(again.distinct())
        if again.isEmpty():
            break
        more, some = folded(rows.join(again, "delivery_id", "left_semi"), start.join(again, "delivery_id", "left_semi"), asked, given)
        now = staged(now.join(again, "delivery_id", "left_anti").unionByName(more))
        accepted = staged(accepted.join(again, "delivery_id", "left_anti").select(*some.columns).unionByName(some))
        given, earlier = staged(owners(accepted).select(*OWNED)), given
    known = F.coalesce(F.col("at") >= F.col("owned_at"), F.lit(False))
    own = known & (F.col("owner") == F.col("delivery_id"))
    by_id = F.when(own & (F.col("at") == F.col("owned_at")), "accepted").when(own, "duplicate").when(known, "conflict")
    told = rows.join(apart(asked.unionByName(given)), "attempt_id", "left").select("delivery_id", "part", "at", by_id.alias("by_id"))
    told = told.join(apart(by_part(now, F.col("at").alias("last"), F.col("status").isin(*TERMINAL).alias("ended"))), ["delivery_id", "part"])
    over = F.col("ended") & (F.col("last").isNull() | (F.col("at") > F.col("last")))
    told = told.select("delivery_id", F.coalesce("by_id", F.when(over, "terminal").otherwise("conflict")).alias("kind"), "at")
    kinds = told.groupBy("delivery_id", "kind", F.when(F.col("kind") == "accepted", F.col("at")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    # of equal reports one is accepted, the others repeat it
    count = lambda c, n: F.sum(F.when(F.col("kind") == c, n).otherwise(0)).cast("int").alias(c)
    first = F.when(F.col("kind") == "accepted", 1).otherwise(0)
    counts = kinds.groupBy("delivery_id").agg(F.sum(first).cast("int").alias("accepted"), (F.sum(F.when(F.col("kind") == "duplicate", F.col("n")).otherwise(0)) + F.sum(F.when(F.col("kind") == "accepted", F.col("n") - 1).otherwise(0))).cast("int").alias("duplicate"), count("terminal", F.col("n")), count("conflict", F.col("n")))
    return now.select(*STATE), given, counts


def outcomes(reports: DataFrame, *order: str) -> DataFrame:
    """Final state per delivery of reports (delivery_id, attempt_id, attempted_nano, status, sequence, total) in `order`,
    from a new delivery, and how many were accepted, duplicate, terminal or in conflict. A report whose id the delivery
    accepted before is a duplicate, one whose id another delivery accepted before conflicts; a terminal delivery refuses;
    then sequence and total must fit."""
    rows = placed(reports, *order)
    none = new_states(rows).limit(0)
    owned = rows.select("attempt_id", F.col("delivery_id").alias("owner"), F.col("at").alias("owned_at")).limit(0)
    now, _, counts = continued(rows, none, owned)
    return now.join(apart(counts), "delivery_id").drop("at")


def display(items: DataFrame, policy: DataFrame, *by: str) -> DataFrame:
    """Per digest, of items with attributions (array of source_id, source_url): whether it may be shown, and which sources
    forbid it. An item without attribution forbids it with no source named; a digest without items may be shown."""
    bare = items.groupBy(*by).agg(F.max(F.size("attributions") == 0).alias("bare"))
    rows = items.select(*by, F.explode("attributions").alias("a")).select(*by, "a.source_id", "a.source_url")
    rows = rows.join(policy.select("source_id").withColumn("known", F.lit(True)), "source_id", "left")
    bad = F.col("known").isNull() | ~public_url(F.col("source_url"))
    found = rows.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(bad, F.col("source_id")))).alias("offending"))
    out = bare.join(found, [*by], "left")
    offending = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.coalesce("offending", F.array().cast("array<string>")))
    return out.select(*by, (~F.col("bare") & (F.size(offending) == 0)).alias("allowed"), offending.alias("offending"))


def suppressed(deliveries: DataFrame, requests: DataFrame) -> DataFrame:
    """Deliveries after suppression requests (id, expected_attempt, expected_confirmed, reason, source_ids, at_nano,
    revision): answer is applied, replay (the same request again), terminal, conflict or null without a request."""
    q = requests.select("id", "expected_attempt", "expected_confirmed", "reason", canonical_list(F.col("source_ids")).alias("source_ids"), "at_nano", "revision")
    rows = deliveries.join(q, "id", "left")
    asked = F.col("reason").isNotNull()
    same = F.col("suppression_reason").eqNullSafe(F.col("reason")) & F.col("suppressed_source_ids").eqNullSafe(F.col("source_ids")) & F.col("suppressed_nano").eqNullSafe(F.col("at_nano")) & F.col("catalog_revision").eqNullSafe(F.col("revision"))
    current = (F.col("attempt") == F.col("expected_attempt")) & (F.col("confirmed_through") == F.col("expected_confirmed"))
    answer = (
        F.when(~asked, F.lit(None).cast("string"))
        .when((F.col("status") == "suppressed") & current & same, "replay")
        .when(F.col("status").isin(*TERMINAL), "terminal")
        .when(F.col("status").isin("due", "retry") & current, "applied")
        .otherwise("conflict")
    )
    rows = rows.withColumn("answer", answer)
    done = F.coalesce(F.col("answer") == "applied", F.lit(False))
    put = lambda old, new: F.when(done, new).otherwise(F.col(old))
    return rows.withColumns(
        {
            "suppression_reason": put("suppression_reason", F.col("reason")),
            "suppressed_source_ids": put("suppressed_source_ids", F.col("source_ids")),
            "suppressed_nano": put("suppressed_nano", F.col("at_nano")),
            "catalog_revision": put("catalog_revision", F.col("revision")),
            "next_attempt_nano": put("next_attempt_nano", F.lit(None).cast("long")),
            "status": put("status", F.lit("suppressed")),
        }
    ).select(*deliveries.columns, "answer")


def latest(deliveries: DataFrame) -> DataFrame:
    """The newest delivery of each subscriber."""
    newest = Window.partitionBy("telegram_id").orderBy(F.col("created_nano").desc(), F.col("id").desc())
    return deliveries.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def snapshot(deliveries: DataFrame, runs: DataFrame, items: DataFrame, attempts: DataFrame) -> DataFrame:
    """What is stored of each subscriber's newest delivery: its row with digest_id, candidate_count of its run, its items in
    order of rank and id, and its attempts in order of time and id. A delivery whose digest has no run gives none.

    Only rows of newest deliveries are put together, an array for each kind, as the result holds them.
    """
    newest = latest(deliveries).join(runs.select("digest_id", "candidate_count"), "digest_id")
    own = items.join(newest.select("digest_id"), "digest_id", "left_semi")
    shown = own.groupBy("digest_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "candidate_identity", "startup_name"))).alias("items"))
    tried = attempts.join(newest.select(F.col("id").alias("delivery_id")), "delivery_id", "left_semi")
    told = tried.groupBy("delivery_id").agg(F.array_sort(F.collect_list(F.struct("attempted_nano", "attempt_id", "status", "message_id"))).alias("attempts"))
    rows = newest.join(shown, "digest_id", "left").join(told.withColumnRenamed("delivery_id", "id"), "id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind.schema[c].dataType)).alias(c)
    return rows.select(*deliveries.columns, "candidate_count", empty("items", shown), empty("attempts", told))
