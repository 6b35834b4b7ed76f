"""Headlines to company events: who, what kind of signal, how much money. All as column expressions; a headline that
does not say it plainly gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import SPACES, bound, clean_text, squeezed, trimmed

# What the grammars know.
PRESS_VERBS = ("raises", "secures", "launches", "wins", "receives", "acquires", "is acquired by")
NEWS_VERBS = ("raises", "secures", "closes", "launches", "debuts", "enters", "expands")
GROUPS = ("businesses", "companies", "consortium", "consortia", "entrepreneurs", "firms", "founders", "funds", "lenders", "organisations", "organizations", "portfolio", "programmes", "programs", "projects", "researchers", "schemes", "spinouts", "start-?ups", "universities")
QUANTIFIERS = ("a group of", "dozens", "hundreds", "many", "multiple", "several", "thousands", "various")
NO_COMPANIES = ("corporate report", "guidance", "notice", "policy", "policy paper", "projects", "report", "research", "scheme", "startups", "start-ups", "transparency data", "universities")
EDITORIAL = ("analysis", "comment", "editorial", "explainer", "how", "opinion", "round-?up", "the week", r"top\s+\d+", "weekly", "what", "why")
MERGERS = ("acquires", "acquired", "acquisition", "merger", "m&a")
FUNDS = ("fund", "funds", "investor", "investors", "venture capital", "vc")
PEOPLE = ("ceo", "chief", "co-?founder", "executive", "exec", "founder", "investor", "partner")
NOT_LAUNCHED = ("conference", "event", "fund", "funds", "list", "programme", "program", "report", "summit", "webinar")
LAUNCHED = ("api", "app", "application", "device", "marketplace", "model", "network", "platform", "product", "service", "software", "solution", "system", "technology", "tool")
GENERIC_PREFIXES = ("a", "an", "new", "stealth", "the", "this", "unnamed")
GENERIC_WORDS = ("app", "application", "company", "platform", "product", "service", "solution", "technology", "tool")
CURRENCIES = {"£": "GBP", "$": "USD", "€": "EUR"}
SHOW_DENIED = ("a", "an", "i", "we", "my", "our", "how", "why", "what", "when", "build", "building", "built", "create", "deploy", "find", "get", "getting", "launch", "make", "made", "run", "turn", "turning", "use", "using")

# The forms of money and rounds in titles.
AMOUNT = r"(?i)([£$€])(\d+(?:\.\d+)?)\s*(million|billion|m|bn)\b"
ROUND = r"(?i)\b(pre-seed|seed|series\s+[a-z]|growth)\b"
NAMED_ROUND = r"(?i)\b(?:(pre-seed|seed|growth)\s+(?:funding\s+)?round|(series\s+[a-z]))\b"


def words(*lists: str) -> str:
    return rf"(?i)\b({'|'.join(lists)})\b"


def begins(*lists: str) -> str:
    return rf"(?i)^\s*({'|'.join(lists)})\b"


def funding(title: Column, named_round: bool = False) -> Column:
    """struct(round, amount, currency, investors) that a title states."""
    sign = F.regexp_extract(title, AMOUNT, 1)
    currency = F.lit("")
    for symbol, code in CURRENCIES.items():
        currency = F.when(sign == symbol, code).otherwise(currency)
    found = F.concat(F.regexp_extract(title, NAMED_ROUND, 1), F.regexp_extract(title, NAMED_ROUND, 2)) if named_round else F.regexp_extract(title, ROUND, 1)
    amount = F.when(sign != "", F.concat(F.regexp_extract(title, AMOUNT, 2), F.lit(" "), F.lower(F.regexp_extract(title, AMOUNT, 3)))).otherwise("")
    return F.struct(F.lower(squeezed(found)).alias("round"), amount.alias("amount"), currency.alias("currency"), F.array().cast("array<string>").alias("investors"))


def one_company(name: Column, denied: list[str]) -> Column:
    """Whether a subject may be the name of one company."""
    lower = F.lower(squeezed(name))
    subject = F.exists(F.array(*[F.lit(x) for x in (*NO_COMPANIES, *denied)]), lambda s: (lower == s) | lower.startswith(F.concat(s, F.lit(" "))))
    return F.char_length(name).between(2, 120) & ~name.contains(":") & ~name.rlike(r"^\s*\d+\s") & ~name.rlike(begins(*QUANTIFIERS)) & ~name.rlike(words(*GROUPS)) & name.rlike(r"\p{L}") & ~subject


def press_event(title: Column, denied: list[str]) -> Column:
    """struct(name, signal_type, funding) of a press headline, or null."""
    t = trimmed(title)
    shape = rf"(?i)^(.+?)\s+({'|'.join(PRESS_VERBS)})\b"
    name, verb, money = trimmed(F.regexp_extract(t, shape, 1)), F.lower(F.regexp_extract(t, shape, 2)), funding(t)
    paid = money["amount"] != ""
    kind = (
        F.when(verb == "raises", F.when(paid, "funding"))
        .when(verb == "secures", F.when(paid, "funding").otherwise("news"))
        .when(verb == "receives", F.when(paid, "funding").otherwise("award"))
        .when(verb == "launches", "launch")
        .when(verb == "wins", "award")
        .when(verb.isin("acquires", "is acquired by"), "acquisition")
    )
    return F.when(kind.isNotNull() & one_company(name, denied), F.struct(name.alias("name"), kind.alias("signal_type"), money.alias("funding")))


def news_name(name: Column) -> Column:
    """A subject without where it is based, and without what stands before 'startup' or 'scaleup'."""
    name = F.regexp_replace(trimmed(name), r"(?i)^\p{Alpha}[\p{Alpha} \-]{0,40}-based\s+", "")
    for marker in ("startup", "scaleup"):
        name = F.regexp_replace(name, f"(?i)^.* {marker} ", "")
    return trimmed(name)


def named(name: Column) -> Column:
    """Whether each word looks like part of a name: not generic, and with a capital somewhere unless it begins with none."""
    bare = F.transform(F.split(squeezed(name), " "), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    fine = F.forall(bare, lambda w: (w != "") & ~F.lower(w).isin(*GENERIC_WORDS) & (~w.rlike(r"^\p{Ll}") | w.rlike(r"^.+\p{Lu}")))
    return fine & ~name.rlike(rf"(?i)^({'|'.join(GENERIC_PREFIXES)})\b")


def news_event(title: Column, denied: list[str]) -> Column:
    """struct(name, signal_type, funding) of a headline of startup news, under the stricter grammar, or null."""
    t = trimmed(title)
    shape = rf"(?i)^(.+?)\s+({'|'.join(NEWS_VERBS)})\b(.+)$"
    name, verb, tail = news_name(F.regexp_extract(t, shape, 1)), F.lower(F.regexp_extract(t, shape, 2)), trimmed(F.regexp_extract(t, shape, 3))
    money, low = funding(t, named_round=True), F.lower(trimmed(F.regexp_extract(t, shape, 3)))
    backed = (money["amount"] != "") | (money["round"] != "") | tail.rlike(words("funding", "investment", "round"))
    kind = (
        F.when(verb.isin("raises", "secures", "closes"), F.when(backed, "funding"))
        .when(verb.isin("launches", "debuts"), F.when(~tail.rlike(words(*NOT_LAUNCHED)) & tail.rlike(words(*LAUNCHED)), "launch"))
        .when(verb == "enters", F.when(low.contains("market"), "launch"))
        .when(verb == "expands", F.when(low.rlike("(^| )(into|across) "), "launch"))
    )
    several = name.rlike(r"(?i)(\s(?:and|versus|vs\.?)\s|[,/&+])")
    company = one_company(name, denied) & ~several & ~name.rlike(words(*FUNDS)) & ~name.rlike(words("start-?up", "scale-?up")) & ~name.rlike(words(*PEOPLE)) & named(name) & (F.size(F.split(squeezed(name), " ")) <= 8)
    fine = ~t.rlike(begins(*EDITORIAL)) & ~t.rlike(words(*MERGERS)) & kind.isNotNull() & company
    return F.when(fine, F.struct(name.alias("name"), kind.alias("signal_type"), money.alias("funding")))


def show_title(raw: Column) -> Column:
    """struct(name, tagline) of a 'Show HN:' title, split at its first separator, or null."""
    shape = r"^(.*?)( [–—|\-] )(.*)$"

    def halves(rest: Column) -> Column:
        return bound(F.regexp_extract(rest, shape, 2) != "", lambda split: F.struct(
            rest.alias("rest"), split.alias("split"), F.when(split, trimmed(F.regexp_extract(rest, shape, 1))).otherwise(rest).alias("name"), F.when(split, trimmed(F.regexp_extract(rest, shape, 3))).otherwise("").alias("tagline")
        ))

    def sound(h: Column) -> Column:
        name, split = h["name"], h["split"]
        parts = F.split(name, SPACES)
        first = F.lower(F.regexp_replace(F.get(parts, 0), r"^['\"(\[{]+|['\"(\[{]+$", ""))
        fine = F.char_length(name).between(2, 80) & ~name.rlike(r"[<>:!?;\n\r]") & (split | ~name.rlike(r"[,.|/\\]")) & (F.size(parts) <= 5) & ~first.isin(*SHOW_DENIED) & name.rlike(r"\p{L}")
        return F.when((h["rest"] != "") & (~split | (h["tagline"] != "")) & fine, h)

    rest = trimmed(F.regexp_extract(clean_text(raw, 240), r"(?i)^show hn:(.*)$", 1))
    found = bound(rest, lambda r: bound(halves(r), sound))
    # what a UDF is given has no lambda; without a separator there is no third part
    tagline = clean_text(trimmed(F.regexp_extract(rest, shape, 3)), 280)
    return F.when(found.isNotNull(), F.struct(found["name"].alias("name"), tagline.alias("tagline")))
