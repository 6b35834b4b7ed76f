"""Digests as messages: item blocks in HTML, packed into messages of limited size.

The texts are Russian; they and the dictionaries are fixed values of the format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import escape_html, trimmed
from millrace.operators.selection import source_keys

LIMIT = 4096
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
SIGNALS = {"launch": "запуск", "news": "новость", "funding": "финансирование", "acquisition": "приобретение", "award": "награда", "ranking": "рейтинг"}
CATEGORIES = {
    "ai": "ИИ",
    "artificial intelligence": "искусственный интеллект",
    "analytics": "аналитика",
    "biotech": "биотехнологии",
    "climate": "климатические технологии",
    "climate tech": "климатические технологии",
    "consumer": "потребительские продукты",
    "cybersecurity": "кибербезопасность",
    "data": "данные",
    "deep tech": "глубокие технологии",
    "deeptech": "глубокие технологии",
    "developer tools": "инструменты для разработчиков",
    "education": "образование",
    "edtech": "образовательные технологии",
    "energy": "энергетика",
    "enterprise": "корпоративные решения",
    "finance": "финансы",
    "fintech": "финтех",
    "hardware": "аппаратные решения",
    "healthcare": "здравоохранение",
    "healthtech": "медтех",
    "open source": "открытый код",
    "productivity": "продуктивность",
    "robotics": "робототехника",
    "software": "программное обеспечение",
}
REGIONS = {
    "asia": "Азия",
    "eu": "Европа",
    "europe": "Европа",
    "france": "Франция",
    "germany": "Германия",
    "global": "весь мир",
    "india": "Индия",
    "north america": "Северная Америка",
    "uk": "Великобритания",
    "us": "США",
    "usa": "США",
}
ROUNDS = {
    "accelerator": "акселерационная программа",
    "debt": "долговое финансирование",
    "grant": "грант",
    "growth": "раунд роста",
    "pre-seed": "предпосевной раунд",
    "seed": "посевной раунд",
    "series a": "раунд A",
    "series b": "раунд B",
    "series c": "раунд C",
    "series d": "раунд D",
}
REASONS = {
    "launch": "Свежий запуск показывает, что продукт уже представлен рынку.",
    "news": "О компании вышла свежая новость — можно проследить актуальное изменение в её развитии.",
    "acquisition": "Зафиксировано приобретение компании — это существенное событие в развитии проекта.",
    "award": "Компания получила награду — это внешний сигнал признания проекта.",
    "ranking": "Компания вошла в отраслевой рейтинг — это внешний сигнал заметности проекта.",
}
EMPTY = "Подходящих стартапов за этот день не найдено."


#: How what an item says is put into a text: as it is, or escaped. The format's own words have nothing to escape.
Put = Callable[[Column], Column]


def as_is(value: Column) -> Column:
    return value


def term(value: Column, terms: dict[str, str], put: Put = as_is) -> Column:
    """The translation of a trimmed term, or the term."""
    known = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(value)), put(value))


def translated(value: Column, terms: dict[str, str], put: Put = as_is) -> Column:
    """The term's translation, or the value as it is, trimmed."""
    return term(trimmed(value), terms, put)


def round_name(value: Column, put: Put = as_is) -> Column:
    letter = F.regexp_extract(F.lower(trimmed(value)), r"^series\s+([a-z])$", 1)
    return F.when(F.lower(trimmed(value)).isin(*ROUNDS) | (letter == ""), translated(value, ROUNDS, put)).otherwise(F.concat(F.lit("раунд "), F.upper(letter)))


def category_names(values: Column, put: Put = as_is) -> Column:
    return F.array_join(F.transform(values, lambda c: translated(c, CATEGORIES, put)), ", ")


def optional(condition: Column, *parts: Column | str) -> Column:
    """The parts joined, or null."""
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


#: Steps from an item to its texts: each is columns made of those before it, which a table works out once an item however
#: often later ones use them.
Step = Callable[[dict[str, Column]], dict[str, Column]]


def fields(c: dict[str, Column]) -> dict[str, Column]:
    """Of an item `i`: its texts without the white space around."""
    i, f = c["i"], c["i"]["funding"]
    return {"own": trimmed(i["description"]), "kind": trimmed(i["signal_type"]), "area": trimmed(i["region"]), "round": trimmed(f["round"]), "amount": trimmed(f["amount"]), "currency": trimmed(f["currency"])}


def words(put: Put) -> Step:
    """What an item says, in the words of the format; null where there is nothing to say."""

    def step(c: dict[str, Column]) -> dict[str, Column]:
        i, f = c["i"], c["i"]["funding"]
        return {
            "says_kind": term(c["kind"], SIGNALS, put),
            "says_area": term(c["area"], REGIONS, put),
            "says_fields": F.when(F.size(i["categories"]) > 0, category_names(i["categories"], put)),
            "says_round": F.when(f["round"] != "", round_name(f["round"], put)),
            "says_investors": F.when(F.size(f["investors"]) > 0, put(F.array_join(f["investors"], ", "))),
            "says_sources": F.size(source_keys(i["sources"])),
        }

    return step


def facts(put: Put) -> Step:
    def step(c: dict[str, Column]) -> dict[str, Column]:
        amount = F.when(c["amount"] != "", F.concat_ws(" ", put(c["amount"]), F.when(c["currency"] != "", put(c["currency"]))))
        return {
            "about": F.concat_ws("; ", F.concat(F.lit("сфера — "), c["says_fields"]), optional(c["area"] != "", "регион — ", c["says_area"])),
            # white space is a round in details(), but none here
            "funded": F.concat_ws(", ", F.when(c["round"] != "", c["says_round"]), amount, F.concat(F.lit("инвесторы: "), c["says_investors"])),
        }

    return step


def sentences(put: Put) -> Step:
    """description: the item's own text, or one made of what is known; empty where nothing is. why: why it is interesting."""

    def step(c: dict[str, Column]) -> dict[str, Column]:
        reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
        kind = F.coalesce(optional(c["kind"] != "", "Стартап с актуальным сигналом: ", c["says_kind"], "."), F.lit(""))
        made = F.when(c["about"] != "", F.concat(F.lit("Стартап: "), c["about"], F.lit("."))).otherwise(kind)
        has_funding = (c["round"] != "") | (c["amount"] != "") | (c["currency"] != "") | c["says_investors"].isNotNull()
        funding = F.when(c["funded"] == "", "Зафиксирован новый раунд финансирования — у компании появились ресурсы для следующего этапа развития.").otherwise(
            F.concat(F.lit("Компания привлекла финансирование ("), c["funded"], F.lit(") — это ресурс для следующего этапа развития."))
        )
        return {
            "description": F.when(c["own"] != "", put(c["own"])).otherwise(made),
            "why": F.concat_ws(
                " ",
                F.element_at(reasons, F.lower(c["kind"])),
                F.when((F.lower(c["kind"]) == "funding") | has_funding, funding),
                F.concat(F.lit("Фокус проекта: "), c["says_fields"], F.lit(".")),
                optional(c["area"] != "", "Регион проекта: ", c["says_area"], "."),
                optional(c["says_sources"] > 1, "Сигнал отмечен в ", c["says_sources"].cast("string"), " независимых источниках."),
            ),
        }

    return step


def money(c: dict[str, Column]) -> dict[str, Column]:
    f = c["i"]["funding"]
    amount = F.concat_ws(" ", escape_html(f["amount"]), F.when(f["currency"] != "", escape_html(f["currency"])))
    return {"money": F.concat_ws(", ", c["says_round"], F.when(f["amount"] != "", amount))}


def details(c: dict[str, Column]) -> dict[str, Column]:
    i = c["i"]
    return {
        "details": F.concat_ws(
            "\n",
            optional(i["signal_type"] != "", "📣 Сигнал: ", c["says_kind"]),
            optional(i["region"] != "", "🌍 Регион: ", c["says_area"]),
            F.concat(F.lit("🏷 Категории: "), c["says_fields"]),
            optional(c["money"] != "", "💰 Финансирование: ", c["money"]),
            F.concat(F.lit("👥 Инвесторы: "), c["says_investors"]),
        )
    }


def attribution(sources: Column, approved: dict[str, dict[str, str]] | None = None) -> Column:
    """Links to the sources; those with an agreement (display_name, terms_url, label, notice) show its terms too."""
    approved = approved or {}

    def one(s: Column) -> Column:
        label, terms = s["source_id"], F.lit(None).cast("string")
        for source, a in approved.items():
            label = F.when(s["source_id"] == source, a["display_name"]).otherwise(label)
            link = F.concat(F.lit('<a href="'), escape_html(F.lit(a["terms_url"])), F.lit('">'), escape_html(F.lit(a["label"])), F.lit("</a> · "), escape_html(F.lit(a["notice"])))
            terms = F.when(s["source_id"] == source, link).otherwise(terms)
        shown = F.when(s["source_url"] == "", escape_html(label)).otherwise(F.concat(F.lit('<a href="'), escape_html(s["source_url"]), F.lit('">'), escape_html(label), F.lit("</a>")))
        return F.concat_ws(", ", shown, terms)

    return optional(F.size(sources) > 0, "🔗 Источники: ", F.array_join(F.transform(sources, one), ", "))


def with_blocks(items: DataFrame, approved: dict | None = None) -> DataFrame:
    """items with `block`: their `i` (place, startup_name, description, signal_type, region, categories, funding, sources) in
    HTML, null where `i` is."""
    rows = items.select(F.struct(*items.columns).alias("row"), F.col("i"))
    there = {"i": F.col("i")}
    for step in (fields, words(escape_html), facts(escape_html), sentences(escape_html), money, details):
        more = step(there)
        rows = rows.withColumns(more)
        there |= {c: F.col(c) for c in more}
    i, c = there["i"], there
    shown = F.concat_ws(
        "\n",
        F.concat(i["place"].cast("string"), F.lit(". <b>"), escape_html(i["startup_name"]), F.lit("</b>")),
        optional(c["description"] != "", "📝 <b>Описание:</b> ", c["description"]),
        optional(c["why"] != "", "💡 <b>Почему интересно:</b> ", c["why"]),
        F.when(c["details"] != "", c["details"]),
        attribution(i["sources"], approved),
    )
    return rows.select("row.*", F.when(i.isNotNull(), shown).alias("block"))


def truncated(value: Column, limit: Column) -> Column:
    """Escaped text of at most `limit` bytes, cut between characters, with an ellipsis where it was cut."""
    shown = escape_html(value)
    cut = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda s, c: F.struct(
            F.when(s["full"] | (F.octet_length(s["text"]) + F.octet_length(escape_html(c)) > limit - 3), s["text"]).otherwise(F.concat(s["text"], escape_html(c))).alias("text"),
            (s["full"] | (F.octet_length(s["text"]) + F.octet_length(escape_html(c)) > limit - 3)).alias("full"),
        ),
    )["text"]
    return F.when(F.octet_length(shown) <= limit, shown).when(limit < 3, F.repeat(F.lit("."), F.greatest(limit, F.lit(0)))).otherwise(F.concat(cut, F.lit("…")))


def oversized(i: Column, limit: Column) -> Column:
    c = {"i": i}
    for step in (fields, words(as_is), facts(as_is), sentences(as_is)):
        c |= step(c)
    plain = F.concat_ws("\n", F.concat(i["place"].cast("string"), F.lit(". "), i["startup_name"]), optional(c["why"] != "", "Почему интересно: ", c["why"]), optional(c["description"] != "", "Описание: ", c["description"]))
    return truncated(plain, limit)


def day_of(date: Column) -> Column:
    return F.try_to_date(trimmed(date), "yyyy-MM-dd")


def metadata(day: Column, date: Column, zone: Column) -> Column:
    """'8 января 2024 · Europe/Berlin'; a date that is none, whose day is null, is shown as it is."""
    long = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1), F.lit(" "), F.year(day).cast("string"))
    shown = F.coalesce(F.when(day.isNotNull(), long), trimmed(date))
    return F.concat_ws(" · ", F.nullif(shown, F.lit("")), F.nullif(trimmed(zone), F.lit("")))


def header(known: Column) -> Column:
    return F.concat(F.lit("🚀 <b>Стартапы дня</b>"), F.coalesce(optional(known != "", "\n<i>", escape_html(known), "</i>"), F.lit("")))


def plain_header(known: Column) -> Column:
    """The header without markup, which may be cut."""
    return F.concat_ws("\n", F.lit("🚀 Стартапы дня"), F.nullif(known, F.lit("")))


def messages(digests: DataFrame, limit: int = LIMIT, approved: dict | None = None) -> DataFrame:
    """digests (any key columns, digest_date, timezone, items: array in order of place) as (keys, sequence, text).

    Every message begins with the header; blocks are put in as long as the message stays within `limit` bytes. A block
    that is too long alone is shortened; a digest without items says so. A header, and what an empty digest says, that is
    over the limit goes without markup and is cut.
    """
    keys = [c for c in digests.columns if c not in ("digest_date", "timezone", "items")]
    plain = plain_header(F.col("known"))
    fitting = lambda text, bare: F.when(F.octet_length(text) <= limit, text).otherwise(truncated(bare, F.lit(limit)))
    rows = digests.withColumn("day", day_of(F.col("digest_date"))).withColumn("known", metadata(F.col("day"), F.col("digest_date"), F.col("timezone")))
    rows = rows.withColumn("full", header(F.col("known"))).select(*keys, "known", fitting(F.col("full"), plain).alias("head"), "items")
    room = F.lit(limit) - F.octet_length("head") - 2
    # one row an item: blocks are built once each, and joined again in order of place
    blocks = with_blocks(rows.select(*keys, "known", "head", F.explode_outer("items").alias("i")), approved)
    blocks = blocks.withColumn("block", F.when(F.octet_length("block") > room, oversized(F.col("i"), room)).otherwise(F.col("block")))
    rows = blocks.groupBy(*keys, "known", "head").agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct(F.col("i.place").alias("place"), F.col("block").alias("block"))))).alias("blocks"))
    packed = F.aggregate(
        "blocks",
        F.struct(F.array().cast("array<string>").alias("done"), F.col("head").alias("now")),
        lambda s, b: F.when(
            (F.octet_length(s["now"]) + 2 + F.octet_length(b["block"]) > limit) & (s["now"] != F.col("head")),
            F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.concat(F.col("head"), F.lit("\n\n"), b["block"]).alias("now")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit("\n\n"), b["block"]).alias("now"))),
        lambda s: F.concat(s["done"], F.array(s["now"])),
    )
    texts = F.when(F.size("blocks") == 0, F.array(fitting(F.concat(F.col("head"), F.lit(f"\n\n{EMPTY}")), F.concat(plain, F.lit(f"\n\n{EMPTY}"))))).when(room <= 0, F.array(F.col("head"))).otherwise(packed)
    return rows.select(*keys, F.posexplode(texts).alias("at", "text")).select(*keys, (F.col("at") + 1).alias("sequence"), "text")
