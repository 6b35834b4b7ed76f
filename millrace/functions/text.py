"""Text and name functions over columns. Missing text is the empty string."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.session import shipped

#: Unicode white space for Java's expressions, whose \s is ASCII.
SPACES = r"[\s\u0085\p{Z}]+"
#: The characters of that white space one by one.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BIDI = r"[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"

# Words that end a company's name, and names that are too general to identify one.
LEGAL_SUFFIXES = ("company", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "llc", "ltd", "plc")
GENERIC_ALIASES = ("app", "bank", "company", "digital", "global", "group", "labs", "solutions", "systems", "tech", "ventures")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row however often it is used. No Python UDF may be in use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column | str) -> Column:
    """Without the white space of any script at its ends, which plain trim leaves but for spaces."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(WHITE))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, SPACES, " "))


# Texts are long, and each is decoded by itself: these take rows a hundred at a time, where Arrow has ten thousand in memory.
@shipped
@F.udf(StringType(), useArrow=False)
def unescape_all(text: str | None) -> str | None:
    """All HTML entities; for text that has others than the common five."""
    return None if text is None else html.unescape(text)


@shipped
@F.udf(ArrayType(StringType()), useArrow=False)
def unescape_each(values: list[str | None] | None) -> list[str | None] | None:
    return None if values is None else [None if x is None else html.unescape(x) for x in values]


#: An entity with its semicolon, or & by its old name without one.
CLOSED_ENTITY = re.compile(r"&(?:amp;?|#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))")


@shipped
@F.udf(StringType(), useArrow=False)
def unescape_closed(text: str | None) -> str | None:
    """HTML entities as they are when they end in a semicolon; of those without one, & alone."""
    return None if text is None else CLOSED_ENTITY.sub(lambda e: html5.get(e[1], e[0]) if e[1] else html.unescape(e[0]), text)


def unescape_common(text: Column) -> Column:
    """The five entities of XML, without leaving the JVM."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


#: The beginning of an entity that is not one of the common five; old names need no semicolon.
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|amp|#39);)[#A-Za-z]"


def unescaped(text: Column, closed: bool = False) -> Column:
    """All HTML entities: the common five natively, text with others goes to a Python UDF. With `closed`, an old name without
    its semicolon, as where a text was cut in an entity, is text, but for that of &."""
    other = text.rlike(OTHER_ENTITY)
    return F.when(other, (unescape_closed if closed else unescape_all)(F.when(other, text))).otherwise(unescape_common(text))


def escape_html(text: Column) -> Column:
    """Markup as text. Characters are looked for one by one, which takes long; where text is a column, one look finds the few
    texts that have any."""
    some = text
    for plain, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        some = F.replace(some, F.lit(plain), F.lit(entity))
    return F.when(text.rlike("[&'<>\"]"), some).otherwise(text)


def without_markup(text: Column, limit: int | None = None) -> Column:
    """Unescaped text without script and style blocks, tags, stray brackets, control and direction characters, and runs
    of white space; at most `limit` code points."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = squeezed(F.regexp_replace(text, rf"[<>\p{{Cc}}]|{BIDI}", " "))
    return text if limit is None else F.substring(text, 1, limit)


def clean_text(text: Column, limit: int | None = None, closed: bool = False) -> Column:
    """Plain text of feed markup: entities (with `closed`, those that unescaped() takes then), then all that without_markup()
    takes out; at most `limit` code points."""
    return without_markup(unescaped(F.coalesce(text, F.lit("")), closed), limit)


def clean_strings(values: Column, most: int, limit: int) -> Column:
    """The first `most` values, cleaned; those that are empty then go."""
    values = F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, most)
    # a UDF cannot be called for each value inside transform
    other = F.exists(values, lambda v: v.rlike(OTHER_ENTITY))
    plain = F.when(other, unescape_each(F.when(other, values))).otherwise(F.transform(values, unescape_common))
    return F.filter(F.transform(plain, lambda v: without_markup(v, limit)), lambda v: v != "")


def without_suffix(token: Column) -> Column:
    return F.regexp_replace(token, f"-({'|'.join(LEGAL_SUFFIXES)})$", "")


def name_token(name: Column, strip_suffix: bool = False) -> Column:
    """Lower case letters and digits, anything between as one dash; without a legal suffix unless it is the whole name."""
    token = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{Nd}]+", "-"), "^-|-$", "")
    return without_suffix(token) if strip_suffix else token


def plain_token(text: Column) -> Column:
    return F.lower(F.replace(squeezed(text), F.lit(" "), F.lit("-")))


def alias_eligible(token: Column) -> Column:
    """Whether a name token is long and special enough to identify."""
    return (F.char_length(F.replace(token, F.lit("-"), F.lit(""))) >= 4) & ~token.isin(*GENERIC_ALIASES)


def valid_name(name: Column) -> Column:
    return F.char_length(name).between(2, 120) & ~name.rlike(r"[\p{Cc}\p{Cf}]")


def canonical_list(values: Column) -> Column:
    """Trimmed, without empties and repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: trimmed(v)), lambda v: v != "")))


def append_once(messages: Column, message: Column) -> Column:
    """Adds a message to a list joined by '; ' unless it is there."""
    parts = F.filter(F.concat(F.split(F.coalesce(messages, F.lit("")), "; "), F.array(F.coalesce(message, F.lit("")))), lambda m: m != "")
    return F.array_join(F.array_distinct(parts), "; ")


def redact(text: Column, secrets: list[str]) -> Column:
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[redacted]"))
    return text


# Kinds of feed failures that may be shown. All others are shown as the first.
FAILURE_KINDS = ("network", "timeout", "redirect_policy", "http_status", "content_type", "response_size", "too_many_items", "invalid_xml", "unsupported_xml", "invalid_json")


def shown_failure(kind: Column) -> Column:
    return F.when(kind.isin(*FAILURE_KINDS), kind).otherwise(FAILURE_KINDS[0])
