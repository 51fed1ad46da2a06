"""Dates, keys, bit masks, prices, percentiles and vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import normal, stripped

# Dollars for a million tokens (input, output), in order of matching, and for any other model.
PRICES = (
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini-2024-07-18", 0.15, 0.60),
    ("gpt-4o-2024-08-06", 2.50, 10.00),
)
DEFAULT_PRICE = (0.15, 0.60)


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD, YYYYMMDD and YYYY.MM.DD as YYYY-MM-DD without validation; else null."""
    c = stripped(c)
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
        .when(c.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))
        .when(c.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.replace(c, F.lit("."), F.lit("-")))
    )


def iso_range(c: Column) -> Column:
    """struct(start, end) of a text cut at ``~`` or ``-``; a range of ISO dates has too many parts and gives nulls."""
    parts = F.split(c, r"\s*[~\-]\s*", -1)
    two = F.size(parts) == 2
    return F.struct(F.when(two | (F.size(parts) == 1), iso_date(F.get(parts, F.lit(0)))).alias("start"), F.when(two, iso_date(F.get(parts, F.lit(1)))).alias("end"))


def valid_date(c: Column) -> Column:
    """The first of three formats that gives a real date."""
    return F.coalesce(*[F.try_to_date(stripped(c), f) for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy.MM.dd")])


def eight_digits(c: Column) -> Column:
    return F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def dotted_date(c: Column) -> Column:
    """2024.1.5. as 2024-01-05."""
    parts = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(parts) >= 3, F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0")))


def age(birth: Column, today: Column) -> Column:
    """Full years: the difference of the years, one less before the birthday."""
    before = (F.month(today) * 100 + F.day(today)) < (F.month(birth) * 100 + F.day(birth))
    return F.year(today) - F.year(birth) - before.cast("int")


def days_left(deadline: Column, now: Column) -> Column:
    return F.ceil((F.unix_timestamp(deadline) - F.unix_timestamp(now)) / 86400).cast("long")


def urgency(deadline: Column, now: Column) -> Column:
    """``D-3`` up to three days before the deadline, ``D-7`` up to seven; null after it or earlier."""
    left = F.unix_timestamp(deadline) - F.unix_timestamp(now)
    return F.when(left <= 0, None).when(left <= 3 * 86400, "D-3").when(left <= 7 * 86400, "D-7")


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: Sequence[tuple[str, float, float]] = PRICES) -> Column:
    rate_in = rate_out = None
    for name, a, b in prices:
        hit = F.contains(model, F.lit(name))
        rate_in = F.when(hit, F.lit(a)) if rate_in is None else rate_in.when(hit, F.lit(a))
        rate_out = F.when(hit, F.lit(b)) if rate_out is None else rate_out.when(hit, F.lit(b))
    return tokens_in / 1e6 * rate_in.otherwise(DEFAULT_PRICE[0]) + tokens_out / 1e6 * rate_out.otherwise(DEFAULT_PRICE[1])


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at index int(n * p / 100) of the sorted array, the last one at most."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(n - 1, F.floor(n * percent / 100).cast("int")))


def document_key(source: Column, title: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(title, F.lit("")), F.substring(stripped(F.coalesce(content, F.lit(""))), 1, 1000)), 256)


def content_key(content: Column, length: int = 500) -> Column:
    return F.md5(F.substring(content, 1, length).cast("binary"))


def cache_key(query: Column, domain: Column | None = None) -> Column:
    text = normal(query)
    return F.sha2(text if domain is None else F.when(domain.isNull() | (domain == ""), text).otherwise(F.concat_ws(":", domain, text)), 256)


def short_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.lower(F.concat_ws("|", *parts)).cast("binary")), 1, 12)


def decode_bits(value: Column, names: Sequence[str]) -> Column:
    """struct of booleans by bit; null or a negative number means all on."""
    full = (1 << len(names)) - 1
    held = F.when(value.isNull() | (value < 0), F.lit(full)).otherwise(value.cast("long").bitwiseAND(full))
    return F.struct(*[(held.bitwiseAND(1 << i) != 0).alias(n) for i, n in enumerate(names)])


def encode_bits(flags: Sequence[Column]) -> Column:
    """The mask of the flags; a missing flag counts as on."""
    return sum((F.when(F.coalesce(f, F.lit(True)), F.lit(1 << i)).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def json_in_text(c: Column) -> Column:
    """A fenced block, else the whole text, else its first braces; null unless it is JSON."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (fenced, c, braces)])


def listed(c: Column, least: int = 5) -> Column:
    """Numbered or bulleted lines without their marks, ``least`` characters or more."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: stripped(F.regexp_replace(stripped(x), r"^(?:\d+[.)]|[-*•])\s*", "")))
    return F.filter(lines, lambda x: F.length(x) >= least)


def sorted_map_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def harmonic_mean(*values: Column) -> Column:
    zero = F.lit(False)
    for v in values:
        zero = zero | (v == 0)
    return F.when(zero, 0.0).otherwise(len(values) / sum((1 / v for v in values[1:]), 1 / values[0]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def conversation_key(query: Column, history: Column, last: int = 8, length: int = 200) -> Column:
    """The query with ten digits that stand for the last messages (role, content); the query alone without any."""
    part = F.slice(history, F.greatest(F.size(history) - last + 1, F.lit(1)), last)
    cut = F.transform(part, lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.substring(F.coalesce(m["content"], F.lit("")), 1, length).alias("content")))
    digest = F.substring(F.md5(F.to_json(cut).cast("binary")), 1, 10)
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.concat(query, F.lit("\n#h:"), digest)).otherwise(query)


def has_keys(json: Column, keys: Sequence[str]) -> Column:
    """Whether an object has all keys, whatever their values, null included."""
    return F.coalesce(F.size(F.array_intersect(F.json_object_keys(json), F.array(*[F.lit(k) for k in keys]))) == len(set(keys)), F.lit(False))


def licences_text(licences: Column) -> Column:
    """One line for each (type, required, condition, authority); a missing condition is left out."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    line = lambda x: F.concat_ws(
        ", ",
        F.concat(F.lit("type: "), empty(x["type"])),
        F.concat(F.lit("required: "), F.coalesce(x["required"], F.lit(False)).cast("string")),
        F.concat(F.lit("condition: "), x["condition"]),
        F.concat(F.lit("authority: "), empty(x["authority"])),
    )
    return F.array_join(F.transform(F.coalesce(licences, F.array().cast("array<struct<type:string,required:boolean,condition:string,authority:string>>")), line), "\n ")
