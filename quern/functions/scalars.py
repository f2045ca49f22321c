"""Dates, JSON, maps, conditional values, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """First ten signs as a date written with ``-``, ``.`` or ``/``; else null."""
    s = F.substring(F.btrim(c), 1, 10)
    shape = F.regexp_extract(s, "^(\\d{4})([-./])(\\d{1,2})\\2(\\d{1,2})$", 0)
    return F.when(shape != "", F.try_to_date(F.regexp_replace(shape, "[./]", "-"), "yyyy-M-d"))


def recency(date: Column, as_of: Column, weight: float = 0.4, days: float = 365.0) -> Column:
    """Exponential decay by age; future dates count as today, no date gives 0."""
    return F.coalesce(F.lit(weight) * F.exp(-F.greatest(F.datediff(as_of, date), F.lit(0)) / days), F.lit(0.0))


def to_kst(c: Column) -> Column:
    return c + F.expr("INTERVAL 9 HOURS")


def kst_stamp(c: Column) -> Column:
    return F.concat(F.date_format(to_kst(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def empty_to_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.btrim(c), F.lit("")))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def first_filled(*cs: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cs])


def first_of(c: Column) -> Column:
    return F.get(c, F.lit(0))


def lookup(table: dict[str, str], key: Column, default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def merge_maps(*maps: Column) -> Column:
    """Keys of all maps; the last map wins."""
    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    out = maps[0]
    for m in maps[1:]:
        out = two(out, m)
    return out


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def int_or(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.expr("try_cast(null as int)") if c is None else c.try_cast("int"), F.lit(default))


def texts_only(c: Column) -> Column:
    return F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: x.cast("string"))


def object_or_empty(c: Column) -> Column:
    """JSON object as it is, anything else as an empty object."""
    return F.when(F.coalesce(c, F.lit("")).rlike("^\\s*\\{.*\\}\\s*$") & F.get_json_object(c, "$").isNotNull(), F.get_json_object(c, "$")).otherwise("{}")


def unit_vector(c: Column) -> Column:
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_literal(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
