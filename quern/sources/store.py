"""Relational stores: partitioned reads, upserts by key, catalogue probe, choice of backend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def store_url(url: str) -> str:
    """A driver address for JDBC, whatever dialect suffix the given one carries."""
    u = url.strip()
    scheme, rest = u.split("://", 1) if "://" in u else ("postgresql", u)
    return f"jdbc:{scheme.removeprefix('jdbc:').split('+', 1)[0]}://{rest}"


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table read in ``parts`` ranges of a numeric key (one connection without a key). Filters and columns of the
    plan are pushed into the store by the reader."""
    r = spark.read.format("jdbc").option("url", store_url(url)).option("dbtable", name)
    for k, v in options.items():
        r = r.option(k, v)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def columns_of(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that are there and those that are not."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as nulls of their type; those that are there stay as they are."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def first_backend(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first reader that works and has rows; the last one's result if none has."""
    last: DataFrame | None = None
    error: Exception | None = None
    for r in readers:
        try:
            last = r()
            if not last.isEmpty():
                return last
        except Exception as x:  # an absent driver or store counts as no result
            error = x
    if last is None:
        raise error or ValueError("no reader given")
    return last
