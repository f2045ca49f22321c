"""Sinks: partitioned tables, append-only logs, reports, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import kst_stamp
from quern.functions.text import preview


def write_partitions(df: DataFrame, path: str, by: str = "source_type", format: str = "parquet") -> None:
    """Overwrites only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(format).save(path)


def write_chunk_sets(chunks: DataFrame, path: str, key: str = "doc_id", order: str = "chunk_index", by: str = "source_type") -> None:
    """One JSON array a document, a line each, in folders by kind: what ``files.json_records`` reads with ``lines``.
    A document's chunks are as many as its text has pieces, so an array is no larger than its document."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*[F.col(c).cast("string") if t.startswith("timestamp") else F.col(c) for c, t in chunks.dtypes]).alias("r"))
    sets = chunks.groupBy(key, by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])).alias("value"))
    sets.select("value", by).write.mode("overwrite").partitionBy(by).text(path)


def append_log(df: DataFrame, path: str, stamp: Column | None = None) -> None:
    """Appends JSON lines, with a time stamp of the given time if there is one."""
    (df.withColumn("logged_at", kst_stamp(stamp)) if stamp is not None else df).write.mode("append").json(path)


def page_manifest(items: DataFrame, *keys: str) -> DataFrame:
    """One row a page with its count and its items in order of ``pos``."""
    rest = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("items"))


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and faulty ones with their message."""
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def report(df: DataFrame, answer: str = "answer", size: int = 120) -> DataFrame:
    """Flat form for CSV: nested values as JSON, the answer cut."""
    cols = []
    for f in df.schema:
        nested = f.dataType.typeName() in ("array", "map", "struct")
        c = F.to_json(f.name).alias(f.name) if nested else F.col(f.name)
        cols.append(preview(F.col(answer), size).alias(answer) if f.name == answer else c)
    return df.select(*cols)


def write_report(df: DataFrame, path: str) -> None:
    report(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def channel_response(text: Column, title: Column, description: Column, replies: Column) -> Column:
    """JSON of a chat channel's card: text of at most 500 signs, title 50, description 300, three quick replies."""
    fill = lambda c, n, d: F.substring(F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit(d)), 1, n)
    return F.to_json(F.struct(fill(text, 500, "-").alias("text"), fill(title, 50, "-").alias("title"), fill(description, 300, "-").alias("description"),
                              F.slice(F.coalesce(replies, F.array().cast("array<string>")), 1, 3).alias("quick_replies")))
