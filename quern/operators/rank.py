"""Reranking by several signals, selection of distinct documents, context and extractive answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import recency
from quern.functions.text import context_sentences, distinct_tokens, strip


def coverage(expected: Column, actual: Column) -> Column:
    """Share of the distinct expected tokens that are there; 0 if either side is empty."""
    return F.when((F.size(expected) > 0) & (F.size(actual) > 0), F.size(F.array_intersect(expected, actual)) / F.size(expected)).otherwise(0.0)


def rerank(hits: DataFrame, as_of: Column, query: str = "query", keywords: str = "keywords", expected: str = "expected_values") -> DataFrame:
    """Adds the six signals and ``rerank_score``.

    ``hits``: query_id, score, rank, title, content, published_on (date), category, source_type, department and per
    row the query text, its keyword list and the list of expected category values."""
    w = Window.partitionBy("query_id")
    key = F.array_distinct(F.concat(F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), lambda k: F.lower(F.btrim(k))), distinct_tokens(F.col(query))))
    title, content = distinct_tokens(F.coalesce("title", F.lit(""))), distinct_tokens(F.coalesce("content", F.lit("")))
    q = F.lower(F.btrim(F.col(query)))
    full = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    cands = F.array_remove(F.array_distinct(F.transform(F.array("category", "source_type", "department"), lambda c: F.lower(F.btrim(F.coalesce(c, F.lit("")))))), "")
    wanted = F.filter(F.transform(F.coalesce(F.col(expected), F.array().cast("array<string>")), lambda e: F.lower(F.btrim(e))), lambda e: e != "")
    top = F.max("score").over(w)
    out = hits.withColumns({
        "base_score": F.round(F.when(top > 0, F.least(F.col("score") / top, F.lit(1.0)) * 3.0).otherwise(0.0), 6),
        "title_match": F.round(coverage(key, title) * 1.8, 6),
        "content_match": F.round(coverage(key, content) * 1.0, 6),
        "exact_query_match": F.when((q != "") & F.contains(full, q), 0.8).otherwise(0.0),
        "category_match": F.when(F.exists(wanted, lambda e: F.exists(cands, lambda c: F.contains(c, e))), 0.7).otherwise(0.0),
        "recency": F.round(recency(F.col("published_on"), as_of), 6),
    })
    total = sum((F.col(c) for c in ("title_match", "content_match", "exact_query_match", "category_match", "recency")), F.col("base_score"))
    out = out.withColumn("rerank_score", F.round(total, 6))
    return out.withColumn("rerank", F.row_number().over(w.orderBy(F.desc("rerank_score"), "rank")))


def select_distinct(ranked: DataFrame, doc: str, order: str, k: int = 3) -> DataFrame:
    """First ``k`` documents of each query, each by its best row."""
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", doc).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).where(F.col("position") <= k)


def context(selected: DataFrame, title: str, source: str, date: str, content: str) -> DataFrame:
    """``query_id, context``: numbered blocks in order, joined by an empty line."""
    fill = lambda c: F.coalesce(F.nullif(F.btrim(F.col(c).cast("string")), F.lit("")), F.lit("-"))
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), fill(title), F.lit("\n("), fill(source), F.lit(", "), fill(date), F.lit(")\n"), F.coalesce(F.col(content), F.lit("")))
    return (selected.withColumn("_b", F.struct("position", block.alias("block"))).groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["block"]), "\n\n").alias("context")))


def extractive_answer(rows: DataFrame, key: str, query: str, text: str, n: int = 4) -> DataFrame:
    """``key, position, sentence, overlap``: the ``n`` sentences of the content lines that share most query terms, longer ones first."""
    ask = distinct_tokens(F.col(query))
    each = rows.select(F.col(key), ask.alias("_q"), F.posexplode(context_sentences(F.col(text))).alias("pos", "sentence"))
    each = each.withColumn("overlap", F.size(F.array_intersect("_q", distinct_tokens(F.col("sentence"))))).where("overlap > 0")
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), F.desc(F.length("sentence")), "pos")
    return each.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(key, "position", strip(F.col("sentence")).alias("sentence"), "overlap")
