"""Questions to answers in one plan, with the records a service keeps of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import first_filled, first_of
from quern.functions.text import strip
from quern.operators.retrieve import fallback_triggers


def ordered_distinct(*lists: Column) -> Column:
    """Non-empty values of all lists, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda v: v != ""))


def build_request(df: DataFrame, original: str = "question", normalized: str = "normalized_query", rewritten: str = "rewritten_queries", keywords: str = "keywords",
                  filters: str = "filters", category: str = "category", top_k: int = 10) -> DataFrame:
    """Adds query, query_variants, keyword_list, request_category, top_k and triggers of the retrieval request."""
    last = F.get(F.col(rewritten), F.size(rewritten) - 1)
    variants = ordered_distinct(F.col(rewritten), F.array(last, F.col(normalized), F.col(original)))
    return (df.withColumn("query_variants", variants).withColumn("query", F.coalesce(first_of(F.col("query_variants")), F.col(original)))
            .withColumns({"keyword_list": ordered_distinct(F.col(keywords)), "request_category": first_filled(F.col(category), first_of(F.element_at(F.col(filters), "category"))),
                          "top_k": F.lit(top_k), "triggers": fallback_triggers(F.col("query"), F.col(keywords), F.map_keys(F.col(filters)))}))


def strategy_record(query: str = "query", variants: str = "query_variants", keywords: str = "keyword_list", filters: str = "filters", strategy: str = "lexical") -> Column:
    """What was asked for, as one struct, with the filter rules that took effect."""
    rules = F.transform(F.filter(F.map_keys(F.col(filters)), lambda k: F.size(F.element_at(F.col(filters), k)) > 0), lambda k: F.concat(k, F.lit("_filter")))
    return F.struct(F.lit(strategy).alias("strategy"), F.col(query).alias("query"), F.size(variants).alias("query_variant_count"), F.col(keywords).alias("keywords"),
                    F.array_sort(rules).alias("filter_rules_applied"))


def prompt(query: Column, context: Column, instruction: str) -> Column:
    """Instruction, question and documents under bracketed headers, with an open answer."""
    return F.concat(F.lit(instruction + "\n\n[QUESTION]\n"), strip(query), F.lit("\n\n[DOCUMENTS]\n"), F.coalesce(F.nullif(strip(context), F.lit("")), F.lit("-")), F.lit("\n\n[ANSWER]\n"))


def answer_record(answers: DataFrame, requests: DataFrame, fallback: str = "no matching document") -> DataFrame:
    """``query_id, answer, success, sentences``: sentences joined; questions without any get the fallback."""
    joined = answers.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "sentence"))), lambda x: x["sentence"]), " ").alias("a"), F.count(F.lit(1)).alias("sentences"))
    return (requests.select("query_id").join(joined, "query_id", "left")
            .select("query_id", F.coalesce("a", F.lit(fallback)).alias("answer"), F.col("a").isNotNull().alias("success"), F.coalesce("sentences", F.lit(0)).alias("sentences")))


def log_rows(requests: DataFrame, answers: DataFrame, selected: DataFrame) -> DataFrame:
    """One log row a question: forms, counts, chosen chunks, answer."""
    chosen = selected.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"]).alias("selected_chunk_ids"))
    return (requests.join(chosen, "query_id", "left").join(answers, "query_id", "left")
            .withColumns({"selected_count": F.greatest(F.size("selected_chunk_ids"), F.lit(0)), "request_id": F.sha1(F.concat_ws(":", F.lit("request"), F.col("query_id").cast("string")))}))


def value_after_label(lines: Column, labels: list[str], stops: list[str]) -> Column:
    """Next non-empty line after a label line, unless it is a stop label itself."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    nxt = F.get(full, F.array_position(F.transform(full, lambda x: x.isin(*labels)), True).cast("int"))
    return F.when(F.exists(full, lambda x: x.isin(*labels)) & ~nxt.isin(*stops, *labels), nxt)
