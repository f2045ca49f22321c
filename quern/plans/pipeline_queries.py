"""Requests, prompts, answers and logs of a batch of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import pipeline, rank
from quern.operators import understand as u
from quern.plans import log_queries as d
from quern.plans.retrieval_queries import _SELECT, _selected
from quern.plans.tables import table

QUERIES, SQL = {}, {}
INSTRUCTION = "Answer from the documents only."


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _requests(spark, sf_dir):
    q = table(spark, sf_dir, "query_logs").select(F.col("id").alias("query_id"), "question")
    return pipeline.build_request(u.understand(q, "question", synonyms=d.SYNONYMS, terms=d.DOMAIN, stopwords=d.STOP, groups=d.GROUPS, expansions=d.EXPANSIONS, hints=d.HINTS))


@query()
def request_build(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("query_id", "query", "query_variants", "keyword_list", "request_category", "top_k", "triggers", F.to_json(pipeline.strategy_record()).alias("record"))


@query(f"""WITH {_SELECT},
c AS (SELECT query_id, any_value(q) AS q, string_agg('[' || position || '] ' || coalesce(nullif(trim(title), ''), '-') || chr(10) || '(' || coalesce(nullif(trim(coalesce(nullif(source_url, ''), source_type)), ''), '-') || ', '
  || coalesce(strftime(published_at::DATE, '%Y-%m-%d'), '-') || ')' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY position) AS context FROM sel WHERE position <= 3 GROUP BY query_id)
SELECT query_id, sha1('{INSTRUCTION}' || chr(10) || chr(10) || '[QUESTION]' || chr(10) || trim(q) || chr(10) || chr(10) || '[DOCUMENTS]' || chr(10)
  || regexp_replace(context, '^[\\s\\x{{00A0}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{3000}}]+$', '', 'g') || chr(10) || chr(10) || '[ANSWER]' || chr(10)) AS prompt_hash FROM c""")
def prompt_build(spark, sf_dir):
    ctx = rank.context(_selected(spark, sf_dir), "title", "source", "published_on", "content")
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "question")
    return ctx.join(asked, "query_id").select("query_id", F.sha1(pipeline.prompt(F.col("question"), F.col("context"), INSTRUCTION)).alias("prompt_hash"))


@query()
def question_log(spark, sf_dir):
    """Questions, chosen chunks and answers as log rows."""
    sel = _selected(spark, sf_dir)
    req = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "question")
    rows = sel.groupBy("query_id", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n").alias("text"))
    answers = pipeline.answer_record(rank.extractive_answer(rows, "query_id", "query", "text"), req)
    return pipeline.log_rows(req, answers, sel)


_FULL = "list_filter(list_transform(string_split(coalesce(raw_text, ''), chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g')), lambda x: x <> '')"


@query(f"""WITH l AS (SELECT doc_id, {_FULL} AS ls FROM documents), n AS (SELECT doc_id, ls[list_position(list_transform(ls, lambda x: x IN ('붙임', '문의', 'Notes')), true) + 1] AS v, list_position(list_transform(ls, lambda x: x IN ('붙임', '문의', 'Notes')), true) AS place FROM l)
SELECT doc_id, CASE WHEN place > 0 AND v NOT IN ('끝.', 'End.', '붙임', '문의', 'Notes') THEN v END AS value FROM n""")
def label_values(spark, sf_dir):
    v = pipeline.value_after_label(F.split(F.coalesce("raw_text", F.lit("")), "\n"), ["붙임", "문의", "Notes"], ["끝.", "End."])
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("value"))
