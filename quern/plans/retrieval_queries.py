"""Retrieval, ranking and answers over chunks, with the evaluation questions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.scalars import first_filled
from quern.functions.text import LABELS, PARTICLES, distinct_tokens
from quern.operators import rank, retrieve
from quern.operators.retrieve import Index, best, bm25, full_text, query_terms, top_k
from quern.plans.tables import table
from quern.session import table_version, written

QUERIES, SQL = {}, {}
AS_OF = "2026-07-01"
#: Fixed stop list of the full-text path.
STOPWORDS = ["what", "and", "the", "무엇", "대한", "것", "알맞"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


TOKENS = "list_filter(list_transform(list_filter(regexp_extract_all(lower({0}), '[가-힣A-Za-z0-9]+'), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$')), lambda t: regexp_replace(t, '" + PARTICLES + "', '')), lambda t: t <> '')"
_TEXT = "coalesce(title, '') || chr(10) || coalesce(content, '')"
_BASE = f"""
tok AS (SELECT id, {TOKENS.format(_TEXT)} AS tokens FROM chunks),
lens AS (SELECT id, len(tokens) AS length FROM tok WHERE len(tokens) > 0),
post AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(length) AS av FROM lens),
terms AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("question")}) AS token FROM eval_items),
df AS (SELECT token, count(*) AS df FROM post WHERE token IN (SELECT token FROM terms) GROUP BY token),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(av, 1.0)))), 6) AS score, count(*) AS matched
       FROM terms JOIN df USING (token) JOIN post USING (token) JOIN lens USING (id), stats GROUP BY ALL HAVING score > 0)"""
_ORDER = "score DESC, published_at DESC NULLS LAST, c.chunk_id DESC, c.id DESC"


def _index(spark, sf_dir):
    """The stored index of the chunks as they are now; the first query of a version builds it."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return Index(table(spark, sf_dir, "chunks"), "id", text, table_version(spark, f"{sf_dir}/chunks.parquet"))


def _parts(spark, sf_dir):
    chunks, items = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "eval_items")
    return chunks, items, _index(spark, sf_dir), query_terms(items, "item_id", F.col("question"))


_KEYS = ["id", "chunk_id", "published_at"]
_ROW = ["id", "doc_id", "title", "content", "source_type", "source_url", "department"]
def _ranked(scored, chunks, k):
    """First ``k`` of each query: cut by score, ties ordered by the keys of the chunk."""
    return top_k(best(scored, k).join(chunks.select(*_KEYS), "id"), k, [F.desc("score"), F.desc_nulls_last("published_at"), F.desc("chunk_id"), F.desc("id")])


@query(f"""WITH {_BASE}
SELECT query_id, id, score, matched, rn::INTEGER AS rank FROM (
  SELECT query_id, id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rn FROM bm JOIN chunks c USING (id)) WHERE rn <= 10""")
def bm25_topk(spark, sf_dir):
    chunks, _, index, terms = _parts(spark, sf_dir)
    return _ranked(bm25(index, terms), chunks, 10).select("query_id", "id", "score", "matched", "rank")


@query(f"""WITH {_BASE}
SELECT query_id, id, score, rn::INTEGER AS rank FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rn
  FROM bm JOIN chunks c USING (id) JOIN eval_items e ON e.item_id = query_id WHERE c.source_type = e.source_type) WHERE rn <= 10""")
def bm25_filtered(spark, sf_dir):
    """The question's source type filters the rows, not the statistics."""
    chunks, items, index, terms = _parts(spark, sf_dir)
    want = items.select(F.col("item_id").alias("query_id"), F.array("source_type").alias("want"))
    hits = (bm25(index, terms).join(chunks.select("id", "source_type"), "id").join(F.broadcast(want), "query_id")
            .where(retrieve.value_filter(F.col("source_type"), F.col("want"), exact=True)).select("query_id", "id", "score"))
    return _ranked(hits, chunks, 10).select("query_id", "id", "score", "rank")


_RELAX = f"""WITH {_BASE},
allowed AS (SELECT bm.query_id, bm.id, bm.score FROM bm JOIN chunks c USING (id) JOIN eval_items e ON e.item_id = query_id
            WHERE contains(lower(trim(c.department)), CASE WHEN e.item_id % 2 = 0 THEN '학사' ELSE 'no such unit' END)),
strict AS (SELECT *, false AS filters_relaxed FROM allowed),
allrows AS (SELECT * FROM strict UNION ALL SELECT query_id, id, score, true FROM bm WHERE query_id NOT IN (SELECT query_id FROM strict))
SELECT query_id, id, score, filters_relaxed, rn::INTEGER AS rank FROM (
  SELECT query_id, id, score, filters_relaxed, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rn FROM allrows JOIN chunks c USING (id)) WHERE rn <= 5"""


@query(_RELAX)
def filter_relaxation(spark, sf_dir):
    chunks, items, index, terms = _parts(spark, sf_dir)
    scored = bm25(index, terms).select("query_id", "id", "score")
    want = items.select(F.col("item_id").alias("query_id"), F.array(F.when(F.col("item_id") % 2 == 0, "학사").otherwise("no such unit")).alias("want"))
    strict = (scored.join(chunks.select("id", "department"), "id").join(F.broadcast(want), "query_id")
              .where(retrieve.value_filter(F.col("department"), F.col("want"), exact=False)).select("query_id", "id", "score"))
    # A query has a strict result if it has a best one, so both sides are cut before they meet.
    both = retrieve.relax(written(best(strict, 5), "strict"), best(scored, 5))
    return _ranked(both, chunks, 5).select("query_id", "id", "score", "filters_relaxed", "rank")


_WEAK = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"""
WITH docs AS (SELECT c.id, c.chunk_id, c.published_at, lower(coalesce(d.title, '') || ' ' || coalesce(c.content, '')) AS t FROM chunks c JOIN documents d USING (doc_id)),
terms AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("question")}) AS token FROM eval_items),
good AS (SELECT * FROM terms WHERE token NOT IN ({_WEAK}) AND NOT (regexp_matches(token, '^[A-Za-z]+$') AND length(token) < 3)),
words AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[가-힣a-z0-9]+')) AS token FROM docs) WHERE token IN (SELECT token FROM good) GROUP BY ALL),
small AS (SELECT DISTINCT token FROM good),
inside AS (SELECT id, token, 1 AS i FROM docs JOIN small ON contains(t, token)),
s AS (SELECT query_id, id, round(0.1 * sum(coalesce(n, 0)) + 0.2 * sum(coalesce(i, 0)), 6) AS score
      FROM (SELECT id, token, n, i FROM words FULL JOIN inside USING (id, token)) JOIN good USING (token) GROUP BY ALL),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, published_at DESC NULLS LAST, chunk_id ASC, id ASC) AS rn FROM s JOIN docs USING (id))
SELECT query_id, id, score, rn::INTEGER AS rank FROM r WHERE rn <= 30 AND score >= 0.5""")
def fts_topk(spark, sf_dir):
    """Full-text and substring score; the floor is tested after the limit."""
    chunks, items = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "eval_items")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("title").alias("d_title"))
    rows = chunks.join(docs, "doc_id")
    terms = query_terms(items, "item_id", F.col("question")).where(~retrieve.weak_term(F.col("token"), STOPWORDS))
    text = F.concat(F.coalesce("d_title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    scored = best(full_text(rows, "id", text, terms, k=30), 30).join(chunks.select(*_KEYS), "id")
    out = top_k(scored, 30, [F.desc("score"), F.desc_nulls_last("published_at"), "chunk_id", "id"])
    return out.where(F.col("score") >= retrieve.MIN_TEXT_SCORE).select("query_id", "id", "score", "rank")


def _hits(spark, sf_dir):
    chunks, items, index, terms = _parts(spark, sf_dir)
    rows = _ranked(bm25(index, terms), chunks, 10).join(chunks.select(*_ROW), "id")  # texts of the survivors alone
    asked = items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), F.array().cast("array<string>").alias("keywords"), F.array(F.col("source_type")).alias("expected_values"))
    return (rows.join(F.broadcast(asked), "query_id")
            .withColumns({"category": F.col("source_type"), "published_on": F.to_date("published_at")}))


_RERANK = f"""{_BASE},
top AS (SELECT * FROM (SELECT query_id, c.id, c.doc_id, c.title, c.content, c.source_type, c.source_url, c.department, c.published_at, score,
         row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM bm JOIN chunks c USING (id)) WHERE rank <= 10),
sig AS (SELECT top.*, e.question AS q, e.source_type AS want,
   list_distinct(regexp_extract_all(lower(e.question), '[가-힣A-Za-z0-9]+')) AS k,
   list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[가-힣A-Za-z0-9]+')) AS tt, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[가-힣A-Za-z0-9]+')) AS ct,
   max(score) OVER (PARTITION BY query_id) AS mx FROM top JOIN eval_items e ON e.item_id = query_id),
sc AS (SELECT *, round(least(score / mx, 1.0) * 3.0, 6) AS base_score,
   round(CASE WHEN len(k) > 0 AND len(tt) > 0 THEN len(list_intersect(k, tt)) / len(k) * 1.8 ELSE 0 END, 6) AS title_match,
   round(CASE WHEN len(k) > 0 AND len(ct) > 0 THEN len(list_intersect(k, ct)) / len(k)::DOUBLE ELSE 0 END, 6) AS content_match,
   CASE WHEN trim(q) <> '' AND contains(lower(coalesce(title, '') || chr(10) || coalesce(content, '')), lower(trim(q))) THEN 0.8 ELSE 0.0 END::DOUBLE AS exact_query_match,
   CASE WHEN contains(lower(source_type), lower(want)) OR contains(lower(coalesce(department, '')), lower(want)) THEN 0.7 ELSE 0.0 END::DOUBLE AS category_match,
   round(coalesce(0.4 * exp(-greatest(date_diff('day', published_at::DATE, DATE '{AS_OF}'), 0) / 365.0), 0), 6) AS recency FROM sig),
rr AS (SELECT *, round(base_score + title_match + content_match + exact_query_match + category_match + recency, 6) AS rerank_score FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank FROM rr)"""


@query(f"WITH {_RERANK} SELECT query_id, id, base_score, title_match, content_match, exact_query_match, category_match, recency, rerank_score, rerank::INTEGER AS rerank FROM ranked")
def rerank_signals(spark, sf_dir):
    out = rank.rerank(_hits(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return out.select("query_id", "id", "base_score", "title_match", "content_match", "exact_query_match", "category_match", "recency", "rerank_score", "rerank")


_SELECT = f"""{_RERANK},
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank) AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rerank) AS n FROM ranked) WHERE n = 1)"""


@query(f"WITH {_SELECT} SELECT query_id, doc_id, id, position::INTEGER AS position FROM sel WHERE position <= 3")
def select_top3(spark, sf_dir):
    out = rank.rerank(_hits(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return rank.select_distinct(out, "doc_id", "rerank", 3).select("query_id", "doc_id", "id", "position")


def _selected(spark, sf_dir):
    out = rank.rerank(_hits(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return rank.select_distinct(out, "doc_id", "rerank", 3).withColumn("source", first_filled(F.col("source_url"), F.col("source_type")))


@query(f"""WITH {_SELECT}
SELECT query_id, string_agg('[' || position || '] ' || coalesce(nullif(trim(title), ''), '-') || chr(10) || '(' || coalesce(nullif(trim(coalesce(nullif(source_url, ''), source_type)), ''), '-') || ', '
  || coalesce(strftime(published_at::DATE, '%Y-%m-%d'), '-') || ')' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY position) AS context FROM sel WHERE position <= 3 GROUP BY query_id""")
def build_context(spark, sf_dir):
    return rank.context(_selected(spark, sf_dir), "title", "source", "published_on", "content")


_ST = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g')"
_LABEL = " OR ".join(f"starts_with(x, '{p}')" for p in LABELS)
_ANSWER = f"""{_SELECT},
tx AS (SELECT query_id, any_value(q) AS q, string_agg(coalesce(content, ''), chr(10) ORDER BY position) AS t FROM sel WHERE position <= 3 GROUP BY query_id),
ln AS (SELECT query_id, q, {_ST.format(r"regexp_replace(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: " + _ST.format("x") + "), lambda x: NOT (x = '' OR x = 'body' OR " + _LABEL + r")), ' '), '[\s\x{{00A0}}\x{{3000}}]+', ' ', 'g')".replace('{{', '{').replace('}}', '}'))} AS t FROM tx),
pt AS (SELECT query_id, q, string_split(regexp_replace(regexp_replace(t, '([.!?。])\\s+', '\\1' || chr(1), 'g'), '다\\s+', '다' || chr(1), 'g'), chr(1)) AS ps FROM ln),
sn AS (SELECT query_id, q, generate_subscripts(ps, 1) AS pos, unnest(ps) AS p FROM pt),
ov AS (SELECT query_id, pos, substring(trim(p, ' -'), 1, 240) AS sentence, len(list_intersect(list_distinct(regexp_extract_all(lower(q), '[가-힣A-Za-z0-9]+')), list_distinct(regexp_extract_all(lower(substring(trim(p, ' -'), 1, 240)), '[가-힣A-Za-z0-9]+')))) AS overlap
  FROM sn WHERE length({_ST.format('p')}) >= 20)"""


@query(f"""WITH {_ANSWER} SELECT query_id, position::INTEGER AS position, {_ST.format('sentence')} AS sentence, overlap::INTEGER AS overlap FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, length(sentence) DESC, pos) AS position FROM ov WHERE overlap > 0) WHERE position <= 4""")
def answer_batch(spark, sf_dir):
    """Questions in, extractive answers out, in one plan."""
    rows = _selected(spark, sf_dir).groupBy("query_id", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n").alias("text"))
    return rank.extractive_answer(rows, "query_id", "query", "text")


@query(f"SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format(_TEXT)}) AS token FROM chunks) GROUP BY ALL")
def term_frequency(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("id", "token", "tf")


@query(f"SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest({TOKENS.format(_TEXT)}) AS token FROM chunks) GROUP BY token")
def document_frequency(spark, sf_dir):
    return _index(spark, sf_dir).frequencies


@query(f"SELECT count(*) AS n_docs, round(coalesce(avg(len(t)), 0), 6) AS avg_length FROM (SELECT {TOKENS.format(_TEXT)} AS t FROM chunks) WHERE len(t) > 0")
def corpus_statistics(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query("""WITH e AS (SELECT item_id, source_type, list_distinct(regexp_extract_all(lower(question), '[가-힣A-Za-z0-9]+')) AS q FROM eval_items),
d AS (SELECT doc_id, source_type, list_distinct(regexp_extract_all(lower(title), '[가-힣A-Za-z0-9]+')) AS t FROM documents)
SELECT item_id, doc_id, coalesce(d.source_type = e.source_type, false) AS same_source, len(list_intersect(q, t)) AS shared FROM e, d WHERE len(list_intersect(q, t)) > 0""")
def title_overlap(spark, sf_dir):
    """Every question against every document: tokens that question and title share.  Pairs meet by token, so a pair
    without one is never formed."""
    items, docs = table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents")
    asked = items.select("item_id", F.col("source_type").alias("want"), F.explode(distinct_tokens(F.col("question"))).alias("token"))
    named = docs.select("doc_id", "source_type", F.explode(distinct_tokens(F.col("title"))).alias("token"))
    return (named.join(asked, "token").groupBy("item_id", "doc_id", "want", "source_type").agg(F.count(F.lit(1)).alias("shared"))
            .select("item_id", "doc_id", F.coalesce(F.col("source_type") == F.col("want"), F.lit(False)).alias("same_source"), "shared"))
