"""Assets, curated documents, backfill, chunk joins, embeddings, service requests and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ingest, merge, service
from quern.plans.tables import table
from quern.plans.text_queries import NOISE, _squeeze, _strip

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _nested(spark, sf_dir):
    """Documents with their assets as the lists a collector hands over."""
    a = table(spark, sf_dir, "document_assets")
    none = F.lit(None).cast("string")
    file = F.struct(F.col("asset_index").alias("index"), "file_name", "file_url", "file_ext", none.alias("saved_path"), "file_size", "parser_type", F.col("extracted_text").alias("text"), "page_count",
                    none.alias("note"), F.concat(F.lit("application/"), F.ltrim(F.lower("file_ext"), F.lit("."))).alias("content_type"))
    picture = F.struct(F.col("asset_index").alias("index"), F.col("file_url").alias("url"), F.col("extracted_text").alias("text"))
    return a.groupBy("doc_id").agg(F.collect_list(F.when(F.col("asset_type") == "attachment", file)).alias("attachments"), F.collect_list(F.when(F.col("asset_type") == "image", picture)).alias("images"))


@query("""SELECT doc_id, asset_type, asset_index, CASE WHEN asset_type = 'attachment' THEN file_name END AS file_name, file_url, CASE WHEN asset_type = 'attachment' THEN file_size END AS file_size,
 CASE WHEN asset_type = 'image' THEN 'image_ocr' ELSE parser_type END AS parser_type, length(extracted_text) AS n_text, CASE WHEN asset_type = 'attachment' THEN page_count END AS page_count,
 CASE WHEN asset_type = 'attachment' THEN 'application/' || ltrim(lower(file_ext), '.') END AS content_type FROM document_assets WHERE asset_type IN ('attachment', 'image')""")
def asset_rows(spark, sf_dir):
    r = ingest.asset_rows(_nested(spark, sf_dir), "doc_id", "attachments", "images")
    return r.select("doc_id", "asset_type", "asset_index", "file_name", "file_url", "file_size", "parser_type", F.length("extracted_text").cast("long").alias("n_text"), "page_count", F.col("metadata")["content_type"].alias("content_type"))


@query("""SELECT format('{}_att_{:03d}', doc_id, asset_index) AS doc_id, doc_id AS parent_doc_id, 'attachment' AS page_kind, file_name AS title, file_url AS source_url, asset_index AS attachment_index
FROM document_assets WHERE asset_type = 'attachment'""")
def attachment_documents(spark, sf_dir):
    return ingest.attachment_documents(_nested(spark, sf_dir), "doc_id", "attachments").select("doc_id", "parent_doc_id", "page_kind", "title", "source_url", "attachment_index")


@query("""WITH u AS (SELECT doc_id, list(file_url ORDER BY asset_index, id) AS urls FROM document_assets WHERE asset_type = 'image' GROUP BY doc_id),
t AS (SELECT file_url AS url, max(extracted_text) AS text FROM document_assets WHERE asset_type = 'image' AND file_url IS NOT NULL GROUP BY file_url),
e AS (SELECT doc_id, generate_subscripts(urls, 1)::INTEGER AS image_index, unnest(urls) AS image_url FROM u)
SELECT doc_id, image_index, image_url, md5(coalesce(text, '')) AS text_hash FROM e LEFT JOIN t ON t.url = e.image_url""")
def image_texts(spark, sf_dir):
    a = table(spark, sf_dir, "document_assets").where("asset_type = 'image'")
    urls = a.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_index", "id", "file_url"))), lambda x: x["file_url"]).alias("urls"))
    texts = a.where("file_url is not null").groupBy(F.col("file_url").alias("url")).agg(F.max("extracted_text").alias("text"))
    return ingest.image_rows(urls, "doc_id", "urls", texts).select("doc_id", "image_index", "image_url", F.md5("image_text").alias("text_hash"))


def _merged(kind, label):
    return f"""string_agg('[{kind.upper()}: ' || coalesce({label}, '') || ']' || chr(10) || {_strip("coalesce(extracted_text, '')")}, chr(10) || chr(10) ORDER BY asset_index, id)
 FILTER (WHERE asset_type = '{kind}' AND {_strip("coalesce(extracted_text, '')")} <> '')"""


@query(f"""WITH s AS (SELECT doc_id, source_type, {_squeeze('raw_text')} AS b, {_squeeze('table_text')} AS t FROM documents),
k AS (SELECT doc_id, source_type, t, {_squeeze("array_to_string(list_filter(string_split(b, chr(10)), lambda x: x = '' OR (length(x) >= 2 AND NOT regexp_matches(x, '(?:^주메뉴)|(?:바로가기 선택$)|(?:^Copyright)|(?:^조회 [0-9]+$)'))), chr(10))")} AS b FROM s),
m AS (SELECT doc_id, {_merged('attachment', 'file_name')} AS a, {_merged('image', 'asset_index::VARCHAR')} AS i FROM document_assets GROUP BY doc_id)
SELECT k.doc_id, source_type, md5(CASE WHEN t = '' THEN b WHEN b = '' THEN t ELSE b || chr(10) || chr(10) || t END) AS clean_hash, md5(a) AS attachment_hash, md5(i) AS image_hash FROM k LEFT JOIN m USING (doc_id)""")
def curated_documents(spark, sf_dir):
    c = ingest.curated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "document_assets"), "doc_id", "raw_text", "table_text", NOISE, ["source_type"])
    return c.select("doc_id", "source_type", F.md5("clean_text").alias("clean_hash"), F.md5("attachment_text").alias("attachment_hash"), F.md5("image_text").alias("image_hash"))


@query("""WITH a AS (SELECT * FROM document_assets WHERE asset_type = 'attachment'), r AS (SELECT * FROM a WHERE parser_type IS NOT NULL),
n AS (SELECT a.* FROM a WHERE doc_id IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND (r.file_name = a.file_name OR r.file_url = a.file_url)))
SELECT n.doc_id, n.id, (coalesce(t.top, 0) + row_number() OVER (PARTITION BY n.doc_id ORDER BY n.id))::INTEGER AS asset_index, d.version + 1 AS version
FROM n JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, max(asset_index) AS top FROM r GROUP BY doc_id) t USING (doc_id)""")
def attachment_backfill(spark, sf_dir):
    """Attachments that no parser has registered yet, neither under their name nor under their address."""
    a = table(spark, sf_dir, "document_assets").where("asset_type = 'attachment'")
    docs = table(spark, sf_dir, "documents").select("doc_id", "version", "text", "table_text", "attachment_text", "image_text")
    new, changed = ingest.backfill(docs, a.where("parser_type is not null"), a, "doc_id", "id")
    return new.join(changed.select("doc_id", "version"), "doc_id").select("doc_id", "id", "asset_index", "version")


@query("""WITH g AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n_raw FROM document_assets GROUP BY doc_id)
SELECT g.doc_id, n_chunks, d.version, coalesce(n_raw, 0) AS n_raw, r.doc_id IS NOT NULL AS has_raw, CASE WHEN d.doc_id IS NULL THEN 'no curated document' END AS error
FROM g LEFT JOIN documents d USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id""")
def chunk_sources(spark, sf_dir):
    raw = table(spark, sf_dir, "document_assets").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_raw"))
    good, bad = ingest.chunk_sources(table(spark, sf_dir, "chunks").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "version"), raw, "doc_id")
    return good.unionByName(bad, allowMissingColumns=True).select("doc_id", "n_chunks", "version", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), F.coalesce("has_raw", F.lit(False)).alias("has_raw"), "error")


@query("SELECT id, 1024 AS dimension, 1.0 AS norm FROM chunks WHERE trim(content) <> ''")
def embed_chunks(spark, sf_dir):
    e = ingest.embedded(table(spark, sf_dir, "chunks"), "id", "content")
    return e.select("id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE raw_text IS NOT NULL AND source_url IS NOT NULL) AS success, count(*) FILTER (WHERE raw_text IS NULL OR source_url IS NULL) AS errors FROM documents GROUP BY source")
def job_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return ingest.job_counters(d, "source", F.when(F.col("raw_text").isNull(), "no text").when(F.col("source_url").isNull(), "no address"))


@query("""WITH s AS (SELECT doc_id, content_hash, version, snapshot, row_number() OVER (PARTITION BY snapshot, doc_id ORDER BY delivered_at DESC, content_hash DESC NULLS LAST, version DESC) AS n FROM doc_snapshots WHERE snapshot IN (5, 6)),
o AS (SELECT * FROM s WHERE n = 1 AND snapshot = 5), w AS (SELECT * FROM s WHERE n = 1 AND snapshot = 6),
d AS (SELECT w.doc_id, w.content_hash, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.content_hash IS NOT DISTINCT FROM w.content_hash THEN 'unchanged' ELSE 'updated' END AS change_type,
 CASE WHEN o.doc_id IS NULL THEN 1 WHEN o.content_hash IS NOT DISTINCT FROM w.content_hash THEN coalesce(o.version, 1) ELSE coalesce(o.version, 0) + 1 END AS version FROM w LEFT JOIN o USING (doc_id)),
c AS (SELECT * FROM d WHERE change_type <> 'unchanged')
SELECT 'decision ' || change_type AS part, count(*) AS n FROM d GROUP BY change_type
UNION ALL SELECT 'documents', (SELECT count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM c)) + (SELECT count(*) FROM c)
UNION ALL SELECT 'history', (SELECT count(*) FROM document_versions) + (SELECT count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM document_versions v WHERE v.doc_id = c.doc_id AND v.version = c.version))
UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM c)) + (SELECT count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM c)))""")
def ingestion_run(spark, sf_dir):
    """The sixth delivery through all relations that hold the fifth: rows of each relation after it."""
    def snapshot(n):
        s = table(spark, sf_dir, "doc_snapshots").where(F.col("snapshot") == n)
        return merge.latest(s, ["doc_id"], [F.desc("delivered_at"), F.desc_nulls_last("content_hash"), F.desc("version")]).select("doc_id", "content_hash", "version")

    history = table(spark, sf_dir, "document_versions").select("doc_id", "version", "content_hash", "change_type")
    chunks = table(spark, sf_dir, "chunks").select("doc_id", "chunk_id")
    r = ingest.ingest(snapshot(6), snapshot(5), history, chunks, chunks)
    out = r["decisions"].select(F.concat(F.lit("decision "), "change_type").alias("part"), "n")
    for name in ("documents", "history", "chunks"):
        out = out.unionByName(r[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n"))
    return out


# ---- service

_U = _strip("coalesce(question, '')")


@query(f"""SELECT id, coalesce(user_id, 'unknown') AS user_id, {_U} AS utterance, CASE WHEN intent_type IS NOT NULL THEN 'https://cb.example/' || intent_type END AS callback_url, intent_type IS NOT NULL AS callback_mode,
 CASE WHEN question IS NULL OR {_U} = '' THEN 'empty' WHEN length({_U}) > 60 THEN 'too long' END AS error FROM query_logs""")
def webhook_events(spark, sf_dir):
    q = table(spark, sf_dir, "query_logs")
    user = F.struct(F.col("user_id").alias("id"))
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("https://cb.example/"), "intent_type").alias("callbackUrl"), user.alias("user"), F.concat(F.lit("  "), "question", F.lit("\n")).alias("utterance")).alias("userRequest")))
    e = service.webhook_events(q.select("id", body.alias("body")), "body")
    return e.select("id", "user_id", "utterance", "callback_url", "callback_mode", service.input_error(F.col("utterance"), 60).alias("error"))


@query("""SELECT id, i::INTEGER AS index, CASE i WHEN 0 THEN question WHEN 1 THEN id::VARCHAR ELSE 'null' END AS query, CASE WHEN i > 0 THEN 'not a string' END AS error
FROM query_logs, range(3) r(i) WHERE question IS NOT NULL UNION ALL SELECT id, NULL, NULL, 'not a JSON array' FROM query_logs WHERE question IS NOT NULL""")
def batch_questions(spark, sf_dir):
    """Arrays of a question, a number and null; and one text a row that is no array."""
    q = table(spark, sf_dir, "query_logs").where("question is not null")
    text = F.concat(F.regexp_replace(F.to_json(F.array("question")), "\\]$", ", "), F.col("id").cast("string"), F.lit(", null]"))
    return service.batch_questions(q.select("id", text.alias("j")).unionByName(q.select("id", F.to_json(F.struct("question")).alias("j"))), "id", "j")


_LAST = "(SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC NULLS LAST, id DESC) AS n FROM query_logs)"
_CATEGORY = "CASE WHEN contains(coalesce(question, ''), '장학') THEN 'scholarship' WHEN contains(coalesce(question, ''), '생활관') OR contains(coalesce(question, ''), '기숙사') THEN 'dormitory' END"
CATEGORIES = [(["장학"], "scholarship"), (["생활관", "기숙사"], "dormitory")]


def _logs(spark, sf_dir):
    """Logs as three parts of a service leave them: with an intent by the result, with a user by the pipeline, else minimal."""
    q = table(spark, sf_dir, "query_logs")
    docs = F.array(F.struct(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id")), F.struct(F.lit("").alias("chunk_id")))
    result = F.when(F.col("intent_type").isNotNull(), F.to_json(F.struct(F.col("question").alias("original_query"), F.col("intent_type").alias("category"), F.array("intent_type").alias("keywords"), docs.alias("selected_docs"),
                                                                        F.lit("2").alias("selected_doc_count"), F.lit("x").alias("retrieved_doc_count"), F.lit(True).alias("success")))).otherwise("{}")
    state = F.when(F.col("user_id").isNotNull(), F.to_json(F.struct(F.col("question").alias("original_query"), F.struct(F.col("user_id").alias("who")).alias("metadata"), F.lit(5).alias("retrieval_top_k"))))
    minimal = service.minimal_log(F.col("question"), service.first_rule(F.col("question"), CATEGORIES), F.lit(False))
    return q.select("id", "request_id", "loaded_at", service.log_of(result, state, minimal).alias("log"))


_RETRIEVAL = f"""SELECT request_id, coalesce(question, '') AS original_query, CASE WHEN intent_type IS NOT NULL THEN intent_type WHEN user_id IS NULL THEN {_CATEGORY} END AS category,
 CASE WHEN intent_type IS NULL AND user_id IS NOT NULL THEN 5 ELSE 10 END AS retrieval_top_k, CASE WHEN intent_type IS NOT NULL THEN 2 ELSE 0 END AS selected_doc_count, 0 AS retrieved_doc_count,
 CASE WHEN intent_type IS NOT NULL THEN 'c' || id ELSE '' END AS chunk_ids, CASE WHEN intent_type IS NOT NULL THEN intent_type ELSE '' END AS keywords, intent_type IS NULL AND user_id IS NULL AS fallback_used, intent_type IS NOT NULL AS success
 FROM {_LAST} WHERE n = 1"""


@query(_RETRIEVAL)
def retrieval_log_upsert(spark, sf_dir):
    """Logs in two deliveries, the second on top of the first; requests logged twice keep the last."""
    logs = _logs(spark, sf_dir)
    rows = service.retrieval_log_rows(logs, "request_id", "log")
    order = logs.select("request_id", "log", F.struct("loaded_at", "id").alias("_o"))
    newest = merge.latest(order, ["request_id"], [F.desc("_o")])
    stored = merge.latest(rows, ["request_id"], [F.asc("original_query")])
    out = service.save_retrieval_logs(stored, service.retrieval_log_rows(newest, "request_id", "log"), [F.asc("request_id")])
    return out.select("request_id", "original_query", "category", "retrieval_top_k", "selected_doc_count", "retrieved_doc_count", F.array_join("selected_chunk_ids", ",").alias("chunk_ids"),
                      F.array_join("keywords", ",").alias("keywords"), "fallback_used", "success")


@query(f"""WITH r AS ({_RETRIEVAL}), p AS (SELECT request_id, max(date_diff('millisecond', created_at, loaded_at)) AS response_time_ms FROM query_logs WHERE user_id IS NOT NULL GROUP BY request_id)
SELECT q.request_id, q.user_id, r.category, r.success, p.response_time_ms FROM {_LAST} q LEFT JOIN r USING (request_id) LEFT JOIN p USING (request_id) WHERE q.n = 1""")
def request_star(spark, sf_dir):
    """Questions with their retrieval and response logs."""
    q = merge.latest(table(spark, sf_dir, "query_logs"), ["request_id"], [F.desc_nulls_last("loaded_at"), F.desc("id")])
    r = retrieval_log_upsert(spark, sf_dir).select("request_id", "category", "success")
    p = table(spark, sf_dir, "query_logs").where("user_id is not null").groupBy("request_id").agg(F.max(F.timestamp_diff("MILLISECOND", "created_at", "loaded_at")).alias("response_time_ms"))
    return service.request_star(q.select("request_id", "user_id"), r, p).select("request_id", "user_id", "category", "success", "response_time_ms")


@query(f"""SELECT id, {_CATEGORY} AS category, CASE WHEN contains(coalesce(question, ''), '정정') THEN 'correction' WHEN contains(coalesce(question, ''), '장학') OR {_CATEGORY} = 'scholarship' THEN 'scholarship replies'
 WHEN contains(coalesce(question, ''), '비용') OR contains(coalesce(question, ''), '납부') THEN 'fees' WHEN {_CATEGORY} = 'dormitory' THEN 'dormitory replies' ELSE 'all replies' END AS replies FROM query_logs""")
def channel_context(spark, sf_dir):
    """Category of an utterance by ordered rules, and its replies by context."""
    q = F.col("question")
    out = table(spark, sf_dir, "query_logs").withColumn("category", service.first_rule(q, CATEGORIES))
    overrides = [(["정정"], None, "correction"), (["장학"], "scholarship", "scholarship replies"), (["비용", "납부"], None, "fees")]
    return out.select("id", "category", service.contextual(q, F.col("category"), overrides, {"dormitory": "dormitory replies"}, "all replies").alias("replies"))
