"""Keyed maintenance of tables, referential actions, graph reach, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.scalars import object_or_empty, texts_only, vector_literal
from quern.operators import crawl, ingest, merge, vectors
from quern.plans.tables import table
from quern.sources import sinks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query("SELECT chunk_id, id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM chunks) WHERE n = 1")
def latest_chunks(spark, sf_dir):
    return merge.latest(table(spark, sf_dir, "chunks"), ["chunk_id"], [F.desc_nulls_last("updated_at"), F.desc("id")]).select("chunk_id", "id", "content_hash")


@query("SELECT content_hash, min(id) AS id, max_by(doc_id, id) AS doc_id FROM chunks WHERE content_hash IS NOT NULL GROUP BY content_hash")
def keep_last_at_first(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").select("content_hash", "id", "doc_id")
    return merge.keep_last_at_first(c, "content_hash", "id")


@query("""WITH new AS (SELECT doc_id, content_hash, version, source_type, row_number() OVER (PARTITION BY doc_id ORDER BY delivered_at DESC, content_hash DESC NULLS LAST, version DESC) AS n FROM doc_snapshots WHERE snapshot = 6),
old AS (SELECT doc_id, content_hash, version, source_type, row_number() OVER (PARTITION BY doc_id ORDER BY delivered_at DESC, content_hash DESC NULLS LAST, version DESC) AS n FROM doc_snapshots WHERE snapshot = 5)
SELECT doc_id, content_hash, source_type, 'new' AS written FROM new WHERE n = 1 UNION ALL SELECT doc_id, content_hash, source_type, 'kept' FROM old WHERE n = 1 AND doc_id NOT IN (SELECT doc_id FROM new)""")
def upsert_documents(spark, sf_dir):
    old, new = _snapshot(spark, sf_dir, 5), _snapshot(spark, sf_dir, 6)
    return merge.upsert(old.withColumn("written", F.lit("kept")), new, ["doc_id"], stamp={"written": F.lit("new")}).select("doc_id", "content_hash", "source_type", "written")


def _snapshot(spark, sf_dir, n):
    s = table(spark, sf_dir, "doc_snapshots").where(F.col("snapshot") == n)
    return merge.latest(s, ["doc_id"], [F.desc("delivered_at"), F.desc_nulls_last("content_hash"), F.desc("version")])


@query("""WITH d AS (SELECT doc_id, content_hash, version FROM documents),
s AS (SELECT doc_id, content_hash AS h, version AS v, row_number() OVER (PARTITION BY doc_id ORDER BY delivered_at DESC, content_hash DESC NULLS LAST, version DESC) AS n FROM doc_snapshots WHERE snapshot = 5)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.h IS NOT DISTINCT FROM d.content_hash THEN 'unchanged' ELSE 'updated' END AS change_type,
 (CASE WHEN s.doc_id IS NULL THEN 1 WHEN s.h IS NOT DISTINCT FROM d.content_hash THEN coalesce(s.v, 1) ELSE coalesce(s.v, 0) + 1 END)::INTEGER AS version
FROM d LEFT JOIN s ON s.doc_id = d.doc_id AND s.n = 1""")
def version_decision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "content_hash", "version")
    return merge.version_decision(docs, _snapshot(spark, sf_dir, 5), ["doc_id"]).select("doc_id", "change_type", "version")


@query("""SELECT doc_id, version, 'history' AS origin FROM document_versions UNION ALL
SELECT doc_id, version, 'document' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM document_versions v WHERE v.doc_id = d.doc_id AND v.version = d.version)""")
def insert_if_absent(spark, sf_dir):
    h = table(spark, sf_dir, "document_versions").select("doc_id", "version", F.lit("history").alias("origin"))
    return merge.insert_absent(h, table(spark, sf_dir, "documents").select("doc_id", "version", F.lit("document").alias("origin")), ["doc_id", "version"])


@query("""WITH new AS (SELECT * FROM document_assets WHERE created_at >= TIMESTAMP '2026-06-01')
SELECT id, doc_id, 'old' AS batch FROM document_assets WHERE created_at < TIMESTAMP '2026-06-01' AND doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT id, doc_id, 'new' FROM new""")
def replace_assets(spark, sf_dir):
    a = table(spark, sf_dir, "document_assets").select("id", "doc_id", "created_at")
    new = a.where("created_at >= timestamp_ntz'2026-06-01'").withColumn("batch", F.lit("new"))
    return merge.replace_groups(a.where("created_at < timestamp_ntz'2026-06-01'").withColumn("batch", F.lit("old")), new, "doc_id").select("id", "doc_id", "batch")


@query("""SELECT 'chunks' AS child, count(*) AS n FROM chunks c WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id) UNION ALL
SELECT 'snapshots', count(*) FROM doc_snapshots c WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id) UNION ALL
SELECT 'empty documents', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE d.doc_id = c.doc_id)""")
def fk_violations(spark, sf_dir):
    d, c, s = (table(spark, sf_dir, t) for t in ("documents", "chunks", "doc_snapshots"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "n")
    return count(merge.orphans(c, d, "doc_id"), "chunks").unionByName(count(merge.orphans(s, d, "doc_id"), "snapshots")).unionByName(count(merge.orphans(d, c, "doc_id"), "empty documents"))


@query("""SELECT 'cascade' AS action, id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'ko') UNION ALL
SELECT 'set null', id, CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE lang = 'ko') THEN doc_id ELSE -1 END FROM document_assets""")
def cascade_delete(spark, sf_dir):
    left = table(spark, sf_dir, "documents").where("lang = 'ko'")
    a = merge.cascade(table(spark, sf_dir, "chunks"), left, "doc_id").select(F.lit("cascade").alias("action"), "id", "doc_id")
    return a.unionByName(merge.set_null(table(spark, sf_dir, "document_assets"), left, "doc_id").select(F.lit("set null").alias("action"), "id", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")))


@query("""SELECT doc_id, source, collected_at FROM (SELECT *, coalesce(max(CASE WHEN published_at < TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents) WHERE s = 0""")
def stop_at_date(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "collected_at", "published_at")
    return merge.before_stop(d, "source", "doc_id", F.col("published_at") < F.lit("2024-01-01").cast("timestamp_ntz")).select("doc_id", "source", "collected_at")


def _page(c):
    return F.concat(F.lit("https://h.example/p/"), F.col(c).cast("string"))


def _links(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b is not null")
    return pairs.select(_page("a").alias("src"), F.concat(_page("b"), F.lit("#top")).alias("dst"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'https://h.example/p/' || a AS src, 'https://h.example/p/' || b AS dst FROM
 (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL),
r AS (SELECT 'https://h.example/p/' || p_partkey AS url, 0 AS depth FROM part WHERE p_size = (SELECT max(p_size) FROM part) UNION SELECT dst, depth + 1 FROM r JOIN e ON e.src = r.url WHERE depth < 2)
SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY url""")
def link_bfs(spark, sf_dir):
    """Pages reached in two steps from all parts of the largest size, a share of the table at every scale."""
    parts = table(spark, sf_dir, "part")
    largest = parts.agg(F.max("p_size").alias("p_size"))
    seeds = parts.join(F.broadcast(largest), "p_size").select(_page("p_partkey").alias("url"))
    return crawl.reach(_links(spark, sf_dir), seeds, 2, ["h.example"]).select("url", "depth")


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50, against all."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.cosine_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query()
def vector_cells(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.CellIndex(e, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), 10)


@query("""WITH c AS (SELECT id, chunk_id, updated_at, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM chunks)
SELECT e.vec_id AS id, c.n IS NOT NULL AS renewed, 2 + 0 * e.vec_id::INTEGER AS first_two FROM embeddings e LEFT JOIN c ON c.id = e.vec_id AND c.n = 1 UNION ALL
SELECT c.id, true, 2 FROM c WHERE n = 1 AND trim(coalesce((SELECT content FROM chunks k WHERE k.id = c.id), '')) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.id)""".replace("c.n IS NOT NULL AS renewed", "c.n IS NOT NULL AND trim(coalesce((SELECT content FROM chunks k WHERE k.id = e.vec_id), '')) <> '' AS renewed"))
def upsert_embeddings(spark, sf_dir):
    """Vectors of the latest chunks on top of the stored ones: the same key is replaced, others stay or join."""
    chunks = merge.latest(table(spark, sf_dir, "chunks"), ["chunk_id"], [F.desc_nulls_last("updated_at"), F.desc("id")])
    new = ingest.embedded(chunks, "id", "content", size=64).withColumn("renewed", F.lit(True))
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(False).alias("renewed"))
    out = merge.upsert(old, new, ["id"])
    return out.select("id", "renewed", F.size(F.slice("embedding", 1, 2)).alias("first_two"))


@query()
def vector_literals(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vector_literal(F.col("embedding")).alias("literal"), F.size("embedding").alias("dimension"))


@query("""SELECT source, source_type, count(*) AS count, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL""")
def page_manifests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "source_type", F.col("doc_id").alias("pos"), "n_chars")
    m = sinks.page_manifest(d, "source", "source_type")
    return m.select("source", "source_type", "count", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n_chars"]).alias("chars"))


@query("""SELECT 'good' AS part, count(*) AS n FROM document_assets WHERE extracted_text <> '' UNION ALL SELECT coalesce(CASE WHEN extracted_text IS NULL THEN 'no text' WHEN extracted_text = '' THEN 'empty text' END, '?'), count(*)
FROM document_assets WHERE extracted_text IS NULL OR extracted_text = '' GROUP BY 1""")
def quarantine_split(spark, sf_dir):
    a = table(spark, sf_dir, "document_assets")
    good, bad = sinks.quarantine(a, F.when(F.col("extracted_text").isNull(), "no text").when(F.col("extracted_text") == "", "empty text"))
    n = F.count(F.lit(1)).alias("n")
    return good.agg(n).select(F.lit("good").alias("part"), "n").unionByName(bad.groupBy(F.col("error").alias("part")).agg(n))


@query("""SELECT doc_id, asset_type, asset_index, coalesce(max_index, 0) + row_number() OVER (PARTITION BY doc_id ORDER BY id) AS next_index FROM (SELECT *, max(asset_index) OVER (PARTITION BY doc_id) AS max_index FROM document_assets)""")
def next_asset_index(spark, sf_dir):
    a = table(spark, sf_dir, "document_assets")
    w = Window.partitionBy("doc_id")
    return a.select("doc_id", "asset_type", "asset_index", (F.coalesce(F.max("asset_index").over(w), F.lit(0)) + F.row_number().over(w.orderBy("id"))).cast("long").alias("next_index"))


@query("""SELECT asset_type, count(*) AS files, count(*) FILTER (WHERE extracted_text <> '') AS with_text, count(*) FILTER (WHERE lower(file_ext) = '.pdf') AS pdf, round(avg(page_count), 6) AS mean_pages FROM document_assets GROUP BY asset_type""")
def asset_counters(spark, sf_dir):
    return table(spark, sf_dir, "document_assets").groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("extracted_text") != "").alias("with_text"), F.count_if(F.lower("file_ext") == ".pdf").alias("pdf"), F.round(F.avg("page_count"), 6).alias("mean_pages"))


@query("""SELECT doc_id, '["' || source || '","' || source_type || '"]' AS origin, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS answer,
 '{"version":' || version || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || '}' AS facts FROM documents""")
def csv_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("source", "source_type").alias("origin"), F.col("text").alias("answer"), F.struct("version", "lang").alias("facts"))
    return sinks.report(d)


@query("""SELECT doc_id, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN json(metadata)::VARCHAR ELSE '{}' END AS metadata,
 array_to_string(list_filter([lang, department, version::VARCHAR], lambda x: x IS NOT NULL), '|') AS values FROM documents""")
def json_coercion(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", object_or_empty(F.col("metadata")).alias("metadata"), F.array_join(texts_only(F.array("lang", "department", F.col("version").cast("string"))), "|").alias("values"))


@query("""SELECT doc_id, to_json({'text': substring(coalesce(nullif(trim(text), ''), '-'), 1, 500), 'title': substring(coalesce(nullif(trim(title), ''), '-'), 1, 50),
 'description': substring(coalesce(nullif(trim(table_text), ''), '-'), 1, 300), 'quick_replies': [source, source_type, department]})::VARCHAR AS card FROM documents""")
def channel_cards(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", sinks.channel_response(F.col("text"), F.col("title"), F.col("table_text"), F.array("source", "source_type", "department", "lang")).alias("card"))
