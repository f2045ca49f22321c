"""Files written and read back, and requests of paged lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.tables import table
from quern.schemas import DOCUMENT
from quern.session import step_path
from quern.sources import files, sinks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query("""SELECT chunk_id, doc_id::VARCHAR AS doc_id, coalesce(title, '') AS title, md5(coalesce(content, '')) AS content_md5, department, chunk_index, coalesce(source_type, '') AS source_type FROM chunks""")
def chunk_files(spark, sf_dir):
    """Chunk sets of all documents written as files and read back: nulls come back as empty texts, but for department."""
    path = step_path(spark, "chunk-files")
    sinks.write_chunk_sets(table(spark, sf_dir, "chunks"), path)
    r = files.json_records(spark, path, lines=True)
    return r.select("chunk_id", "doc_id", "title", F.md5("content").alias("content_md5"), "department", "chunk_index", "source_type")


@query("SELECT source_type, doc_id::VARCHAR AS doc_id, count(*) AS n_chunks FROM chunks GROUP BY ALL")
def chunk_file_heads(spark, sf_dir):
    """Kind, document and number of records of each chunk set."""
    path = step_path(spark, "chunk-files")
    sinks.write_chunk_sets(table(spark, sf_dir, "chunks"), path)
    r = files.json_records(spark, path, lines=True)
    return r.groupBy("source_type", "doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("""SELECT doc_id::VARCHAR AS doc_id, source_type, title, md5(text) AS text_md5, version, content_hash, source_type AS folder_kind FROM documents""")
def curated_files(spark, sf_dir):
    """Documents written as JSON in folders by kind and read back with their explicit schema; the kind comes from the path."""
    path = step_path(spark, "curated")
    d = table(spark, sf_dir, "documents")
    sinks.write_partitions(d.select(F.col("doc_id").cast("string").alias("doc_id"), "source_type", F.col("source_type").alias("kind"), "title", F.col("text").alias("clean_text"), "version", "content_hash"), path, "kind", "json")
    r = files.one_level(spark, path, DOCUMENT, lines=True)
    return r.select("doc_id", "source_type", "title", F.md5("clean_text").alias("text_md5"), "version", "content_hash", F.regexp_replace("folder_kind", "^kind=", "").alias("folder_kind"))


@query("""SELECT source, n::INTEGER AS page_no, 'https://h.example/' || source || '?mode=list&articleLimit=10&article.offset=' || (n - 1) * 10 AS request_url
FROM (SELECT DISTINCT source FROM documents WHERE page_kind = 'board_detail'), range(1, 51) r(n)""")
def page_requests(spark, sf_dir):
    """Requests of the first fifty list pages of every board, the reference's own budget."""
    d = table(spark, sf_dir, "documents").where("page_kind = 'board_detail'").select("source").distinct()
    seeds = d.select(F.col("source").alias("name"), F.concat(F.lit("https://h.example/"), "source").alias("url"), F.lit("notice").alias("source_type"), F.lit("board").alias("page_kind"))
    return files.page_requests(seeds, 50).select(F.col("name").alias("source"), "page_no", "request_url")
