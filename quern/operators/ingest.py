"""From collected records to stored relations: curated documents, assets, attachment documents, backfill, chunk joins, embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import clean_text, fingerprint
from quern.operators.merge import insert_absent, replace_groups, upsert, version_decision
from quern.sources.attachments import merge_texts

#: Largest attachment that is taken in (fixed value: 100 MiB).
MAX_ATTACHMENT = 100 << 20


def asset_rows(docs: DataFrame, key: str, attachments: str, images: str) -> DataFrame:
    """Twelve columns an asset, from a list of attachments and a list of images a document; null lists have no rows.
    An image has neither name nor size, and its text is read from the picture."""
    s, i, n = (F.lit(None).cast(t) for t in ("string", "int", "bigint"))
    files = docs.select(F.col(key), F.explode(attachments).alias("a")).select(
        key, F.lit("attachment").alias("asset_type"), F.col("a.index").alias("asset_index"), "a.file_name", "a.file_url", "a.file_ext", "a.saved_path", "a.file_size", "a.parser_type",
        F.col("a.text").alias("extracted_text"), "a.page_count", F.create_map(F.lit("note"), F.col("a.note"), F.lit("content_type"), F.col("a.content_type")).alias("metadata"))
    pictures = docs.select(F.col(key), F.explode(images).alias("a")).select(
        key, F.lit("image").alias("asset_type"), F.col("a.index").alias("asset_index"), s.alias("file_name"), F.col("a.url").alias("file_url"), s.alias("file_ext"), s.alias("saved_path"), n.alias("file_size"),
        F.lit("image_ocr").alias("parser_type"), F.col("a.text").alias("extracted_text"), i.alias("page_count"), F.create_map().cast("map<string,string>").alias("metadata"))
    return files.unionByName(pictures)


def attachment_documents(docs: DataFrame, key: str, attachments: str) -> DataFrame:
    """A document of its own for each attachment, named after its parent and its three-digit number."""
    a = docs.select(F.col(key).alias("parent_doc_id"), F.explode(attachments).alias("a"))
    return a.select(F.format_string("%s_att_%03d", F.col("parent_doc_id").cast("string"), F.col("a.index")).alias("doc_id"), "parent_doc_id", F.lit("attachment").alias("source_type"),
                    F.lit("attachment").alias("page_kind"), F.col("a.file_name").alias("title"), F.col("a.file_url").alias("source_url"), "a.file_name", F.col("a.index").alias("attachment_index"))


def image_rows(docs: DataFrame, key: str, urls: str, texts: DataFrame) -> DataFrame:
    """``key, image_index, image_url, image_text``: numbered from 1; a picture whose text could not be read has an empty one.
    ``texts``: url, text, one row an address."""
    each = docs.select(F.col(key), F.posexplode(urls).alias("i", "image_url"))
    return (each.join(texts.select(F.col("url").alias("image_url"), F.col("text").alias("_t")), "image_url", "left")
            .select(key, (F.col("i") + 1).alias("image_index"), "image_url", F.coalesce("_t", F.lit("")).alias("image_text")))


def curated(raw: DataFrame, assets: DataFrame, key: str, text: str, table: str, noise: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """``key, *keep, clean_text, table_text, attachment_text, image_text``: cleaned text, and the texts of the record's
    assets under their headers (null where it has none)."""
    item = F.struct("asset_index", "id", F.col("file_name").alias("name"), F.col("extracted_text").alias("text"))

    def texts(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("asset_type") == kind, item)))
        return merge_texts(F.transform(rows, lambda x: F.struct((x["name"] if kind == "attachment" else x["asset_index"].cast("string")).alias("name"), x["text"].alias("text"))), kind.upper())

    merged = assets.groupBy(key).agg(texts("attachment").alias("attachment_text"), texts("image").alias("image_text"))
    return (raw.select(key, *keep, clean_text(F.col(text), noise, F.col(table)).alias("clean_text"), F.col(table).alias("table_text")).join(merged, key, "left"))


def unregistered(found: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Files of a record that are not registered for it, by their name or by their path (nulls match nothing)."""
    by = lambda c: registered.where(F.col(c).isNotNull()).select(F.col(key), c)
    return found.join(by("file_name"), [key, "file_name"], "left_anti").join(by("file_url"), [key, "file_url"], "left_anti").select(*found.columns)


def backfill(documents: DataFrame, registered: DataFrame, found: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Files that were found but never registered, numbered on from the largest index of their record, and the
    documents they change: text appended, fingerprint and version renewed.  Files of unknown documents stay out."""
    new = unregistered(found, registered, key).join(documents.select(key), key, "left_semi")
    top = registered.groupBy(key).agg(F.max("asset_index").alias("_top"))
    new = new.join(top, key, "left").withColumn("asset_index", (F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(order))).cast("int")).drop("_top")
    items = F.transform(F.array_sort(F.collect_list(F.struct("asset_index", F.col("file_name").alias("name"), F.col("extracted_text").alias("text")))), lambda x: F.struct(x["name"], x["text"]))
    added = new.groupBy(key).agg(merge_texts(items, "ATTACHMENT").alias("_added"), F.count(F.lit(1)).alias("n_added"))
    text = F.concat_ws("\n\n", F.nullif(F.col("attachment_text"), F.lit("")), "_added")
    changed = documents.join(added, key).withColumn("attachment_text", text)
    parts = {"BODY": F.col("text"), "TABLE": F.col("table_text"), "ATTACHMENT": F.col("attachment_text"), "IMAGE": F.col("image_text")}
    return new, changed.withColumn("content_hash", fingerprint(parts)).withColumn("version", (F.coalesce("version", F.lit(0)) + 1).cast("int")).drop("_added")


def chunk_sources(chunks: DataFrame, documents: DataFrame, raw: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Chunk groups joined to their document (which must be there) and to its raw record (which may be missing);
    groups without a document come back as the second table with their error."""
    groups = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    good = groups.join(documents, key).join(raw.withColumn("has_raw", F.lit(True)), key, "left").withColumn("has_raw", F.coalesce("has_raw", F.lit(False)))
    return good, groups.join(documents.select(key), key, "left_anti").withColumn("error", F.lit("no curated document"))


def hashed_vector(text: str, size: int) -> list[float]:
    """Signed feature hashing of words and letter triples: an encoder that needs no model file."""
    import xxhash

    out = [0.0] * size
    for w in text.lower().split():
        for g in {w, *(w[i:i + 3] for i in range(len(w) - 2))}:
            h = xxhash.xxh3_64_intdigest(g)
            out[(h >> 1) % size] += 1.0 if h & 1 else -1.0
    return out


def embedded(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]] | None = None, size: int = 1024, batch: int = 32, prefix: str = "passage: ") -> DataFrame:
    """``key, embedding``: unit vectors of ``size`` numbers, each beside the row it belongs to.

    ``encode`` takes up to ``batch`` texts, prefixed, and is the place of a model; without it ``hashed_vector`` is used.
    Empty and null texts are no input and have no row; a zero vector stays zero; another length fails the job."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [prefix + t for t in part.column(1).to_pylist()]
                v = np.asarray(encode(texts) if encode else [hashed_vector(t, size) for t in texts], dtype=np.float64)
                if v.shape != (len(texts), size):
                    raise ValueError(f"encoder gave vectors of shape {v.shape}, {size} numbers a text are asked for")
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = (v / np.where(norm > 0, norm, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), size).cast(pa.list_(pa.float32()))], names=[key, "embedding"])

    rows = df.select(key, F.col(text).alias("_t")).where(F.btrim("_t") != "")
    return rows.mapInArrow(run, f"{key} {kind}, embedding array<float>")


def job_counters(rows: DataFrame, job: str, error: Column) -> DataFrame:
    """``job, total, success, errors``: a row fails where ``error`` is not null."""
    return rows.groupBy(job).agg(F.count(F.lit(1)).alias("total"), F.count_if(error.isNull()).alias("success"), F.count_if(error.isNotNull()).alias("errors"))


def ingest(new: DataFrame, documents: DataFrame, history: DataFrame, chunks: DataFrame, new_chunks: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """One delivery through all relations: decision, documents, history and chunks as they are after it.  Unchanged
    records write nothing; chunk sets are replaced for those that changed."""
    decided = version_decision(new, documents, [key])
    write = decided.where("change_type != 'unchanged'")
    return {
        "decisions": decided.groupBy("change_type").agg(F.count(F.lit(1)).alias("n")),
        "documents": upsert(documents, write.drop("change_type"), [key]),
        "history": insert_absent(history, write.select(key, "version", "content_hash", "change_type"), [key, "version"]),
        "chunks": replace_groups(chunks, new_chunks.join(write.select(key), key, "left_semi"), key),
    }
