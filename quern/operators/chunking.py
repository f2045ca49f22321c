"""Documents to chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import greedy_pack, let, strip

SIZE, OVERLAP, LEAST, MAX_PER_SECTION = 900, 100, 50, 80
HEADER = r"^\[ATTACHMENT: (.*)\]$"


def attachment_sections(c: Column) -> Column:
    """array<struct<title, text>>: rows after an attachment header belong to it; text before the first has no title."""
    def of(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(HEADER))
        return let(heads, lambda at: F.filter(F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: one(lines, at, k)), lambda s: s["text"] != ""))

    def one(lines: Column, at: Column, k: Column) -> Column:
        # Section k: lines between header k - 1 (none before the first) and header k (the end after the last).
        start = F.when(k > 0, F.get(at, k - 1)).otherwise(-1)
        end = F.coalesce(F.get(at, k), F.size(lines))
        title = F.when(k > 0, F.regexp_extract(F.get(lines, start), HEADER, 1)).otherwise("")
        return F.struct(title.alias("title"), strip(F.array_join(F.slice(lines, start + 2, end - start - 1), "\n")).alias("text"))

    return let(F.split(F.coalesce(c, F.lit("")), "\n", -1), of)


def sections(body: Column, table: Column, attachment: Column, image: Column) -> Column:
    """array<struct<kind, title, text>> in the order body, table, attachments, image; empty ones leave."""
    def one(kind, c):
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("title"), strip(F.coalesce(c, F.lit(""))).alias("text")))

    att = F.transform(attachment_sections(attachment), lambda s: F.struct(F.lit("attachment").alias("kind"), s["title"].alias("title"), s["text"].alias("text")))
    return F.filter(F.concat(one("body", body), one("table", table), att, one("image", image)), lambda s: s["text"] != "")


def has_text(*cs: Column) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | (strip(F.coalesce(c, F.lit(""))) != "")
    return out


def chunk_documents(docs: DataFrame, key: str, title: str, body: str, table: str, attachment: str, image: str, size: int = SIZE,
                    overlap: int = OVERLAP, least: int = LEAST, cap: int | None = MAX_PER_SECTION) -> DataFrame:
    """Chunk records ``key, chunk_id, chunk_index, section_index, section_type, section_title, piece_index, n_pieces,
    truncated, content, content_hash``.

    A chunk carries title and kind above its text; chunks below ``least`` signs leave before numbering; a section
    keeps its first ``cap`` pieces and is marked as truncated beyond (a documented property of the index); with ``cap``
    None it keeps all."""
    parts = (docs.where(has_text(F.col(body), F.col(attachment), F.col(image)))
             .select(F.col(key), F.col(title).alias("_title"), F.posexplode(sections(F.col(body), F.col(table), F.col(attachment), F.col(image))).alias("s", "sec")))
    pieces = parts.select(key, "_title", (F.col("s") + 1).alias("section_index"), F.col("sec.kind").alias("section_type"), F.col("sec.title").alias("section_title"),
                          greedy_pack(F.col("sec.text"), size, overlap).alias("p"))
    rows = pieces.select(key, "_title", "section_index", "section_type", "section_title", F.size("p").alias("n_pieces"), F.posexplode("p").alias("i", "text"))
    if cap is not None:
        rows = rows.where(F.col("i") < cap)
    head = F.concat_ws("\n\n", F.concat(F.lit("[TITLE]\n"), F.coalesce("_title", F.lit(""))), F.concat(F.lit("["), F.upper("section_type"), F.lit("]\n"), F.col("text")))
    rows = rows.withColumn("content", head).where(F.length("content") >= least)
    n = F.row_number().over(Window.partitionBy(key).orderBy("section_index", "i"))
    return rows.withColumn("chunk_index", n).select(
        key, F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 3, "0")).alias("chunk_id"), "chunk_index", "section_index", "section_type",
        "section_title", (F.col("i") + 1).alias("piece_index"), "n_pieces", (F.col("n_pieces") > cap if cap is not None else F.lit(False)).alias("truncated"), "content", F.sha1("content").alias("content_hash"))


def drop_repeated_lines(c: Column, least: int = 8, most: int = 3) -> Column:
    """Lines of at least ``least`` signs that are not all digits and stand more than ``most`` times leave the text."""
    keys = lambda lines: F.filter(F.transform(lines, strip), lambda x: (F.length(x) >= least) & ~x.rlike("^[0-9]+$"))

    def repeated(ordered: Column) -> Column:
        # In sorted order a line that stands more often than allowed meets itself that many places further on.
        return F.array_distinct(F.filter(ordered, lambda x, i: F.get(ordered, i + most) == x))

    return let(F.split(c, "\n", -1), lambda lines: let(let(F.array_sort(keys(lines)), repeated), lambda gone: F.array_join(
        F.filter(lines, lambda x: ~F.array_contains(gone, strip(x))), "\n")))
