"""Registered queries of this subpackage. None has an SQL form unless listed in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import leakage, packing, page_model, personal, repeated_lines, residue, scans, splitting, visual_form
from quern.plans.tables import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, sf_dir):
    return repeated_lines.repeated_line_positions(table(spark, sf_dir, "documents"), "doc_id", "source_type", "raw_text")


@query
def p1_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source_type", "raw_text")
    return repeated_lines.without_repeated_lines(docs, "doc_id", "source_type", "raw_text").select("doc_id", "clean_text")


@query
def p1_scores(spark, sf_dir):
    """Every line of p1_found once for each source_type: how often it stands there and whether that is more than outside."""
    return repeated_lines.line_scores(table(spark, sf_dir, "documents"), "doc_id", "source_type", "raw_text")


def _p2_fields(spark, sf_dir):
    return [("raw_text", table(spark, sf_dir, "documents"), "doc_id", "raw_text"),
            ("content", table(spark, sf_dir, "chunks"), "id", "content")]


@query
def p2_found(spark, sf_dir):
    return visual_form.look_alike_pairs(_p2_fields(spark, sf_dir))


@query
def p2_classes(spark, sf_dir):
    """Every record with a look-alike: its class, its text and the number of its look-alikes."""
    return visual_form.look_alike_classes(_p2_fields(spark, sf_dir))


@query
def p2_normalised(spark, sf_dir):
    fields = _p2_fields(spark, sf_dir)
    words = visual_form.spelling_vocabulary([df.select(text) for _, df, _, text in fields])
    out = None
    for name, df, key, text in fields:
        one = visual_form.normalised(df, key, text, words).select(F.lit(name).alias("field"), F.col(key).alias("rec_id"), "form")
        out = one if out is None else out.unionByName(one)
    return out


@query
def p4_found(spark, sf_dir):
    out = None
    for field, name, key in (("attachment_text", "documents", "doc_id"), ("content", "chunks", "id")):
        one = (splitting.split_oversized(table(spark, sf_dir, name), key, field).where("piece_no = 0")
               .select(F.lit(field).alias("field"), F.col("rec_id")))
        out = one if out is None else out.unionByName(one)
    return out


SQL["p4_found"] = """
SELECT 'attachment_text' AS field, doc_id AS rec_id FROM documents WHERE length(attachment_text) > 900
UNION ALL SELECT 'content', id FROM chunks WHERE length(content) > 900
"""


@query
def p4_pieces(spark, sf_dir):
    out = None
    for field, name, key in (("attachment_text", "documents", "doc_id"), ("content", "chunks", "id")):
        one = splitting.split_oversized(table(spark, sf_dir, name), key, field).withColumn("field", F.lit(field))
        out = one if out is None else out.unionByName(one)
    return out


@query
def p9_found(spark, sf_dir):
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


@query
def p9_edits(spark, sf_dir):
    """As p9_found, but the 60 characters may differ by two edits: the alignment decides."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage", edits=2)


@query
def p5_found(spark, sf_dir):
    return page_model.surrounding_lines(table(spark, sf_dir, "documents"), "doc_id", "raw_text", "title")


@query
def p5_body(spark, sf_dir):
    return page_model.main_body(table(spark, sf_dir, "documents"), "doc_id", "raw_text", "title")


@query
def p6_found(spark, sf_dir):
    return residue.residue_records([("raw_text", table(spark, sf_dir, "documents"), "doc_id", "raw_text", "title"),
                                    ("extracted_text", table(spark, sf_dir, "document_assets"), "id", "extracted_text", None)])


def _p7_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assets = table(spark, sf_dir, "document_assets").where("extracted_text != ''").select("id", "doc_id", "extracted_text")
    assets = assets.join(docs.select("doc_id", "title"), "doc_id", "left")
    return ([("image_text", docs, "doc_id", "image_text", "title", True), ("extracted_text", assets, "id", "extracted_text", "title", False)],
            [(docs, "text"), (docs, "title"), (docs, "attachment_text")])


@query
def p7_found(spark, sf_dir):
    return scans.scan_noise(*_p7_tables(spark, sf_dir))


@query
def p7_repaired(spark, sf_dir):
    return scans.repaired(*_p7_tables(spark, sf_dir))


@query
def p10_found(spark, sf_dir):
    return personal.personal_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p10_redacted(spark, sf_dir):
    return personal.redacted(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p8_containers(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p8_report(spark, sf_dir):
    return packing.report(packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text"))
