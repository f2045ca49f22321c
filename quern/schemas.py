"""Explicit schemas of the stored relations."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType)

S, I, L = StringType(), IntegerType(), LongType()


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


CHUNK = _struct(chunk_id=S, doc_id=S, title=S, content=S, source_type=S, source_url=S, published_at=S, department=S, chunk_index=I, content_length=I, content_hash=S, version=I)
DOCUMENT = _struct(doc_id=S, source_type=S, page_kind=S, department=S, title=S, source_url=S, published_at=TimestampNTZType(), clean_text=S, table_text=S, attachment_text=S,
                   image_text=S, version=I, content_hash=S, metadata=S)
ASSET = _struct(doc_id=S, asset_type=S, asset_index=I, file_name=S, file_url=S, file_ext=S, file_size=L, parser_type=S, extracted_text=S, page_count=I, metadata=MapType(S, S))
EMBEDDING = _struct(chunk_id=S, embedding=ArrayType(FloatType()))
QUERY_LOG = _struct(request_id=S, user_id=S, question=S, intent_type=S, created_at=TimestampNTZType())
RETRIEVAL_LOG = _struct(request_id=S, query_forms=ArrayType(S), keywords=ArrayType(S), filters=S, retrieved=I, selected=I, context=S)
RESPONSE_LOG = _struct(request_id=S, answer_text=S, success=BooleanType(), error_message=S, response_time_ms=L)
HIT = _struct(query_id=L, id=L, score=DoubleType(), rank=I)
