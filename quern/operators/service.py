"""What a question service reads and writes: requests, batches, logs and their precedence, answers by rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import first_filled, int_or
from quern.functions.text import strip
from quern.operators.merge import latest, upsert

LISTS, OBJECTS = ("rewritten_queries", "keywords"), ("entities", "filters", "retrieval_strategy_log", "metadata")
COUNTS = ("retrieved_doc_count", "reranked_doc_count", "selected_doc_count")


def webhook_events(bodies: DataFrame, body: str) -> DataFrame:
    """Adds callback_url, user_id (``unknown`` if none is named), utterance (trimmed, empty if missing or the body is
    broken) and callback_mode to rows with a JSON request; batch or stream."""
    at = lambda path: F.get_json_object(body, f"$.userRequest.{path}")
    return bodies.withColumns({"callback_url": at("callbackUrl"), "user_id": F.coalesce(at("user.id"), F.lit("unknown")), "utterance": strip(F.coalesce(at("utterance"), F.lit(""))),
                               "callback_mode": F.coalesce(at("callbackUrl"), F.lit("")) != ""})


def batch_questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, index, query, error``: elements of a JSON array of questions; an element that is no string and a text
    that is no array become rows with an error, never a failed job.  Null texts have no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    items = json.loads(t)
                except ValueError:
                    items = None
                if not isinstance(items, list):
                    rows.append((k, None, None, "not a JSON array"))
                    continue
                rows += [(k, i, q, None) if isinstance(q, str) else (k, i, json.dumps(q, ensure_ascii=False), "not a string") for i, q in enumerate(items)]
            c = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=[key, "index", "query", "error"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, index int, query string, error string")


def input_error(c: Column, longest: int | None = None) -> Column:
    """Why a text is no valid input, or null."""
    e = F.when(c.isNull(), "missing").when(strip(c) == "", "empty")
    return e.when(F.length(c) > longest, "too long") if longest else e


def log_of(result: Column, state: Column, minimal: Column) -> Column:
    """JSON of the log to keep: the result's own, else the pipeline's, else the minimal one; an empty object is none."""
    full = lambda c: F.when(F.btrim(c).rlike(r"^\{\s*\"") & (F.json_object_keys(c).isNotNull()), c)
    return F.coalesce(full(result), full(state), minimal)


def minimal_log(question: Column, category: Column, success: Column) -> Column:
    """The log of a question whose pipeline left none."""
    return F.to_json(F.struct(question.alias("original_query"), category.alias("category"), F.lit("lexical").alias("retrieval_strategy"), F.lit(10).alias("retrieval_top_k"),
                              F.struct(F.lit("missing_pipeline_retrieval_log").alias("fallback_reason")).alias("retrieval_strategy_log"), (~success).alias("fallback_used"), success.alias("success")))


def retrieval_log_rows(logs: DataFrame, request: str, log: str) -> DataFrame:
    """The 22 columns of a retrieval log from its JSON: missing lists and objects are empty, numbers have defaults, chunk
    ids come from the selected documents.  Rows without a request or a log leave."""
    doc = "array<struct<chunk_id:string>>"
    at = lambda name: F.get_json_object(log, f"$.{name}")
    text = lambda name: F.nullif(at(name), F.lit(""))
    flag = lambda name: F.coalesce(at(name) == "true", F.lit(False))
    chosen = F.coalesce(at("selected_docs"), F.lit("[]"))
    cols = {"original_query": F.coalesce(at("original_query"), F.lit("")), "normalized_query": text("normalized_query"), "rewritten_query": text("rewritten_query")}
    cols |= {c: F.filter(F.coalesce(F.from_json(at(c), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull()) for c in LISTS}
    cols |= {c: F.when(F.json_object_keys(at(c)).isNotNull(), at(c)).otherwise("{}") for c in OBJECTS}
    cols |= {"category": at("category"), "retrieval_strategy": F.coalesce(text("retrieval_strategy"), F.lit("lexical")), "retrieval_top_k": int_or(at("retrieval_top_k"), 10), "fallback_used": flag("fallback_used")}
    cols |= {c: int_or(at(c)) for c in COUNTS}
    ids = F.transform(F.coalesce(F.from_json(chosen, doc), F.array().cast(doc)), lambda d: d["chunk_id"])
    cols |= {"selected_chunk_ids": F.filter(ids, lambda x: F.coalesce(x, F.lit("")) != ""), "selected_documents": chosen, "context": text("context"), "success": flag("success"), "error_message": text("error")}
    rows = logs.where((F.coalesce(request, F.lit("")) != "") & (F.coalesce(log, F.lit("")) != ""))
    return rows.select(F.col(request).alias("request_id"), *[c.alias(n) for n, c in cols.items()])


def save_retrieval_logs(stored: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """The log after ``new``: one row a request, the last written wins."""
    return upsert(stored, latest(new, ["request_id"], order).select(*stored.columns), ["request_id"])


def request_star(questions: DataFrame, retrievals: DataFrame, responses: DataFrame) -> DataFrame:
    """Every question with its retrieval and its response, one to one by request."""
    return questions.join(retrievals, "request_id", "left").join(responses, "request_id", "left")


def first_rule(c: Column, rules: list[tuple[list[str], str]], default: str | None = None, otherwise: Column | None = None) -> Column:
    """Value of the first rule of which a part stands in the text; rules are tried in their order."""
    t = F.coalesce(c, F.lit(""))
    out = otherwise if otherwise is not None else F.lit(default).cast("string")
    for parts, value in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(t, F.lit(p))
        out = F.when(hit, value).otherwise(out)
    return out


def contextual(text: Column, category: Column, overrides: list[tuple[list[str], str | None, str]], by_category: dict[str, str], default: str) -> Column:
    """Value by context: the first override whose part stands in the text or whose category is the row's, else by category, else the default."""
    out = F.lit(default)
    for k, v in by_category.items():
        out = F.when(category == k, F.lit(v)).otherwise(out)
    for parts, kind, value in reversed(overrides):
        hit = F.coalesce(category == kind, F.lit(False)) if kind else F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.coalesce(text, F.lit("")), F.lit(p))
        out = F.when(hit, value).otherwise(out)
    return first_filled(out)
