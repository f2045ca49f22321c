"""Ingestion and service operators on small cases; whole tables are compared with SQL in test_queries."""

import io

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import crawl, ingest, retrieve, service
from quern.sources import files


def test_backfill(spark):
    docs = spark.createDataFrame([(1, "b", None, "[ATTACHMENT: old]\nx", None, 3), (2, "b", None, None, None, None)], "doc_id int, text string, table_text string, attachment_text string, image_text string, version int")
    cols = "doc_id int, id int, asset_index int, file_name string, file_url string, extracted_text string"
    known = spark.createDataFrame([(1, 1, 4, "old", "u1", "x"), (1, 2, 2, None, "u2", "y")], cols)
    found = spark.createDataFrame([(1, 10, None, "old", "other", "x"), (1, 11, None, "renamed", "u2", "y"), (1, 12, None, "new", None, "N"), (1, 13, None, "blank", "u9", " "), (2, 14, None, "old", "u1", "o"), (9, 15, None, "z", "z", "z")], cols)
    new, changed = ingest.backfill(docs, known, found, "doc_id", "id")
    assert sorted((r.doc_id, r.id, r.asset_index) for r in new.collect()) == [(1, 12, 5), (1, 13, 6), (2, 14, 1)]
    got = {r.doc_id: r for r in changed.collect()}
    assert got[1].attachment_text == "[ATTACHMENT: old]\nx\n\n[ATTACHMENT: new]\nN" and got[1].version == 4
    assert got[2].attachment_text == "[ATTACHMENT: old]\no" and got[2].version == 1 and len(got[2].content_hash) == 40
    assert ingest.backfill(docs, known, found.limit(0), "doc_id", "id")[1].count() == 0


def test_embedding_step(spark):
    df = spark.createDataFrame([(i, f"text {i} again") for i in range(70)] + [(900, None), (901, "  ")], "id int, t string")
    got = {r.id: r.embedding for r in ingest.embedded(df.repartition(1), "id", "t", size=64).collect()}
    assert len(got) == 70 and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())
    # An encoder sees prefixed texts in batches; its vectors stay beside their rows.
    seen = ingest.embedded(df, "id", "t", encode=lambda ts: [[float(len(ts) <= 32 and t.startswith("passage: text")), float(t.split()[2])] for t in ts], size=2).collect()
    assert all(abs(r.embedding[1] - r.id * r.embedding[0]) < 1e-4 * (1 + r.id) and r.embedding[0] > 0 for r in seen)
    with pytest.raises(Exception, match="shape"):
        ingest.embedded(df, "id", "t", encode=lambda ts: [[1.0]] * len(ts), size=2).collect()


def test_service_edges(spark):
    df = spark.createDataFrame([(1, '["a", 2, null, ["x"]]'), (2, "[]"), (3, "{broken"), (4, None), (5, '"text"')], "k int, j string")
    got = sorted((r.k, -1 if r["index"] is None else r["index"], r.query, r.error) for r in service.batch_questions(df, "k", "j").collect())
    assert got == [(1, 0, "a", None), (1, 1, "2", "not a string"), (1, 2, "null", "not a string"), (1, 3, '["x"]', "not a string"), (3, -1, None, "not a JSON array"), (5, -1, None, "not a JSON array")]
    bodies = spark.createDataFrame([('{"userRequest": {"utterance": " hi ", "user": {}}}',), ("not json",), (None,)], "b string")
    assert [(r.user_id, r.utterance, r.callback_mode) for r in service.webhook_events(bodies, "b").collect()] == [("unknown", "hi", False), ("unknown", "", False), ("unknown", "", False)]
    logs = spark.createDataFrame([("r1", '{"entities": [1], "keywords": ["k", null], "retrieval_top_k": "many", "selected_docs": [{"chunk_id": "c"}, {}], "error": ""}'), ("", "{}"), ("r2", None)], "request string, log string")
    r = service.retrieval_log_rows(logs, "request", "log").collect()
    assert len(r) == 1 and len(r[0]) == 22
    assert (r[0].entities, r[0].keywords, r[0].retrieval_top_k, r[0].selected_chunk_ids, r[0].error_message, r[0].success, r[0].original_query) == ("{}", ["k"], 10, ["c"], None, False, "")


def test_content_lines(spark):
    c = "제목: 안내\n[BODY]\nbody\n - 첫 문장은 다음 줄로\n이어집니다. 짧다. 두 번째 문장은 스무 글자를 넘습니다. x"
    got = spark.createDataFrame([(c,), (None,)], "c string").select(text.content_lines(F.col("c")).alias("l"), text.context_sentences(F.col("c"), least=10).alias("s")).collect()
    assert got[0].l == ["- 첫 문장은 다음 줄로", got[0].l[1]] and got[0].s == ["첫 문장은 다음 줄로 이어집니다.", "두 번째 문장은 스무 글자를 넘습니다."]
    assert got[1].l == [] and got[1].s == []


def test_binary_download_is_bounded(spark):
    class Reply(io.BytesIO):
        def __init__(self, data, length=None):
            super().__init__(data)
            self.headers = {"Content-Type": "a/b"} | ({"Content-Length": str(length)} if length else {})

    def open_url(u):
        if u == "gone":
            raise OSError("no such page")
        return Reply(b"x" * int(u), 999 if u == "7" else None)

    df = spark.createDataFrame([("5",), ("50",), ("7",), ("gone",)], "u string")
    got = {r.u: (r.content and len(r.content), r.error) for r in files.fetch_binary(df, "u", open_url, most=20, block=4).collect()}
    assert got["5"] == (5, None) and got["50"][0] is None and "larger" in got["50"][1] and "larger" in got["7"][1] and "no such page" in got["gone"][1]


def test_crawl_budget_and_failures(spark):
    edges = spark.createDataFrame([("https://h/a", f"https://h/{x}") for x in "bcde"] + [("https://h/b", "https://h/f"), ("https://h/c", "https://h/g")], "src string, dst string")
    seeds, failed = spark.createDataFrame([("https://h/a",)], "url string"), spark.createDataFrame([("https://h/b",)], "url string")
    run = lambda **k: {r.url[-1]: r.depth for r in crawl.reach(edges, seeds, 2, **k).collect()}
    assert run(pages=3) == {"a": 0, "b": 1, "c": 1} and run(pages=6) == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 1, "f": 2}
    assert run(failed=failed) == {"a": 0, "c": 1, "d": 1, "e": 1, "g": 2} and run(pages=0) == {}


def test_index_with_an_analyser(spark):
    docs = spark.createDataFrame([(1, "학교 학교 도서관"), (2, "도서")], "id int, t string")
    ix = retrieve.Index(docs, "id", F.col("t"), buckets=2, analyse=lambda s: [w[:2] for w in s.split()], analyser="first two")
    assert sorted((r.id, r.token, r.tf, r.length) for r in ix.postings.collect()) == [(1, "도서", 1, 3), (1, "도서관", 1, 3), (1, "학교", 1, 3), (2, "도서", 1, 1)]
