from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import crawl, merge, rank, retrieve, vectors
from quern.operators.snapshots import SnapshotIndex, snapshot_changes

SNAP = "snapshot int, doc_id long, content_hash string, delivered_at timestamp_ntz, source string"
T = datetime(2026, 1, 1)


def changes(spark, rows, schema=SNAP):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in snapshot_changes(df, "snapshot", "doc_id", "content_hash", "delivered_at", buckets=4).collect())


def test_snapshot_changes(spark):
    later = datetime(2026, 1, 2)
    rows = [(1, 1, "AB", T, "x"), (1, 2, "c", T, "x"), (1, 3, None, T, "x"), (1, 5, "q", T, "x"),
            (2, 1, " sha1:ab ", T, "x"), (2, 2, "c", T, "x"), (2, 2, "d", later, "x"), (2, 3, None, T, "x"), (2, 4, "e", T, "x"), (2, 4, "e", T, "x"),
            (3, 1, None, T, "x"), (3, 3, "z", T, "x"), (None, 9, "a", T, "x"), (2, None, "a", T, "x")]
    assert changes(spark, rows) == [(2, 2, "changed"), (2, 4, "added"), (2, 5, "removed"), (3, 1, "changed"), (3, 2, "removed"), (3, 3, "changed"), (3, 4, "removed")]


def test_snapshot_edges(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, 1, "a", T, "x")]) == []
    # A number in between without rows is an empty snapshot.
    assert changes(spark, [(1, 1, "a", T, "x"), (3, 1, "a", T, "x")]) == [(2, 1, "removed"), (3, 1, "added")]


def test_snapshot_index_swaps(spark):
    index = SnapshotIndex(spark, "doc_id", "content_hash", "delivered_at", buckets=2, values=["source"])
    df = lambda rows: spark.createDataFrame([(1, *r) for r in rows], SNAP)
    assert index.apply(df([(1, "a", T, "old"), (2, "b", T, "old")])).count() == 2
    got = {r.doc_id: r for r in index.apply(df([(1, "a2", T, "new"), (3, "c", T, "new")]), with_old=True).collect()}
    assert {k: r.change_type for k, r in got.items()} == {1: "changed", 2: "removed", 3: "added"}
    assert '"source":"old"' in got[1].old_row and got[3].old_row is None
    assert index.apply(df([(1, "a2", T, "x"), (3, "c", T, "x")])).count() == 0


def test_probe_moves_nothing(spark):
    """Index and snapshot lie in the same buckets: the join needs no exchange."""
    rows = [(s, i, str(s * i), T, "x") for s in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, SNAP)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = snapshot_changes(df, "snapshot", "doc_id", "content_hash", "delivered_at", buckets=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_neither_probe_nor_fetch_moves_the_index(spark):
    index = SnapshotIndex(spark, "doc_id", "content_hash", "delivered_at", buckets=4, values=["source"])
    df = lambda k: spark.createDataFrame([(1, i, str(k * i), T, f"s{k}") for i in range(50)], SNAP)
    index.apply(df(1))
    new = index._store(df(2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda old: index.probe(new, old)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(False)
        # For the old values the changes alone move to the buckets of the index, which stays where it is.
        assert plan(True).count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshot_numbers_and_overwritten_deliveries(spark, tmp_path):
    rows = [(20260101, 1, "a", T, "x"), (20260101, 2, "b", T, "x"), (20260201, 1, "a", T, "x"), (20260201, 3, "c", T, "x")]
    df = spark.createDataFrame(rows, SNAP)
    args = ("snapshot", "doc_id", "content_hash", "delivered_at")
    got = sorted(tuple(r) for r in snapshot_changes(df, *args, buckets=2, missing_is_empty=False).collect())
    assert got == [(20260201, 2, "removed"), (20260201, 3, "added")]
    got = sorted(tuple(r) for r in snapshot_changes(df, *args, buckets=2).collect())  # a month of empty numbers is one step
    assert got == [(20260102, 1, "removed"), (20260102, 2, "removed"), (20260201, 1, "added"), (20260201, 3, "added")]
    # One folder overwritten by each delivery: the old value is that of the delivery before.
    path, index = str(tmp_path / "d"), SnapshotIndex(spark, "doc_id", "content_hash", "delivered_at", buckets=2, values=["source"])
    for h, source in (("a", "first"), ("b", "second")):
        spark.createDataFrame([(1, 1, h, T, source)], SNAP).write.mode("overwrite").parquet(path)
        changes = index.apply(spark.read.parquet(path), with_old=True)
    assert [(r.change_type, '"source":"first"' in r.old_row) for r in changes.collect()] == [("changed", True)]
    index.close()


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "k int, v string, created string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    got = {r.k: (r.v, r.created) for r in merge.upsert(t, s, ["k"], keep=["created"]).collect()}
    assert got == {1: ("a", "c1"), 2: ("B", "c2"), 3: ("C", None)}
    assert merge.replace_groups(t, s.where("k > 9"), "k").count() == 2  # nothing delivered: nothing replaced
    d = {r.k: (r.change_type, r.version) for r in merge.version_decision(
        spark.createDataFrame([(1, "h"), (2, None), (3, "x")], "k int, content_hash string").withColumn("version", F.lit(0)),
        spark.createDataFrame([(1, "h", 4), (2, "g", 1)], "k int, content_hash string, version int"), ["k"]).collect()}
    assert d == {1: ("unchanged", 4), 2: ("updated", 2), 3: ("new", 1)}
    twice = spark.createDataFrame([(2, "x"), (7, "b"), (7, "a"), (None, "n"), (None, "n")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in merge.insert_absent(t.select("k", "v"), twice, ["k"]).collect()) == [(0, "n"), (0, "n"), (1, "a"), (2, "b"), (7, "a")]
    p = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in merge.orphans(t, p, "k").collect()] == [2]
    assert sorted((r.k is None) for r in merge.set_null(t, p, "k").collect()) == [False, True]


def test_bm25_prefers_the_right_row(spark):
    rows = [("c1", "수강정정 안내", "수강정정 기간은 3월 2일부터 8일까지입니다."), ("c2", "기숙사 입사", "기숙사 입사 신청 안내"), ("c3", None, None)]
    docs = spark.createDataFrame(rows, "chunk_id string, title string, content string")
    q = spark.createDataFrame([(1, "수강정정 기간 알려줘"), (2, ""), (3, None)], "qid int, question string")
    index = retrieve.Index(docs, "chunk_id", F.concat_ws("\n", "title", "content"))
    hits = retrieve.bm25(index, retrieve.query_terms(q, "qid", F.col("question")))
    got = retrieve.top_k(hits, 1, [F.desc("score")]).collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "c1")]
    none = retrieve.bm25(retrieve.Index(docs.limit(0), "chunk_id", F.col("title")), retrieve.query_terms(q, "qid", F.col("question")))
    assert none.count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("학사지원팀", ["학사"]), (" A ", ["a"]), (None, ["a"]), ("b", []), ("b", None)], "a string, e array<string>")
    assert [r.v for r in df.select(retrieve.value_filter(F.col("a"), F.col("e"), False).alias("v")).collect()] == [True, True, False, True, True]
    assert [r.v for r in df.select(retrieve.value_filter(F.col("a"), F.col("e"), True).alias("v")).collect()] == [False, False, False, True, True]


def test_rerank_and_select(spark):
    rows = [(1, "d1", 10.0, 1, "다른 제목", "본문", "x"), (1, "d2", 5.0, 2, "등록금 납부", "등록금 납부 기간", "x"), (1, "d2", 5.0, 3, "등록금 납부", "등록금 납부 기간", "x")]
    df = spark.createDataFrame(rows, "query_id int, doc string, score double, rank int, title string, content string, source_type string")
    df = df.withColumns({"category": F.col("source_type"), "department": F.lit(None).cast("string"), "published_on": F.lit(None).cast("date"), "query": F.lit("등록금 납부"),
                         "keywords": F.array(F.lit("납부")), "expected_values": F.array().cast("array<string>")})
    out = rank.rerank(df, F.lit("2026-01-01").cast("date"))
    sel = rank.select_distinct(out, "doc", "rerank").orderBy("position").collect()
    assert [(r.doc, r.rank) for r in sel] == [("d2", 2), ("d1", 1)]


def test_reach(spark):
    e = [("https://h/a", "https://h/b#x"), ("https://h/b", "https://h/a"), ("https://h/b", "https://h/c"), ("https://h/c", "https://h/d"), ("https://h/a", "https://other/z"), (None, "https://h/q")]
    edges = spark.createDataFrame(e, "src string, dst string")
    got = {r.url: r.depth for r in crawl.reach(edges, spark.createDataFrame([("https://h/a#top",)], "url string"), 2, ["h"]).collect()}
    assert got == {"https://h/a": 0, "https://h/b": 1, "https://h/c": 2}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<float>")
    got = vectors.cosine_top_k(df, df.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in got] == [(2, 1.0), (3, 0.0)]
    assert vectors.cosine_top_k(df, df.limit(0), "id", "v", 2).count() == 0


def test_cells_of_any_size(spark, monkeypatch):
    """Cells dealt out over several groups give the same; a third of the rows in one place is no problem."""
    import numpy as np
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 8))
    m[400:] = m[0] + rng.normal(size=(200, 8)) * 1e-3
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8)], "id long, v array<double>")
    q = df.where("id % 50 = 0")
    index = vectors.CellIndex(df, "id", "v")
    assert len(index.centres) == 24
    one = sorted(tuple(r) for r in index.search(q, 5).collect())
    monkeypatch.setattr(vectors, "GROUP_ROWS", 40)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", 3)
    assert sorted(tuple(r) for r in index.search(q, 5).collect()) == one
    exact = {(r.query_id, r.id) for r in vectors.cosine_top_k(df, q, "id", "v", 5).collect()}
    assert len({(a, b) for a, b, *_ in one} & exact) >= 0.9 * len(exact)
