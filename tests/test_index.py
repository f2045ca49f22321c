"""The stored index: reuse, plan, null and empty texts; one-pass full text against a plain run."""

import random
import re

from pyspark.sql import functions as F

from quern.functions.text import SearchTokens, search_tokens
from quern.operators import retrieve
from quern.session import table_version


def test_tokens_in_python_and_spark(spark):
    random.seed(3)
    texts = ["".join(random.choice("가나은는이에서으로 부터도aBc9 .-\n") for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["", "이", "으로", "A 5 b", "학교에서 Library는", "K İ"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(search_tokens(F.col("s")).alias("t")).collect()]
    assert got == [SearchTokens(10)(t) for t in texts]


def test_index_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    rows = [(1, "등록 기간 등록"), (2, None), (3, ""), (4, "기간")]
    spark.createDataFrame(rows, "id long, s string").coalesce(1).write.parquet(path)
    open_index = lambda: retrieve.Index(spark.read.parquet(path), "id", F.col("s"), table_version(spark, path), buckets=2)
    a = open_index()
    assert sorted(tuple(r) for r in a.postings.collect()) == [(1, 3, "기간", 1), (1, 3, "등록", 2), (4, 1, "기간", 1)]
    assert (a.n_docs, a.avg_length) == (2, 2.0) and {r.token: r.df for r in a.frequencies.collect()} == {"기간": 2, "등록": 1}
    b = open_index()
    assert a.postings.inputFiles() == b.postings.inputFiles()
    spark.createDataFrame([(9, "새글 안내")], "id long, s string").coalesce(1).write.mode("append").parquet(path)
    assert open_index().n_docs == 3  # another version of the table, another index


def test_scores_are_summed_in_place(spark):
    """Postings are never exchanged: only the best rows of each task are."""
    docs = spark.range(200).select("id", F.concat(F.lit("word "), F.col("id") % 7, F.lit(" other")).alias("s"))
    index = retrieve.Index(docs, "id", F.col("s"), buckets=4)
    q = spark.createDataFrame([(1, "word 3"), (2, "other 5")], "qid long, t string")
    plan = retrieve.best(retrieve.bm25(index, retrieve.query_terms(q, "qid", F.col("t"))), 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in below and "HashAggregate" in below


def test_full_text_in_one_pass(spark):
    random.seed(5)
    words = ["가나", "나다", "ab", "abc", "12", "다라마"]
    docs = [(i, " ".join(random.choice(words) + random.choice(["", "은", "x"]) for _ in range(random.randint(0, 9)))) for i in range(120)] + [(900, None)]
    terms = [(q, t) for q in range(5) for t in random.sample(words, 3)]
    want = {}
    for i, s in docs:
        found = re.findall("[가-힣a-z0-9]+", (s or "").lower())
        for q, t in terms:
            if s and t in s:
                want[q, i] = want.get((q, i), 0) + 0.2 + 0.1 * found.count(t)
    d, t = spark.createDataFrame(docs, "id long, s string"), spark.createDataFrame(terms, "query_id long, token string")
    got = {(r.query_id, r.id): r.score for r in retrieve.full_text(d, "id", F.col("s"), t, block=4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    # With k: whatever can be among the first k, all of a tie, and the same scores.
    part = {(r.query_id, r.id): r.score for r in retrieve.best(retrieve.full_text(d.repartition(3), "id", F.col("s"), t, k=4), 4).collect()}
    for q in range(5):
        mine = sorted((v for (a, _), v in got.items() if a == q), reverse=True)
        floor = mine[min(4, len(mine)) - 1]
        assert {k: v for k, v in part.items() if k[0] == q} == {k: v for k, v in got.items() if k[0] == q and v >= floor}
    assert retrieve.full_text(d, "id", F.col("s"), t.limit(0)).count() == 0


def test_steps_can_be_cleared(spark):
    from quern.session import clear_steps, written
    kept = retrieve.Index(spark.createDataFrame([(1, "등록 기간")], "id long, s string"), "id", F.col("s"), buckets=2)
    path = written(spark.range(3), "x").inputFiles()[0].removeprefix("file://").removeprefix("file:")
    import os
    assert os.path.exists(path)
    clear_steps(spark)
    assert not os.path.exists(path) and kept.postings.count() == 2 and written(spark.range(3)).count() == 3
