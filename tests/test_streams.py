"""Streams run to their end."""

from datetime import datetime, timedelta

from quern.plans.log_queries import _run
from quern.streaming import jobs


def test_lock_does_not_depend_on_arrow_batches(spark, tmp_path):
    """One user's requests in many small batches and out of order; a request without a user is refused."""
    t0 = datetime(2026, 1, 1)
    rows = [(f"r{i:03d}", "kiosk", t0 + timedelta(seconds=(i * 37) % 200 * 7)) for i in range(200)] + [("none", None, t0)]
    spark.createDataFrame(rows, "request_id string, user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    want, end = set(), None
    for i, _, t in sorted(rows[:200], key=lambda r: (r[2], r[0])):
        if end is None or t >= end:
            want.add(i)
            end = t + timedelta(seconds=20)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        s = jobs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        from pyspark.sql import functions as F
        got = _run(jobs.in_flight(s.withColumn("s", F.lit(20.0)), "user", "ts", "s")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 201 and {r.request_id for r in got if r.accepted} == want
