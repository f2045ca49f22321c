"""Structured Streaming jobs. Each returns a streaming DataFrame or starts a query on one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.merge import latest, upsert


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files: int = 100) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def window_counts(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per kind and window of event time; rows later than ``late`` are let go by the watermark."""
    return (events.withWatermark(ts, late).groupBy(F.window(ts, size), kind)
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total"))


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return (events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"))
            .select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"))


def first_requests(log: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """Each request once, in spite of double logging, within the watermark."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def in_flight(requests: DataFrame, user: str, started: str, seconds: str, expire: bool = False) -> DataFrame:
    """Per-user lock: a request is refused while an earlier accepted one of its user is under way, or without a user.

    A trigger's requests of one user are numbers of a few bytes and held together; a source with ``maxFilesPerTrigger``
    bounds them.  State: end of the last accepted request of each user (one number), with ``expire`` dropped a day after it - for
    streams that go on; a stream run to its end has no time to pass."""
    def step(key, batches, state):
        end = state.get[0] if state.exists else 0.0
        # A user's requests of a trigger come in several Arrow batches, in no order: they are put in order as a whole.
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "request_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            ok = bool(r.user_id) and r.t >= end
            if ok:
                end = r.t + r.s
            out.append((r.request_id, r.user_id, ok))
        if expire and state.hasTimedOut:
            state.remove()
        else:
            state.update((end,))
            if expire:
                state.setTimeoutDuration(86_400_000)
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at:at + 10_000], columns=["request_id", "user_id", "accepted"])

    rows = requests.select("request_id", F.coalesce(user, F.lit("")).alias("user_id"), F.col(started).cast("timestamp").cast("double").alias("t"), F.col(seconds).cast("double").alias("s"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "request_id string, user_id string, accepted boolean", "end double", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


def upsert_stream(source: DataFrame, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps a parquet table of the latest row per key. Each micro-batch writes the next version of the table under
    its own number, so a repeated batch writes the same folder again and readers take the highest one."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, [F.desc_nulls_last(order)])
        old = _last_version(spark, table, number)
        merged = new if old is None else upsert(old, new, keys)
        merged.write.mode("overwrite").parquet(f"{table}/v={number:09d}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_version(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    numbers = [int(x.getPath().getName()[2:]) for x in fs.listStatus(path) if x.getPath().getName().startswith("v=")]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{table}/v={max(numbers):09d}") if numbers else None


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    df = _last_version(spark, table)
    if df is None:
        raise FileNotFoundError(table)
    return df
