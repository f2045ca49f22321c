"""What changed between full snapshots of a table.

A key-to-hash index of the last snapshot is kept as a bucketed table in the
shared folder, with the values asked for beside the hash.  A new snapshot is
reduced to one row per key, laid out in the same buckets and joined to the
index bucket by bucket, so neither side moves for the probe.  Old values are
read from the same buckets for changed keys alone.  The changes are written,
then the new layout becomes the index and the former one is removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import remove, shared_folder, written

DEFAULT_BUCKETS = 64


def canonical_hash(c: Column) -> Column:
    """One spelling of a hexadecimal digest: no blanks at either end, no algorithm prefix, lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^sha-?1[:=]\s*|^0x", "")


def last_delivered(df: DataFrame, keys: list[str], hash_col: str, order_col: str, values: list[str] = ()) -> DataFrame:
    """One row per key: hash and values of the row delivered last.

    A null delivery time is the earliest; rows of one time are ordered by hash, then by the values, null first, so
    the result does not depend on the order of arrival.
    """
    last = F.max(F.struct(F.col(order_col).alias("at"), F.col(hash_col).alias("hash"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    return df.groupBy(*keys).agg(last.alias("last")).select(*keys, F.col("last.hash").alias("hash"), *[F.col(f"last.v{i}") for i in range(len(values))])


class SnapshotIndex:
    """Bucketed key-to-hash index of the last snapshot.

    Null keys are dropped on entry (a row without a key names no record); a null
    hash is a value of its own; an empty snapshot removes every key.  ``values``
    names columns whose old value is fetched for changed and removed keys.
    """

    def __init__(self, spark: SparkSession, key: str, hash_col: str, order_col: str, buckets: int = DEFAULT_BUCKETS, values: list[str] = ()):
        self.spark, self.key, self.hash_col, self.order_col, self.buckets, self.values = spark, key, hash_col, order_col, buckets, list(values)
        self.table: str | None = None

    def _store(self, snapshot: DataFrame) -> str:
        name = f"snapshot_index_{uuid.uuid4().hex}"
        rows = (snapshot.where(F.col(self.key).isNotNull()).select(self.key, canonical_hash(F.col(self.hash_col)).alias("_hash"), self.order_col, *[v for v in self.values if v not in (self.key, self.order_col)]))
        # One exchange, into the buckets; the reduction to one row a key finds its keys together.
        reduced = last_delivered(rows.repartition(self.buckets, self.key), [self.key], "_hash", self.order_col, self.values)
        (reduced.write.bucketBy(self.buckets, self.key).sortBy(self.key)
         .format("parquet").option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name))
        return name

    def close(self) -> None:
        """Remove the index."""
        if self.table:
            self._drop(self.table)
        self.table = None

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{shared_folder(self.spark)}/{name}")

    def apply(self, snapshot: DataFrame, with_old: bool = False) -> DataFrame:
        """Change rows ``key, change_type`` of ``snapshot`` against the index (the first call: everything is added),
        after which the snapshot is the index.  ``with_old`` adds ``old_row``: the index's values of each changed key
        as JSON, looked up for those keys alone.  The rows are written before the swap, so neither a later delivery
        nor a change of the delivered files alters them."""
        new_table = self._store(snapshot)
        changes = written(self.probe(new_table, with_old), "changes")
        if self.table:
            self._drop(self.table)
        self.table = new_table
        return changes

    def probe(self, new_table: str, with_old: bool = False) -> DataFrame:
        """Changes of a layout against the index, bucket by bucket."""
        new = self.spark.table(new_table)
        if self.table is None:
            changes = new.select(self.key, F.lit("added").alias("change_type"))
            return changes.withColumn("old_row", F.lit(None).cast("string")) if with_old else changes
        old = self.spark.table(self.table)
        changes = compare(old, new, self.key)
        if not with_old:
            return changes
        row = F.to_json(F.struct(F.col("hash").alias(self.hash_col), *[F.col(f"v{i}").alias(v) for i, v in enumerate(self.values)]))
        gone = changes.where("change_type != 'added'")
        fetched = gone.join(old.select(self.key, row.alias("old_row")), self.key)
        return fetched.unionByName(changes.where("change_type = 'added'"), allowMissingColumns=True)


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full join of two key-to-hash tables; on tables of equal buckets nothing is exchanged."""
    a = old.select(F.col(key).alias("k_old"), F.col("hash").alias("h_old"))
    b = new.select(F.col(key).alias("k_new"), F.col("hash").alias("h_new"))
    j = a.join(b, F.col("k_old") == F.col("k_new"), "full_outer")
    kind = (F.when(F.col("k_old").isNull(), "added").when(F.col("k_new").isNull(), "removed")
            .when(~F.col("h_old").eqNullSafe(F.col("h_new")), "changed"))
    return j.select(F.coalesce("k_new", "k_old").alias(key), kind.alias("change_type")).where("change_type is not null")


def snapshot_changes(df: DataFrame, snapshot_col: str, key: str, hash_col: str, order_col: str, buckets: int = DEFAULT_BUCKETS,
                     values: list[str] = (), with_old: bool = False, missing_is_empty: bool = True) -> DataFrame:
    """Changes of every snapshot after the first: ``snapshot, key, change_type`` [, ``old_row``].

    The snapshots are delivered to one index in the order of their numbers.  A number missing between two counts as
    an empty snapshot, or with ``missing_is_empty`` off as none at all (for numbers such as dates).  Rows without a
    snapshot number or key are no record.  No rows: no changes.
    """
    spark = df.sparkSession
    index = SnapshotIndex(spark, key, hash_col, order_col, buckets, values)
    kind = df.schema[snapshot_col].dataType
    rows = df.where(F.col(key).isNotNull() & F.col(snapshot_col).isNotNull())
    numbers = sorted(r[0] for r in rows.select(snapshot_col).distinct().collect())  # one row a delivery
    steps = []
    for before, number in zip([None, *numbers], numbers):
        if missing_is_empty and before is not None and number - before > 1:
            steps.append(before + 1)  # all of them removed; the numbers up to the next delivery change nothing more
        steps.append(number)
    out = None
    for at, number in enumerate(steps):
        changes = index.apply(rows.where(F.col(snapshot_col) == F.lit(number).cast(kind)), with_old)
        if at == 0:
            continue
        step = changes.select(F.lit(number).cast(kind).alias(snapshot_col), *changes.columns)
        out = step if out is None else out.unionByName(step)
    index.close()
    if out is None:
        out = rows.where("false").select(snapshot_col, key, F.lit("").alias("change_type"), *([F.lit("").alias("old_row")] if with_old else []))
    return out
