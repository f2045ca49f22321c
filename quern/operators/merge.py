"""Keyed maintenance of tables: upsert, replace, history, referential actions, version decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_last_at_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key, placed where the key came first; null keys leave."""
    w = Window.partitionBy(key)
    return (df.where(F.col(key).isNotNull()).withColumn("_first", F.min(pos).over(w)).withColumn("_last", F.max(pos).over(w))
            .where(F.col(pos) == F.col("_last")).withColumn(pos, F.col("_first")).drop("_first", "_last"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] = (), stamp: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``source`` replace or join those of ``target``.  ``keep``: columns a replaced row keeps; ``stamp``:
    values set on every row that ``source`` writes.  Columns missing on one side are null there."""
    stamp = stamp or {}
    s = source
    for c, v in stamp.items():
        s = s.withColumn(c, v)
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        s = s.join(old, keys, "left")
        for c in keep:
            s = s.withColumn(c, F.coalesce(F.col(f"_old_{c}"), F.col(c)) if c in s.columns else F.col(f"_old_{c}")).drop(f"_old_{c}")
    rest = target.join(source.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(s, allowMissingColumns=True)


def insert_absent(history: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """History and those rows of ``source`` whose key it does not hold, of rows with one key the first in ``order``
    (by default of all columns, so the choice does not depend on arrival).  A key with a null is never held: all its
    rows are inserted, as a unique constraint would let them."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    one = latest(source.where(whole), keys, order or [F.col(c).asc_nulls_last() for c in sorted(source.columns)]).unionByName(source.where(~whole))
    source = one
    return history.unionByName(source.join(history.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_groups(target: DataFrame, source: DataFrame, group: str) -> DataFrame:
    """Groups that ``source`` holds are replaced as a whole; groups it does not name stay."""
    return target.join(source.select(group).distinct(), group, "left_anti").unionByName(source, allowMissingColumns=True)


def version_decision(new: DataFrame, old: DataFrame, keys: list[str], hash_col: str = "content_hash", version: str = "version") -> DataFrame:
    """``new`` with change_type (new, unchanged, updated) and its version (1, the old one, the old one plus 1)."""
    o = old.select(*keys, F.col(hash_col).alias("_h"), F.col(version).alias("_v"), F.lit(True).alias("_there"))
    j = new.drop(version).join(o, keys, "left")
    same = F.col("_h").eqNullSafe(F.col(hash_col))
    return (j.withColumn("change_type", F.when(F.col("_there").isNull(), "new").when(same, "unchanged").otherwise("updated"))
            .withColumn(version, F.when(F.col("_there").isNull(), F.lit(1)).when(same, F.coalesce("_v", F.lit(1))).otherwise(F.coalesce("_v", F.lit(0)) + 1).cast("int"))
            .drop("_h", "_v", "_there"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that reference no parent (a null reference is none)."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that stay when parents are deleted with their children."""
    return child.join(parent.select(key), key, "left_semi")


def set_null(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that stay when parents are deleted and references to them are emptied."""
    p = parent.select(F.col(key).alias("_p")).distinct()
    return child.join(p, F.col(key) == F.col("_p"), "left").withColumn(key, F.col("_p")).drop("_p")


def before_stop(df: DataFrame, group: str, pos: str, stop: Column, keep_first: bool = True) -> DataFrame:
    """Rows up to the first that meets ``stop`` (which is kept itself by default)."""
    frame = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1 if keep_first else 0)
    return df.withColumn("_s", F.coalesce(F.max(F.when(stop, 1).otherwise(0)).over(frame), F.lit(0))).where("_s = 0").drop("_s")
