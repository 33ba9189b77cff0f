"""Sinks: merges of new rows into stored tables, as plans that give the table's next state.

Parquet tables have no MERGE; each function returns the whole next state, keyed by a
natural key, so a rerun gives the same table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_id(*key: str):
    """A deterministic id from a natural key."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key)), 256)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, fill: list[str] | None = None) -> DataFrame:
    """All columns of a key from its newest row; columns in fill keep the old value once there is one (K1, K2, K3)."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc_nulls_last(order))
    oldest = Window.partitionBy(*key).orderBy("_new", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in fill or []:
        rows = rows.withColumn(c, F.first(c, ignorenulls=True).over(oldest))
    return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key is not there yet, each key once (K5)."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children of the given parents are the new ones, all others stay (K6)."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new)


def prune(old: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is still wanted."""
    return old.join(wanted.select(*key).distinct(), key, "left_semi")


def new_ids(listed: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Listed keys that aren't stored."""
    return listed.select(*key).distinct().join(stored, key, "left_anti")


def changed(listed: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Listed rows that are new or whose digest differs."""
    kept = stored.select(F.col(key), F.col(digest).alias("_old"))
    return listed.join(kept, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "doc_id") -> DataFrame:
    """Children whose parent is still there (K7)."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "doc_id") -> DataFrame:
    """Children with references to missing parents set to null (K7)."""
    alive = parents.select(F.col(parent_key).alias("_p")).distinct()
    out = children.join(alive, F.col(child_key) == F.col("_p"), "left")
    return out.withColumn(child_key, F.when(F.col("_p").isNotNull(), F.col(child_key))).drop("_p")


def merge_json(old, new):
    """Keys of the new JSON object over those of the old one, values as they are; null is an empty object (K9).

    The old object's own keys come first, and the keys of each are sorted.
    """
    as_map = lambda c: F.coalesce(F.variant_get(F.parse_json(c), "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    a, b = as_map(old), as_map(new)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    # entries are written one by one, since a null value is a value here
    names = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(F.concat(names(kept), names(b)), ","), F.lit("}"))


def move_source(rows: DataFrame, wrong: str, right: str) -> DataFrame:
    """Rows of a wrong source moved to the right one, unless their external_id is there already."""
    there = rows.where(F.col("source_short") == right).select("external_id")
    moved = rows.where(F.col("source_short") == wrong).join(there, "external_id", "left_anti").withColumn("source_short", F.lit(right))
    return rows.where(F.col("source_short") != wrong).unionByName(moved.select(*rows.columns))


def suffixed(rows: DataFrame, base: str, order: list[str], to: str) -> DataFrame:
    """A unique name for each row: the base, then base-2, base-3 and so on."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn(to, F.when(k == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), k.cast("string"))))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """An export of audited or deleted rows."""
    rows.write.mode("overwrite").json(path)


def md5_of(content: bytes) -> str:
    return hashlib.md5(content).hexdigest()
