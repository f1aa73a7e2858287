"""Bulk loads into copy-on-write tables: a load writes the parts it changes beside the old ones, then switches the snapshot.

A table is a folder with data/load=N/part=P, and snapshots/load=N, the list of which load holds each part. Readers take the
last snapshot, which is one file, moved into place when it is whole; so they see a load wholly or not at all, and a broken
load leaves the table as it was and is repeated under the same number. Parts without a change stay where they are.

A row replaces the one with its keys if it is newer; ties stay. Of several incoming rows with the same keys the newest one
counts, then the greatest by all columns. Null keys are equal to each other. Two loads at once: the second to finish
finds its snapshot taken and raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import shared_dir, staged

_SNAPSHOT = "part int, held_by int, load int"


def snapshot(spark: SparkSession, path: str) -> dict[int, int]:
    """The load that holds each part, as of the last load; parts are as many as the table was made with."""
    rows = spark.read.schema(_SNAPSHOT).json(f"{path}/snapshots")
    return {r.part: r.held_by for r in rows.join(rows.agg(F.max("load").alias("load")), "load").collect()}


def last_load(spark: SparkSession, path: str) -> int:
    return spark.read.schema(_SNAPSHOT).json(f"{path}/snapshots").agg(F.max("load")).first()[0]


def _parts(spark: SparkSession, path: str, held: dict[int, int], schema) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*(f"{path}/data/load={load}/part={part}" for part, load in sorted(held.items()))).select(*schema.names)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows with part, and load: which load wrote their part last."""
    held = snapshot(spark, path)
    folders = (f"{path}/data/load={load}/part={part}" for part, load in sorted(held.items()))
    return spark.read.option("basePath", f"{path}/data").parquet(*folders)


def _written(rows: DataFrame, path: str, load: int, keys: tuple[str, ...], held: dict[int, int]) -> None:
    """The changed parts, then the snapshot."""
    spark = rows.sparkSession
    rows.repartitionByRange("part", *keys).write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/load={load}")
    listed = spark.createDataFrame(sorted(held.items()), "part int, held_by int").coalesce(1)
    listed.write.mode("error").json(f"{path}/snapshots/load={load}")


def _newest(incoming: DataFrame, keys: tuple[str, ...], newer: str) -> DataFrame:
    names = [newer, *(c for c in incoming.columns if c not in keys and c != newer)]
    best = incoming.groupBy(*keys).agg(F.max(F.struct(*names)).alias("_x"))
    return best.select(*keys, "_x.*").select(*incoming.columns)


def create(incoming: DataFrame, path: str, keys: tuple[str, ...], newer: str, part: Column) -> None:
    """A new table of the rows, as load 0. part is a number from a bounded range, made of the keys."""
    rows = staged(_newest(incoming, keys, newer).withColumn("part", part.cast("int")), "load")
    held = {r.part: 0 for r in rows.select("part").distinct().collect()}
    _written(rows, path, 0, keys, held)


def load(incoming: DataFrame, path: str, keys: tuple[str, ...], newer: str, part: Column) -> int:
    """Merges the rows into the table and returns the number of the load; parts that nothing changes in aren't written."""
    spark = incoming.sparkSession
    held, number = snapshot(spark, path), last_load(spark, path) + 1
    columns = incoming.columns
    new = staged(_newest(incoming, keys, newer).withColumn("part", part.cast("int")), "load")
    touched = {r.part for r in new.select("part").distinct().collect()}
    old = _parts(spark, path, {p: n for p, n in held.items() if p in touched}, new.schema)
    left, right = old.select(F.struct(*columns).alias("o"), *(F.col(k).alias(f"_{k}") for k in (*keys, "part"))), new.select(F.struct(*columns).alias("i"), *keys, "part")
    same = left["_part"] == right["part"]
    for k in keys:
        same = same & left[f"_{k}"].eqNullSafe(right[k])
    changes = F.col("o").isNull() | F.coalesce(F.col(f"i.{newer}") > F.col(f"o.{newer}"), F.lit(False))
    both = left.join(right, same, "full").select(F.coalesce("part", "_part").alias("part"), F.when(changes, F.col("i")).otherwise(F.col("o")).alias("row"), changes.alias("changed"))
    both = staged(both, "merged")
    changed = {r.part for r in both.where("changed").select("part").distinct().collect()}
    rows = both.where(F.col("part").isin(sorted(changed))).select("row.*", "part")
    _written(rows, path, number, keys, held | {p: number for p in changed})
    return number


@query("""WITH s AS (SELECT s_name AS title, s_nationkey % 9 + 1 AS media_type, s_suppkey, s_acctbal FROM supplier),
old AS (SELECT title, media_type, s_suppkey % 7 AS updated, s_acctbal AS payload FROM s WHERE s_suppkey % 3 <> 0),
new AS (SELECT title, media_type, CASE WHEN media_type < 5 THEN s_suppkey % 5 ELSE -1 END AS updated, s_acctbal + 1 AS payload FROM s WHERE s_suppkey % 4 <> 0 AND (media_type < 5 OR s_suppkey % 3 <> 0)),
m AS (
  SELECT coalesce(o.title, n.title) AS title, coalesce(o.media_type, n.media_type) AS media_type, o.title IS NULL OR coalesce(n.updated > o.updated, false) AS changed,
    o.updated AS ou, n.updated AS nu, o.payload AS op, n.payload AS np
  FROM old o FULL JOIN new n ON o.title = n.title AND o.media_type = n.media_type)
SELECT title, media_type, CASE WHEN changed THEN nu ELSE ou END AS updated, CASE WHEN changed THEN np ELSE op END AS payload, CAST(max(changed::INT) OVER (PARTITION BY media_type) AS INT) AS load FROM m""")
def deck_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works loaded twice into a table with a part for each kind of work; the second load changes some of the kinds."""
    works = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("title", F.col("s_name")).withColumn("media_type", F.col("s_nationkey") % 9 + 1)
    key, kind = F.col("s_suppkey"), F.col("media_type")
    old = works.where(key % 3 != 0).select("title", "media_type", (key % 7).alias("updated"), F.col("s_acctbal").alias("payload"))
    new = works.where((key % 4 != 0) & ((kind < 5) | (key % 3 != 0)))
    new = new.select("title", "media_type", F.when(kind < 5, key % 5).otherwise(F.lit(-1)).alias("updated"), (F.col("s_acctbal") + 1).alias("payload"))
    path = f"{shared_dir(spark)}/decks-{uuid.uuid4().hex}"
    create(old, path, ("title", "media_type"), "updated", kind)
    load(new, path, ("title", "media_type"), "updated", kind)
    return read_table(spark, path).select("title", "media_type", "updated", "payload", "load")
