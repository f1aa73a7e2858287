"""Sharding (12): shards of near equal bytes, as ranges of a key cut at sampled splitters.

Rows are ordered by a hash of their text, then doc_id; so shards mix sources and lengths, and equal texts stand together.
Splitters come from a sample of keys in which a row is drawn with a chance by its size: quantiles of it cut the table into
many more ranges than there are shards. The exact bytes and rows of each range are counted; a range with too much of
either (a large group of copies, very many short texts) is cut again at splitters of a sample of its own, between rows of
equal text too. Within a range, places and bytes are running sums, and the ranges before are added to them; so the sample
decides only how the work is spread, and the bytes before a row are exact.

A row belongs to the shard in which the middle of its bytes falls; a group of equal texts goes as a whole by its own
middle, unless it has over a hundredth of a shard's bytes, in which case its rows are placed one by one. So a shard
differs from the mean by the larger of a hundredth and of the longest row at most.

A null text has no bytes and is like an empty one. Null doc_ids come first; repeated rows are placed each, in turn. A text
longer than a shard fills it by itself, and shards may stay empty in small tables. An empty table gives an empty result.
Other columns are kept if asked for; those named like results give way.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, besides, release, staged, table

SHARDS = 24
#: Added to each row's bytes.
ROW_BYTES = 8
#: Equal texts stay together up to this part of a shard's bytes.
WHOLE = 100
#: Ranges for a shard at least, rows of a range in large tables, and sampled rows for a range (as expected; at most).
RANGES, RANGE_ROWS, SAMPLE = 8, 1_000_000, 32
#: Times that ranges are cut again at most; what is left over its share then costs time, not exactness.
ROUNDS = 8

Splitter = tuple[int, int, int]
_LEAST = -(2**63)
_KEY, _ID, _TIE, _RANGE = f"{OWN}key", f"{OWN}id", f"{OWN}tie", f"{OWN}range"


def quantiles(sample: list[tuple[Splitter, float]], pieces: int) -> list[Splitter]:
    """Keys that cut a weighted sample into pieces of like weight; each begins a piece."""
    sample = sorted(sample)
    ends = list(accumulate(w for _, w in sample))
    cuts, k = [], 1
    for (key, w), end in zip(sample, ends, strict=True):
        if end - w / 2 >= k * ends[-1] / pieces:
            cuts.append(key)
            k = int((end - w / 2) * pieces / ends[-1]) + 1
    return cuts


def _with_range(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """rows with the number of splitters up to their key."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def number(keys: pa.Array, ids: pa.Array, ties: pa.Array) -> pa.Array:
        release()
        cuts = shared.value
        firsts, own = np.array([k for k, *_ in cuts], "int64"), keys.to_numpy()
        low, high = np.searchsorted(firsts, own, "left"), np.searchsorted(firsts, own, "right")
        for i in np.flatnonzero(low < high).tolist():  # rows whose text a range begins with, or within
            low[i] = bisect_right(cuts, (keys[i].as_py(), ids[i].as_py(), ties[i].as_py()))
        return pa.array(low.astype("int32"))

    return rows.withColumn(_RANGE, number(_KEY, _ID, _TIE))


def _chance(salt: int):
    """A number from 0 to 1 of each row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), _KEY, _ID, _TIE), 11) / float(2**53)


def cut(rows: DataFrame, shards: int) -> tuple[list[Splitter], dict[int, tuple[int, int]]]:
    """Splitters of ranges that are small enough, and the exact (bytes, rows) of each range. The driver gets samples and counts by range."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return [], {}
    ranges = max(RANGES * shards, -(-n // RANGE_ROWS))
    drawn = F.least(F.lit(1.0), F.col("size") * (ranges * SAMPLE / total))
    sample = rows.select(_KEY, "size", drawn.alias("p")).where(_chance(0) < F.col("p")).collect()
    splitters = sorted(set(quantiles([((r[_KEY], _LEAST, _LEAST), r["size"] / r["p"]) for r in sample], ranges)))
    for salt in range(1, ROUNDS + 1):
        ranged = _with_range(rows, splitters)
        counts = {r[_RANGE]: r for r in ranged.groupBy(_RANGE).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).collect()}
        share = {i: max((r["bytes"] - r["most"]) * ranges / total, r["rows"] * ranges / n) for i, r in counts.items() if r["rows"] > 1}
        overfull = {i: x for i, x in share.items() if x > 2}
        if not overfull or salt == ROUNDS:
            break
        # Within them bytes and rows count alike
        limits = [(i, float(counts[i]["bytes"]), float(counts[i]["rows"]), SAMPLE * 2.0**salt * x) for i, x in overfull.items()]
        limits = rows.sparkSession.createDataFrame(limits, f"{_RANGE} int, bytes double, n double, wanted double")
        weight = F.col("size") / F.col("bytes") + 1 / F.col("n")
        picked = ranged.join(F.broadcast(limits), _RANGE).withColumn("w", weight).withColumn("p", F.least(F.lit(1.0), F.col("w") * F.col("wanted") / 2))
        drawn_of: dict[int, list] = {}
        for r in picked.where(_chance(salt) < F.col("p")).select(_RANGE, _KEY, _ID, _TIE, "w", "p").collect():
            drawn_of.setdefault(r[_RANGE], []).append(((r[_KEY], r[_ID], r[_TIE]), r["w"] / r["p"]))
        more = {s for i, found in drawn_of.items() for s in quantiles(found, int(overfull[i]) + 1)}
        splitters = sorted({*splitters, *more})
    return splitters, {i: (r["bytes"], r["rows"]) for i, r in counts.items()}


def sharded(docs: DataFrame, shards: int = SHARDS, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns with size, text_crc32, shard and slot (from 0, without gaps, within a shard)."""
    spark, taken = docs.sparkSession, ("size", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    key = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    own = [F.col(f"`{c}`") for c in columns if c.lower() not in taken]
    rows = docs.select(*own, size.alias("size"), F.crc32(text).alias("text_crc32"), key.alias(_KEY), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias(_ID), F.monotonically_increasing_id().alias(_TIE))
    rows = staged(rows, "sizes")
    splitters, counts = cut(rows, shards)
    total = sum(b for b, _ in counts.values()) or 1
    before, at, nth = [], 0, 0
    for i in sorted(counts):
        before.append((i, at, nth))
        at, nth = at + counts[i][0], nth + counts[i][1]
    starts = spark.createDataFrame(before, f"{_RANGE} int, {OWN}bytes long, {OWN}rows long")  # a row for each range
    ordered = Window.partitionBy(_RANGE).orderBy(_KEY, _ID, _TIE)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_range(rows, splitters).withColumn("a", F.coalesce(F.sum("size").over(so_far), F.lit(0))).withColumn("i", F.row_number().over(ordered) - 1)
    alike = Window.partitionBy(_RANGE, _KEY)
    placed = placed.withColumn("group_size", F.sum("size").over(alike)).withColumn("group_a", F.min("a").over(alike)).join(F.broadcast(starts), _RANGE)
    start, group_start = F.col("a") + F.col(f"{OWN}bytes"), F.col("group_a") + F.col(f"{OWN}bytes")
    placed = placed.select(*besides(rows, _ID, _TIE).columns, start.alias(f"{OWN}start"), (F.col("i") + F.col(f"{OWN}rows")).alias(f"{OWN}nth"), "group_size", group_start.alias("group_start"))
    placed = staged(placed, "places")
    parted = sorted({k for k, i, _ in splitters if i != _LEAST})  # texts that a splitter parts: two for a range at most
    if parted:
        of = spark.createDataFrame([(k,) for k in parted], f"{_KEY} long")
        whole = placed.join(F.broadcast(of), _KEY).groupBy(_KEY).agg(F.sum("size").alias(f"{OWN}size"), F.min(f"{OWN}start").alias(f"{OWN}first"))
        placed = placed.join(F.broadcast(whole), _KEY, "left").withColumn("group_size", F.coalesce(f"{OWN}size", "group_size")).withColumn("group_start", F.coalesce(f"{OWN}first", "group_start"))
    together = F.col("group_size") * (WHOLE * shards) <= total
    twice = F.when(together, 2 * F.col("group_start") + F.col("group_size")).otherwise(2 * F.col(f"{OWN}start") + F.col("size"))
    placed = placed.withColumn(f"{OWN}twice", twice * shards).withColumn("shard", F.expr(f"cast({OWN}twice div {2 * total} as int)"))
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min(f"{OWN}nth").alias("first")).collect()}  # a row for each shard
    slots = spark.createDataFrame(list(firsts.items()), f"shard int, {OWN}slot long")
    out = placed.join(F.broadcast(slots), "shard")
    return out.select(*own, "size", "text_crc32", "shard", (F.col(f"{OWN}nth") - F.col(f"{OWN}slot")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder for each shard, in the order of slots."""
    kept = tuple(c for c in docs.columns)
    rows = sharded(docs, shards, kept)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
b AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
d AS (
  SELECT doc_id, strlen(b.t) + {ROW_BYTES} AS size, CAST('0x' || substr(sha256(b.t), 1, 15) AS BIGINT) AS k,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT))), lambda c, y: xor(c // 256, tab.t[xor(c % 256, y) + 1])), 4294967295) AS crc
  FROM b, tab),
o AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS a, row_number() OVER (ORDER BY k, doc_id) AS nth,
    CAST(sum(size) OVER () AS BIGINT) AS total, CAST(sum(size) OVER (PARTITION BY k) AS BIGINT) AS gs
  FROM d),
g AS (SELECT *, min(a) OVER (PARTITION BY k) AS ga FROM o),
s AS (SELECT *, CASE WHEN gs * {WHOLE * SHARDS} <= total THEN 2 * ga + gs ELSE 2 * a + size END * {SHARDS} // (2 * total) AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""
