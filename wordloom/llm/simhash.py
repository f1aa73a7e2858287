"""SimHash near-dedup (3): fingerprints of three-word shingles, linked through a byte-position inverted index.

Two fingerprints with at most 3 differing bits agree in at least 5 of their 8 positional bytes. Postings of single
bytes would pair every fingerprint with a 256th of all others, so the index is keyed by 14 sets of four positions chosen
such that any five positions hold one of them: a link can't be missed, and an unrelated pair meets with probability
14 in 2^32. Within a bucket the shared positional bytes of each pair are tallied, pairs under five are dropped, and the
rest are verified by their differing bits. A bucket leaves at most one edge less than it has members.

A bucket over BUCKET fingerprints (a large group of near copies) is split again by the same 14 sets over its free
bits: first nibbles, then pairs of bits. That ends with 8 free bits, so no bucket can hold more than 256 distinct
fingerprints, whatever the data, and no link is lost.

Null or wordless texts have fingerprint zero. A component's id is its smallest doc_id; a null doc_id gets the id of its
component, null if all are null. Repeated rows are each returned; ties don't arise. An empty table gives an empty result,
and columns of the input named like results give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, OWN, byte_rows, release, staged, table, text_batches
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
AGREEING = 5
#: Fingerprints compared at once; at least 256, which the last split guarantees.
BUCKET = 512


def fingerprint_of(text: bytes, block: int = 1 << 18) -> int:
    """A signed 64-bit fingerprint; long texts are hashed in blocks."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), block):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans[at : at + block]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([fingerprint_of(t or b"") for t in byte_rows(texts)], pa.int64())

    return fingerprints(text)


def quadruples(units: list[int]) -> list[int]:
    """Masks of 14 sets of four of eight units, one at least within any five: two halves, and pairs of like matchings."""
    a, b = units[:4], units[4:]
    matchings = lambda x: [((x[0], x[1]), (x[2], x[3])), ((x[0], x[2]), (x[1], x[3])), ((x[0], x[3]), (x[1], x[2]))]
    sets = [a, b] + [[*p, *q] for m, n in zip(matchings(a), matchings(b), strict=True) for p in m for q in n]
    return [sum(s) for s in sets]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def refinements(mask: int, unit_bits: int) -> list[int]:
    """The masks that fix half of the bits which mask leaves free, by eight units of so many bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    units = [sum(1 << i for i in free[k : k + unit_bits]) for k in range(0, len(free), unit_bits)]
    return [mask | m for m in quadruples(units)]


def links(bucket: Column) -> Column:
    """array<struct<a, b>>: the edges of a bucket of at most BUCKET fingerprints."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def linked(buckets: pa.Array) -> pa.Array:
        return pa.array([links_within(b) for b in buckets.to_pylist()], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return linked(bucket)


def links_within(bucket: list[int]) -> list[dict[str, int]]:
    """Edges that connect what is linked within a bucket: shared bytes are tallied, then the differing bits counted."""
    prints = np.array(sorted(set(bucket)), "<i8").view("<u8")
    parts = prints.view(np.uint8).reshape(-1, 8)
    group, out = list(range(len(prints))), []

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i in range(len(prints) - 1):
        tally = (parts[i + 1 :] == parts[i]).sum(axis=1)
        near = np.flatnonzero(tally >= AGREEING) + i + 1
        near = near[np.bitwise_count(prints[near] ^ prints[i]) <= DISTANCE]
        for j in near.tolist():
            if (x := find(i)) != (y := find(j)):
                group[y] = x
                out.append({"a": int(prints[i : i + 1].view("<i8")[0]), "b": int(prints[j : j + 1].view("<i8")[0])})
    return out


def _pairs(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    """Rows of mask and finer. A list would pass through Python workers of another kind, which stay in memory beside the others."""
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("mask", "finer"), zip(*rows, strict=True), strict=True)}))


def near_edges(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b that connect all fingerprints (distinct fp) with at most 3 differing bits."""
    spark, masks, found = prints.sparkSession, [0], []
    rest = prints.select(F.lit(0).cast("long").alias("mask"), "fp")
    for unit_bits in (8, 4, 2):
        step = {m: refinements(m & (1 << 64) - 1, unit_bits) for m in masks}
        finer = _pairs(spark, [(_signed(m), _signed(x)) for m, xs in step.items() for x in xs])  # 2,744 rows at most
        masks = sorted({x for xs in step.values() for x in xs})
        keys = rest.join(F.broadcast(finer), "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")
        keys = keys if unit_bits == 8 else staged(keys.distinct(), "keys")
        sizes = keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = staged(keys.join(sizes, ["mask", "key"]), "shared")
        lists = shared.where(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("bucket"))
        found.append(staged(lists.select(F.inline(links(F.col("bucket")))).distinct(), "links"))
        rest = shared.where(F.col("n") > bucket).select("mask", "fp")
        if rest.isEmpty():
            break
    return _all(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (a signed long) and component_id of each row of documents with doc_id and text."""
    rows, groups = _grouped(docs, ["doc_id"], bucket)
    return rows.join(groups, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, order: list[str], bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Rows with the order's columns and fp; and for each fp what is least in its component by these columns, nulls last."""
    text_batches(docs.sparkSession)
    rows = staged(docs.select(*order, fingerprint(F.col("text")).alias("fp")), "fingerprints")
    least = F.min(F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c)))))
    prints = staged(rows.groupBy("fp").agg(least.alias("first")), "prints")
    stars = components(near_edges(prints, bucket))
    linked = stars.union(stars.select("root", "root").distinct())
    ids = linked.join(prints, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("least"))
    linked = staged(linked.join(staged(ids, "ids"), "root").select(F.col("node").alias("fp"), "least"), "linked")
    return rows, staged(prints.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least")), "whole")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group: that with the smallest doc_id (null last), then the least hash of its columns.

    Rows without a doc_id are in groups like any other, and so are rows with the same doc_id and different texts, each in
    the group of its own text. Of rows that are alike in all columns one stays.
    """
    row, again = f"{OWN}row", f"{OWN}again"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.withColumns({row: F.xxhash64(*columns), again: F.xxhash64(F.lit("second"), *columns)})
    _, groups = _grouped(docs, ["doc_id", row, again])
    keep = staged(groups.select(f"least.{row}", f"least.{again}").distinct(), "keep")
    # Only rows alike in all columns are left for the window to choose from; the join's partitioning serves
    by = Window.partitionBy(row, again).orderBy(F.lit(0))
    kept = docs.join(keep, [row, again], "left_semi").withColumn(f"{OWN}nth", F.row_number().over(by))
    return kept.where(f"{OWN}nth = 1").select(*columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
