"""Benchmark decontamination (1): one Aho-Corasick automaton over the normalised words of the benchmark's items.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is 13 consecutive words of an
item (all of them, if it has fewer). The automaton's letters are word numbers, so that a match can only begin and end
with whole words, and each text is scanned once, whatever the number of windows. Matches are kept as word ranges, merged,
and mapped back to character offsets of the original text.

The automaton is one for benchmarks of up to BLOCK_WORDS words. A larger one is read in blocks of that size, so that
neither the driver nor a worker holds more than one, and texts are scanned once for each block; of all blocks but the
last only what they hit is kept, by the text's hash, and joined at the end. Null or wordless texts and items have no words and no windows;
items with the same id are one item; an item without an id marks words but isn't listed. Each row of documents stands
for itself, repeated or not.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import summed_before
from .common import OWN, WORDS, besides, byte_rows, resident, staged, table, text_batches

WINDOW = 13
#: Benchmark words in a block at most (but for one item longer than that): what the driver and each worker hold.
BLOCK_WORDS = 2_000_000

_word = re.compile(rb"[^ ]+")

class Matcher:
    """The automaton of one block. items: (item_id or None, text)."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in text.translate(WORDS).split()]
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        for words, who in owners.items():
            self.automaton.add_word(words, (len(words), frozenset(who)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Number of words; merged ranges of hit words, end exclusive; items with occurring windows."""
        words = text.translate(WORDS).split()
        ranges: list[tuple[int, int]] = []
        items: set[str | None] = set()
        if self.number and words:
            numbers = self.number
            for end, (length, who) in self.automaton.iter(tuple([numbers.get(w, 0) for w in words])):
                ranges.append((end - length + 1, end + 1))
                items |= who
        return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of its words."""
    if not ranges:
        return []
    spans = [m.span() for m in _word.finditer(text.translate(WORDS))]
    where = lambda at: len(text[:at].decode(errors="replace"))
    return [{"start": where(spans[a][0]), "end": where(spans[b - 1][1])} for a, b in ranges]


def _matcher(key: str, items, window: int) -> Matcher:
    return resident(key, lambda: Matcher(items.value, window))


_HITS = "struct<n_words:bigint,ranges:array<struct<start:int,end:int>>,spans:array<struct<start:int,end:int>>,items:array<string>>"


def _hits(text: Column, spark: SparkSession, block: list[tuple[str | None, bytes]], window: int) -> Column:
    text_batches(spark)
    key, items = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

    @F.arrow_udf(_HITS)
    def scanned(texts: pa.Array) -> pa.Array:
        matcher = _matcher(key, items, window)
        rows = []
        for t in byte_rows(texts):
            n, ranges, found = matcher.scan(t or b"")
            rows.append({"n_words": n, "ranges": [{"start": a, "end": b} for a, b in ranges], "spans": offsets(t or b"", ranges), "items": sorted(i for i in found if i is not None)})
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("ranges", span), ("spans", span), ("items", pa.list_(pa.string()))]))

    return scanned(text)


def _blocks(benchmark: DataFrame, block_words: int):
    """The distinct items in blocks of so many words, or of the one item that goes beyond; one block at a time reaches the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    sized = items.withColumn("words", F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    total = sized.agg(F.sum("words")).first()[0] or 0
    if total <= block_words:
        yield 1, [(r.item, r.text.encode()) for r in sized.toLocalIterator()]
        return
    cut = staged(summed_before(sized, "words", [F.xxhash64("item", "text")], into="before").withColumn("block", F.expr(f"before div {block_words}")), "benchmark")
    found = [r.block for r in cut.select("block").distinct().orderBy("block").collect()]
    for k in found:
        yield len(found), [(r.item, r.text.encode()) for r in cut.where(F.col("block") == k).toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "hits") -> DataFrame:
    """docs with a column of struct<n_words, ranges of hit words, spans of characters, items>; ranges of several blocks are merged.

    A column of docs that has its name gives way; all others stay.
    """
    spark, docs, hit = docs.sparkSession, besides(docs, into), []
    for k, (n, block) in enumerate(_blocks(benchmark, block_words), 1):
        found = _hits(F.col("text"), spark, block, window)
        if k == n:
            out = docs.withColumn(into, found)
            break
        one = docs.select("text", found.alias("h")).where(F.size("h.ranges") > 0).select(*_ids(), "h.ranges", "h.spans", "h.items").dropDuplicates([f"{OWN}t1", f"{OWN}t2"])
        hit.append(staged(one, "decontaminate"))
    if not hit:
        return out
    # As many rows for a text as there are blocks at most
    gather = [F.flatten(F.collect_list(x)).alias(f"{OWN}{x}") for x in ("ranges", "spans", "items")]
    others = functools.reduce(DataFrame.union, hit).groupBy(f"{OWN}t1", f"{OWN}t2").agg(*gather)
    joined = out.withColumns({c: x for c, x in zip((f"{OWN}t1", f"{OWN}t2"), _ids(), strict=True)}).join(others, [f"{OWN}t1", f"{OWN}t2"], "left")
    both = lambda x: F.concat(F.col(f"{into}.{x}"), F.coalesce(F.col(f"{OWN}{x}"), F.slice(F.col(f"{into}.{x}"), 1, 0)))
    whole = F.struct(F.col(f"{into}.n_words").alias("n_words"), _merged_column(both("ranges")).alias("ranges"), _merged_column(both("spans")).alias("spans"), F.array_sort(F.array_distinct(both("items"))).alias("items"))
    return joined.withColumn(into, whole).select(*(F.col(f"`{c}`") for c in docs.columns), into)


def _ids() -> tuple[Column, Column]:
    """Two hashes of a text."""
    return F.xxhash64("text").alias(f"{OWN}t1"), F.xxhash64(F.lit("second"), "text").alias(f"{OWN}t2")


def _merged_column(ranges: Column) -> Column:
    """Merged ranges of an array of ranges in any order."""
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort(ranges),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["start"] <= last(acc)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))),
    )


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(F.col(f"{hits}.ranges"), F.lit(0).cast("long"), lambda acc, r: acc + (r["end"] - r["start"]).cast("long"))


def contaminated(hits: str = "hits") -> Column:
    """At least a twentieth of the words are hit, and one at least."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    hits = f"{OWN}hits"
    return contamination(docs, benchmark, into=hits, **options).where(~contaminated(hits)).drop(hits)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "hits.n_words", n_hit().alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
found AS (SELECT doc_id, i, k, item FROM grams JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""
