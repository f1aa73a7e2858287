"""Search of texts by a positional n-gram index: terms are found by their letters' places, without reading the texts again.

Texts are lower-cased; a gram begins at every letter, the last ones are shorter. Each task lays its texts out one behind the
other in blocks of about BLOCK letters, and writes a row for each gram of a block, with the places where it begins: nothing is
shuffled, and what is written and sorted is a row for each gram and block, not for each letter. A text begins at a multiple of
SLOT, so that its id is found by place; the row of the empty gram has a block's ids. A task's rows are sorted by gram, so that
a look-up reads the pages that can hold its grams and no others, and a gram that all texts have is spread over all tasks' files.

A search has terms, phrases in quotes, OR between alternatives, and - before what must not occur; all else must occur. A
term stands where its grams stand one behind the other, which is exact: the places of all its grams, each less its
distance from the term's beginning, are intersected. Terms shorter than a gram are beginnings of grams. The score is the
number of places at which wanted terms begin. Null and empty texts have no grams; a search without wanted terms finds
nothing; repeated ids are one text, in which all that stands in one of its rows counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import shared_dir

GRAM = 3
#: Letters of a block, but for its last text, and letters that a slot has.
BLOCK, SLOT = 1 << 20, 64


class Wanted(NamedTuple):
    """All of the alternatives' lists must have a hit, and none of the excluded terms."""

    alternatives: list[list[str]]
    excluded: list[str]


def parsed(text: str) -> Wanted:
    alternatives: list[list[str]] = []
    excluded: list[str] = []
    either = False
    for token in re.findall(r'-?"[^"]+"|\S+', text.lower()):
        if token == "or":
            either = bool(alternatives)
        elif token.startswith("-") and len(token) > 1:
            excluded.append(token[1:].strip('"'))
        elif either:
            alternatives[-1].append(token.strip('"'))
            either = False
        else:
            alternatives.append([token.strip('"')])
    return Wanted(alternatives, excluded)


def _block(texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
    """The grams of texts that aren't empty, each one's places in order, and which of the texts each slot belongs to."""
    lengths = np.array([len(t) for t in texts])
    slots = (lengths + GRAM - 1 + SLOT - 1) // SLOT  # no gram begins in one text and ends in the next
    joined = "".join(t.ljust(n, "\0") for t, n in zip(texts, (slots * SLOT).tolist(), strict=True))
    owner = np.repeat(np.arange(len(texts)), slots)
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = (np.cumsum(slots) - slots) * SLOT
    inside = np.arange(len(letters)) < np.repeat(starts + lengths, slots * SLOT)
    # Letters by their place among those of the block, from 1; behind a text's end is 0
    there = np.zeros(0x110000, np.int64)
    there[letters[inside]] = 1
    code = np.where(inside, np.cumsum(there)[letters], 0)
    most = int(code.max()) + 1
    at = np.flatnonzero(inside)
    gram = (code[at] * most + code[at + 1]) * most + code[at + 2]
    if most**3 <= (1 << 63) // len(letters):  # sorting one number is faster
        gram, at = np.divmod(np.sort(gram * len(letters) + at), len(letters))
    else:
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    ends = at[first] + GRAM - (code[at[first] + 1] == 0) - (code[at[first] + 2] == 0)
    grams = [joined[i:end] for i, end in zip(at[first].tolist(), ends.tolist(), strict=True)]
    return grams, pa.ListArray.from_arrays(np.append(first, len(at)).astype(np.int32), at.astype(np.int32)), owner


def _indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index (gram, block, places, ids) from batches of id, text."""
    name = TaskContext.get().partitionId() << 32

    def rows(texts: list[str], ids: pa.Array) -> pa.RecordBatch:
        grams, places, owner = _block(texts)
        of_slots = pa.ListArray.from_arrays(pa.array([0] * (len(grams) + 1) + [len(owner)], pa.int32(), mask=np.arange(len(grams) + 2) < len(grams)), ids.take(pa.array(owner)))
        places = pa.concat_arrays([places, pa.nulls(1, places.type)])
        return pa.RecordBatch.from_arrays([pa.array([*grams, ""]), pa.array([name] * (len(grams) + 1)), places, of_slots], ["gram", "block", "places", "ids"])

    texts: list[str] = []
    ids: list[pa.Array] = []
    letters = 0
    for batch in batches:
        begun = 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            texts.append(text)
            letters += len(text)
            if letters >= BLOCK:
                yield rows(texts, pa.concat_arrays([*ids, batch.column("id").slice(begun, i + 1 - begun)]))
                texts, ids, letters, begun, name = [], [], 0, i + 1, name + 1
        ids.append(batch.column("id").slice(begun))
    if texts:
        yield rows(texts, pa.concat_arrays(ids))


def build_index(texts: DataFrame, path: str) -> None:
    """Writes the index of texts(id, text)."""
    rows = texts.select("id", F.lower("text").alias("text")).where("text <> ''")
    index = rows.mapInArrow(_indexed, f"gram string, block long, places array<int>, ids array<{rows.schema['id'].dataType.simpleString()}>")
    # Of rising places the second version of pages has the differences
    index.sortWithinPartitions("gram", "block").write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(path)


def _pieces(term: str) -> list[tuple[str, int]]:
    """Grams that cover a term, with their distances from its beginning."""
    last = len(term) - GRAM
    return [(term[i : i + GRAM], i) for i in sorted({*range(0, last + 1, GRAM), last})] if last > 0 else [(term, 0)]


def occurrences(index: DataFrame, terms: list[str]) -> DataFrame:
    """term, id, n: at how many places of a text each term begins."""
    wanted = [(t, gram, at, len(_pieces(t))) for t in dict.fromkeys(terms) for gram, at in _pieces(t)]
    whole = sorted({"", *(gram for _, gram, _, _ in wanted if len(gram) == GRAM)})
    short = [gram for _, gram, _, _ in wanted if len(gram) < GRAM]
    fits = F.col("gram").isin(whole)
    for gram in short:
        fits = fits | F.col("gram").startswith(gram)
    looked_up = index.sparkSession.createDataFrame(wanted, "term string, piece string, distance int, pieces int")  # the search's own
    index = index.where(fits)
    found = index.where("gram <> ''").join(F.broadcast(looked_up), F.when(F.length("piece") < GRAM, F.startswith("gram", "piece")).otherwise(F.col("gram") == F.col("piece")))
    starts = F.when(F.col("distance") == 0, F.col("places")).otherwise(F.transform("places", lambda p: p - F.col("distance")))
    of_blocks = found.groupBy("term", "block", "pieces").agg(F.collect_list(starts).alias("starts"))  # of one block
    all_of_them = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    begun = of_blocks.where("pieces = 1 or size(starts) = pieces").select("term", "block", F.when(F.col("pieces") == 1, F.flatten("starts")).otherwise(all_of_them).alias("begun"))
    texts = index.where("gram = ''").select("block", "ids")
    hits = begun.join(texts, "block").select("term", F.explode(F.transform("begun", lambda p: F.get("ids", F.shiftright(p, SLOT.bit_length() - 1)))).alias("id"))
    return hits.groupBy("term", "id").agg(F.count("*").alias("n"))


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """id, score of the texts that a search finds."""
    wanted = parsed(text)
    terms = [t for group in wanted.alternatives for t in group]
    hits = occurrences(spark.read.parquet(path), terms + wanted.excluded)
    count = lambda t: F.coalesce(F.sum(F.when(F.col("term") == t, F.col("n"))), F.lit(0))
    score = sum((count(t) for t in dict.fromkeys(terms)), F.lit(0))
    holds = F.lit(bool(terms))
    for group in wanted.alternatives:
        holds = holds & (sum((count(t) for t in group), F.lit(0)) > 0)
    for t in wanted.excluded:
        holds = holds & (count(t) == 0)
    return hits.groupBy("id").agg(score.alias("score"), holds.alias("holds")).where("holds").drop("holds")


#: No term of it overlaps itself, so that SQL can count by lengths.
SEARCH = '"tion " OR "eau la" en -"the by" -zz'


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
n AS (SELECT doc_id, t, list_transform(['tion ', 'eau la', 'en'], lambda w: (length(t) - length(replace(t, w, ''))) // length(w)) AS c FROM d WHERE NOT contains(t, 'the by') AND NOT contains(t, 'zz'))
SELECT doc_id, CAST(list_sum(c) AS BIGINT) AS score FROM n WHERE c[1] + c[2] > 0 AND c[3] > 0""")
def document_search(spark: SparkSession, sf_dir: str, text: str = SEARCH) -> DataFrame:
    """Documents by a search over their index: phrases, alternatives, a short term and exclusions."""
    path = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), path)
    return search(spark, path, text).withColumnRenamed("id", "doc_id")
