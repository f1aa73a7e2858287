"""Tokens of running text by a dictionary: a lattice of all its words over each run, and the cheapest path through it.

A dictionary is a table of surface, cost, pos, lemma, section; a surface may have several entries. Texts are cut into runs
(letters and digits, or one other character), within which nothing has to mark where words end. A path's cost is that of
its words and, if given, of the links between their parts of speech. Each character may also stand alone as unknown, at
UNKNOWN; unknown neighbours of one kind become one token. Of equally cheap paths the one with fewer words wins, then the
one whose last words begin first.

Dictionaries of up to MOST entries are counted, broadcast as a table of prefixes, and walked in Arrow batches; each
distinct run of a batch is solved once. Larger ones are never collected: distinct runs are cut into substrings, those that a
bit table of the surfaces admits are joined with the dictionary, and only the edges found go on. Each run is solved once, and
its tokens go to the blocks of documents that have it, not to its places. Both ways give the same tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.documents import TOKENS_SQL, Corpus, text_batches
from ..plans.registry import query
from ..plans.staging import staged
from .tokens import TOKEN

RUN = r"[\p{L}\p{N}]+|[^\x00-\x20\p{L}\p{N}]"
#: Entries of a dictionary that is broadcast, at most.
MOST = 200_000
#: Cost of a character that no word covers.
UNKNOWN = 6000
_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("text", "pos", "lemma", "section")]))
#: Documents that get their tokens together, and the logarithm of the bits that tell what may be a surface.
TOGETHER, BITS = 1000, 25
_BLOCK, _RUN = "_wordloom_block", "_wordloom_run"


class Entry(NamedTuple):
    text: str
    cost: int
    pos: str | None
    lemma: str | None
    section: str | None


class Lexicon:
    """Entries by surface, with every beginning of a surface present, so that a walk stops where no word can follow."""

    def __init__(self, rows: Iterable[tuple]):
        self.found: dict[str, list[Entry]] = {}
        for r in sorted((Entry(*r) for r in rows if r[0]), key=lambda e: (e.text, e.cost, e.pos or "", e.lemma or "", e.section or "")):
            for k in range(1, len(r.text)):
                self.found.setdefault(r.text[:k], [])
            self.found.setdefault(r.text, []).append(r)

    def beginning(self, run: str, at: int) -> list[Entry]:
        out: list[Entry] = []
        for end in range(at + 1, len(run) + 1):
            hit = self.found.get(run[at:end])
            if hit is None:
                break
            out += hit
        return out


def kind_of(c: str) -> str:
    """Characters of one kind make one unknown token."""
    if c.isdigit():
        return "digit"
    if not c.isalpha():
        return "mark"
    return "hiragana" if "぀" <= c <= "ゟ" else "katakana" if "゠" <= c <= "ヿ" else "kanji" if "一" <= c <= "鿿" else "letter"


def cheapest(run: str, edges: list[list[Entry]], links: dict[tuple[str, str], int]) -> list[tuple[str, str | None, str | None, str | None]]:
    """The tokens of a run, given the entries that begin at each place."""
    # By place and part of speech before it: cost, words, where the last word began, what was before it, and the word
    states: list[dict] = [{} for _ in range(len(run) + 1)]
    states[0][""] = (0, 0, 0, "", None)
    for at, begun in enumerate(edges):
        before = states[at].items()
        if not before:
            continue
        for entry in (*begun, Entry(run[at], UNKNOWN, None, None, None)):
            kind = entry.pos or "" if links else ""
            after = states[at + len(entry.text)]
            for was, (cost, words, *_) in before:
                new = (cost + entry.cost + links.get((was, kind), 0), words + 1)
                if kind not in after or new < after[kind][:2]:
                    after[kind] = (*new, at, was, entry)
    path: list[Entry] = []
    at, kind = len(run), min(states[-1], key=lambda k: (*states[-1][k][:3], k))
    while at:
        *_, at, kind, entry = states[at][kind]
        path.append(entry)
    out: list[tuple] = []
    for e in reversed(path):
        if e.pos is None and e.lemma is None and e.section is None and out and out[-1][1] == "Unknown" and kind_of(out[-1][0][-1]) == kind_of(e.text):
            out[-1] = (out[-1][0] + e.text, "Unknown", out[-1][2] + e.text, None)
        else:
            out.append((e.text, e.pos, e.lemma, e.section) if e.pos is not None else (e.text, "Unknown", e.text, None))
    return out


def _as_tokens(tokens: list[tuple]) -> list[dict]:
    return [dict(zip(("text", "pos", "lemma", "section"), t, strict=True)) for t in tokens]


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def tokenized(docs: DataFrame, dictionary: DataFrame, text: Column, into: str = "tokens", links: dict[tuple[str, str], int] | None = None, most: int = MOST) -> DataFrame:
    """docs with the tokens (text, pos, lemma, section) of a text; a null text has none, not an empty array.

    dictionary has surface, cost, pos, lemma, section; entries without a part of speech or surface are left out. links are
    costs by (pos, pos), few. Whole texts are read; repeated rows each get their tokens; a column named like into gives way,
    and may be what the text is made of.
    """
    spark, links = docs.sparkSession, links or {}
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != into.lower()), runs_of(text).alias(_RUN))
    entries = dictionary.select("surface", F.col("cost").cast("long").alias("cost"), "pos", "lemma", "section").where("surface <> '' and pos is not null").distinct()
    rows = entries.limit(most + 1).collect()
    if len(rows) > most:
        return _by_join(docs, entries, into, links)
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
    made: list[Lexicon] = []  # a worker's own

    @F.arrow_udf(f"array<{TOKEN}>")
    def solved(rows: pa.Array) -> pa.Array:
        if not made:
            made.append(Lexicon(shared.value))
        known: dict[str, list[dict]] = {}
        out = []
        for runs in rows.to_pylist():
            for run in runs or ():
                if run not in known:
                    known[run] = _as_tokens(cheapest(run, [made[0].beginning(run, i) for i in range(len(run))], links))
            out.append(None if runs is None else [t for run in runs for t in known[run]])
        return pa.array(out, _ARROW)

    return docs.withColumn(into, solved(_RUN)).drop(_RUN)


def _cuts(texts: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Substrings of each length: which text's, from where, their hashes of BITS bits, and the length. No text is empty."""
    lengths = np.array([len(t) for t in texts])
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), lengths)
    start = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[of] - start
    at, value = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
    for n in range(1, min(longest, int(lengths.max())) + 1):
        more = left >= n
        of, start, left, at, value = of[more], start[more], left[more], at[more], value[more]
        value = (value ^ letters[at + n - 1]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        yield of, start, (value >> np.uint64(64 - BITS)).astype(np.int64), n


def _bits_of(entries: DataFrame, longest: int) -> np.ndarray:
    """A table of BITS bits, set at the surfaces' hashes; at most 2^(BITS - 5) rows reach the driver."""

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            surfaces = batch.column("surface").to_pylist()
            for of, _, value, n in _cuts(surfaces, longest) if surfaces else ():
                whole = np.array([len(surfaces[i]) for i in of.tolist()], np.int64) == n
                yield pa.RecordBatch.from_arrays([pa.array(value[whole])], ["h"])

    words = entries.select("surface").mapInArrow(hashes, "h long").groupBy(F.expr("h div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 32))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (BITS - 5), np.uint32)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return table


def _by_join(docs: DataFrame, entries: DataFrame, into: str, links: dict[tuple[str, str], int]) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    columns = [c for c in docs.columns if c != _RUN]
    # No run has a zero character
    rows = staged(docs.withColumn(_RUN, F.array_join(_RUN, "\0")).withColumn(_BLOCK, F.expr(f"monotonically_increasing_id() div {TOGETHER}")), "to-tokenize")
    entries = staged(entries, "entries")
    longest = entries.agg(F.max(F.length("surface"))).first()[0] or 0
    bits = spark.sparkContext.broadcast(_bits_of(entries, longest))

    def runs_of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, set()
        for batch in batches:
            for block, text in zip(batch.column(_BLOCK).to_pylist(), batch.column(_RUN).to_pylist(), strict=True):
                if block != last and found:
                    yield pa.RecordBatch.from_arrays([pa.array([last] * len(found)), pa.array(list(found))], [_BLOCK, "run"])
                    found = set()
                last = block
                found.update(text.split("\0"))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(found)), pa.array(list(found))], [_BLOCK, "run"])

    def possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run").to_pylist()
            for of, start, value, n in _cuts(runs, longest) if runs else ():
                hit = np.flatnonzero(bits.value[value >> 5] >> (value & 31).astype(np.uint32) & 1)
                begun = start[hit].tolist()
                of_run = [runs[i] for i in of[hit].tolist()]
                surfaces = [run[i : i + n] for run, i in zip(of_run, begun, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of_run, pa.string()), pa.array(begun, pa.int32()), pa.array(surfaces, pa.string())], ["run", "start", "surface"])

    of_blocks = rows.where(f"{_RUN} <> ''").select(_BLOCK, _RUN).mapInArrow(runs_of_blocks, f"{_BLOCK} long, run string")
    runs = of_blocks.select("run").distinct()
    cuts = runs.mapInArrow(possible, "run string, start int, surface string").withColumn("start", F.col("start") + 1)
    edge = F.struct(F.col("start"), F.length("surface").alias("n"), "cost", "pos", "lemma", "section")
    edges = cuts.join(entries, "surface").groupBy("run").agg(F.sort_array(F.collect_list(edge)).alias("edges"))  # of one run

    @F.arrow_udf(f"array<{TOKEN}>")
    def solved(runs: pa.Array, edges: pa.Array) -> pa.Array:
        out = []
        for run, found in zip(runs.to_pylist(), edges.to_pylist(), strict=True):
            begun: list[list[Entry]] = [[] for _ in run]
            for e in found or ():
                begun[e["start"] - 1].append(Entry(run[e["start"] - 1 : e["start"] - 1 + e["n"]], e["cost"], e["pos"], e["lemma"], e["section"]))
            out.append(_as_tokens(cheapest(run, begun, links)))
        return pa.array(out, _ARROW)

    tokens = runs.join(edges, "run", "left").select("run", solved("run", "edges").alias("t"))
    of_blocks = of_blocks.join(tokens, "run")

    def told(known: pa.Table, texts: pa.Table) -> pa.Table:
        tokens_of = dict(zip(known["run"].to_pylist(), known["t"].to_pylist(), strict=True))
        found = [None if t is None else [x for run in t.split("\0") for x in tokens_of[run]] if t else [] for t in texts[_RUN].to_pylist()]
        return texts.select(columns).append_column(into, pa.array(found, _ARROW))

    schema = docs.select(*(f"`{c}`" for c in columns), F.lit(None).cast(f"array<{TOKEN}>").alias(into)).schema
    return of_blocks.groupBy(_BLOCK).cogroup(rows.groupBy(_BLOCK)).applyInArrow(told, schema)


#: Least uses of a word of the documents that makes it an entry, and its length at least and at most.
USES, SHORT, LONG = 20, 2, 12
#: Cost of a catalogue word.
CATALOGUE = 9000


def corpus_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the tables: words of the catalogue, and frequent words of the documents, cheaper the more they are used."""
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("surface")).distinct()
    listed = words.select("surface", F.lit(CATALOGUE).cast("long").alias("cost"), F.lit("Noun").alias("pos"))
    used = Corpus(spark, sf_dir).tokens().groupBy(F.lower("token").alias("surface")).agg(F.count("*").alias("n"))
    used = used.where(f"n >= {USES} and length(surface) between {SHORT} and {LONG}")
    used = staged(used, "frequent-words")
    total = float(used.agg(F.sum("n")).first()[0] or 1)
    used = used.select("surface", F.floor(1000 * F.log(total / F.col("n"))).cast("long").alias("cost"), F.lit("Verb").alias("pos"))
    return listed.union(used).select("*", F.col("surface").alias("lemma"), F.lit(None).cast("string").alias("section"))


#: Edges by end, then start, so that each one's beginning is settled; states are a list by place, here of cost, words, path and whether its end is unknown.
LATTICE_SQL = rf"""
{TOKENS_SQL},
used AS (SELECT lower(token) AS surface, count(*) AS n FROM tok GROUP BY 1 HAVING count(*) >= {USES} AND length(lower(token)) BETWEEN {SHORT} AND {LONG}),
entries AS (
  SELECT surface, min(cost) AS cost FROM (
    SELECT DISTINCT unnest(string_split(p_name, ' ')) AS surface, {CATALOGUE} AS cost FROM part
    UNION ALL SELECT surface, CAST(floor(1000 * ln(CAST(sum(n) OVER () AS DOUBLE) / n)) AS BIGINT) FROM used) GROUP BY surface),
runs AS (SELECT DISTINCT lower(token) AS run FROM tok),
starts AS (SELECT run, unnest(range(1, length(run) + 1)) AS s FROM runs),
cuts AS (SELECT run, s, unnest(range(1, least(length(run) - s + 1, (SELECT max(length(surface)) FROM entries)) + 1)) AS n FROM starts),
edges AS (
  SELECT run, s, s + n AS e, cost, surface AS w, false AS u FROM (SELECT *, substr(run, s, n) AS surface FROM cuts) JOIN entries USING (surface)
  UNION ALL SELECT run, s, s + 1, {UNKNOWN}, substr(run, s, 1), true FROM starts),
listed AS (SELECT run, list({{'s': s, 'e': e, 'cost': cost, 'w': w, 'u': u}} ORDER BY e, s, u) AS edges FROM edges GROUP BY run),
step AS (
  SELECT run, list_reduce(
    list_concat([[{{'s': 0, 'e': 1, 'cost': CAST(0 AS BIGINT), 'w': '', 'u': false}}]], list_transform(edges, lambda x: [{{'s': x.s, 'e': x.e, 'cost': CAST(x.cost AS BIGINT), 'w': x.w, 'u': x.u}}])),
    lambda a, x: CASE
      WHEN len(a) < x[1].e THEN list_append(a, {{'s': a[x[1].s].s + 1, 'e': x[1].e, 'cost': a[x[1].s].cost + x[1].cost,
        'w': CASE WHEN x[1].u AND a[x[1].s].u AND regexp_full_match(x[1].w, '\pN') = regexp_full_match(right(a[x[1].s].w, 1), '\pN') THEN a[x[1].s].w || x[1].w WHEN x[1].u THEN a[x[1].s].w || '|?' || x[1].w ELSE a[x[1].s].w || '|' || x[1].w END, 'u': x[1].u}})
      WHEN a[x[1].s].cost + x[1].cost < a[x[1].e].cost OR (a[x[1].s].cost + x[1].cost = a[x[1].e].cost AND a[x[1].s].s + 1 < a[x[1].e].s)
      THEN list_append(a[1:x[1].e - 1], {{'s': a[x[1].s].s + 1, 'e': x[1].e, 'cost': a[x[1].s].cost + x[1].cost,
        'w': CASE WHEN x[1].u AND a[x[1].s].u AND regexp_full_match(x[1].w, '\pN') = regexp_full_match(right(a[x[1].s].w, 1), '\pN') THEN a[x[1].s].w || x[1].w WHEN x[1].u THEN a[x[1].s].w || '|?' || x[1].w ELSE a[x[1].s].w || '|' || x[1].w END, 'u': x[1].u}})
      ELSE a END)[-1].w AS path
  FROM listed)
"""


@query(f"WITH {LATTICE_SQL} SELECT doc_id, CAST(sum(len(string_split(path, '|')) - 1) AS BIGINT) AS n_tokens, CAST(sum(len(regexp_extract_all(path, '[|][?]'))) AS BIGINT) AS n_unknown, md5(string_agg(path, '' ORDER BY pos)) AS paths FROM tok JOIN step ON lower(token) = run GROUP BY doc_id")
def tok_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents cut into the dictionary's, with a digest of each document's tokens, unknown ones marked."""
    letters = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", letters.alias("tokens"))
    found = tokenized(docs, corpus_dictionary(spark, sf_dir), F.col("tokens")).where(F.size("tokens") > 0)
    unknown = lambda t: t["pos"] == "Unknown"
    path = F.array_join(F.transform("tokens", lambda t: F.concat(F.when(unknown(t), "|?").otherwise("|"), t["text"])), "")
    return found.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tokens", unknown)).cast("long").alias("n_unknown"), F.md5(path).alias("paths"))
