"""Language ID (2): interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts become streams of lower-case letters (as UTF-16 units, so that all letters differ) with single spaces between
words. The four-letter counts of the learning documents are summed by Spark, and so is all that Kneser-Ney makes of them:
lower orders are continuation counts, from the distinct strings one longer; each order has a discount from its counts of
one and two; each string gets its discounted share, each context the weight of its lower order. No string is dropped, so
the model grows with the corpus.

A model of up to BROADCAST bytes is put into one sorted array of hashes for each order, with the interpolated log
probabilities in all languages, and scores texts where they are; strings not seen back off through a like array of
contexts. A larger one stays a table: the distinct strings of the texts are joined with it, and then with the texts'
counts. Both give the same. The language with the lowest cross-entropy per letter is chosen, of equal ones the first by
name.

Every learning document is either counted or calibrates (CALIBRATION), whatever their number, by sums and quantiles that
Spark makes: a temperature is fitted by the likelihood of those that calibrate and
turns cross-entropies into the score, a probability. Rejection is by how far a text's cross-entropy is above its
language's mean, in deviations that have a part for short texts; the limit is such that of the calibration documents
REJECTED are rejected, with a margin. A text beyond it is rejected as in none of the languages.

Null texts and texts without a letter are `und` with score 0, and so is every text if no language can be learned.
Repeated rows are each predicted; other columns pass through, those named like results give way; whole texts are scored.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, besides, release, resident, staged, struct, table, text_batches, text_rows

ORDER = 4
#: One of so many learning documents is kept out of the model and calibrates it; all others are counted.
CALIBRATION = 5
#: Ranks of quantiles by which a limit is found are right to one in so many rows.
ACCURACY = 100_000
#: Share of calibration documents beyond the limit of rejection, and the margin it is multiplied by.
REJECTED, MARGIN = 0.002, 1.25
#: The limit in deviations is this at least: fewer calibration documents than 1 / REJECTED don't tell.
LEAST_LIMIT = 5.0
#: Bytes of a model's arrays up to which they are broadcast.
BROADCAST = 256 << 20

_EDGE, _BLANK = 1, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """A code for each code point: letters and marks have that of their lower case, all else is blank."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or (c > 0x2FF and unicodedata.category(ch)[0] == "M"):
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0] = _EDGE
    return out


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit strings of four units, one for each place of each text, and the index of the text."""
    joined = "\0\0\0" + "\0\0\0".join(t.replace("\0", " ") for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = codes == _BLANK
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (codes[:-1] == _EDGE)))
    codes = codes[keep]
    if (wide := codes > 0xFFFF).any():  # two units for a letter beyond 16 bits
        codes = np.repeat(codes, 1 + wide)
        second = np.flatnonzero(np.repeat(wide, 1 + wide))[1::2]
        beyond = codes[second] - 0x10000
        codes[second - 1], codes[second] = 0xD800 + (beyond >> 10), 0xDC00 + (beyond & 0x3FF)
    edge = codes == _EDGE
    owner = np.cumsum(edge) // 3 - 1
    units = codes.astype(np.uint64)
    keys = units.copy()
    for k in range(1, ORDER):
        keys[k:] |= units[:-k] << np.uint64(16 * k)
    return keys[~edge], owner[~edge]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _blocks(texts: Iterable, size: int = 400_000) -> Iterator[list]:
    """Items in blocks of about so many characters; the text is the last field of an item."""
    block, held = [], 0
    for x in texts:
        block.append(x)
        held += len(x[-1])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's strings, summed within the task as far as memory allows."""
    release()
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows() -> Iterator[tuple[str, str]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), text_rows(batch.column(1)), strict=True)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def out(lang: str, parts: list) -> pa.RecordBatch:
        keys, counts = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "key", "n"])

    for block in _blocks(rows()):
        by: dict[str, list[str]] = {}
        for lang, text in block:
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            parts = held.setdefault(lang, [])
            parts.append(counted(streams(texts)[0]))
            if not len(parts[-1][0]):
                parts.pop()  # empty texts only
                continue
            if sum(len(k) for k, _ in parts) > 1_000_000:
                parts[:] = [summed(parts)]
            if len(parts[0][0]) > 500_000:
                yield out(lang, parts)
                parts.clear()
    for lang, parts in held.items():
        if parts:
            yield out(lang, parts)


def string_counts(labelled: DataFrame) -> DataFrame:
    """lang, key, n over all of labelled(lang, text)."""
    text_batches(labelled.sparkSession)
    found = labelled.select("lang", "text").mapInArrow(_count, "lang string, key long, n long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * order) - 1)


def _hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return (keys ^ np.uint64(order)) * _ODD


def tables(counts: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Of counts(lang, key, n): parts(order, lang, key, value), weights(order, lang, key, value) by context, and each language's number of letters."""
    now, parts, weights, letters = staged(counts, "strings"), [], [], {}
    for order in range(ORDER, 0, -1):
        ones = now.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.count("*").alias("types")).collect()  # a row for each language
        letters = {r.lang: r.types for r in ones}
        if not ones:
            break
        discounts = {r.lang: r.ones / (r.ones + 2 * r.twos) if r.ones and r.twos else 0.5 for r in ones}
        discount = F.element_at(F.create_map(*(F.lit(x) for pair in discounts.items() for x in pair)), F.col("lang"))
        keyed = now.withColumn("context", F.shiftrightunsigned("key", 16))
        sums = keyed.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        parts.append(keyed.join(sums, ["lang", "context"]).select(F.lit(order).alias("order"), "lang", "key", (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")).alias("value")))
        weights.append(sums.select(F.lit(order).alias("order"), "lang", F.col("context").alias("key"), (discount * F.col("types") / F.col("total")).alias("value")))
        if order > 1:  # continuation counts: of how many distinct longer strings each is the end
            now = staged(now.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("key")).agg(F.count("*").alias("n")), "strings")
    whole = lambda frames, name: staged(functools.reduce(DataFrame.union, frames), name)
    return (whole(parts, "parts"), whole(weights, "weights"), letters) if letters else (counts, counts, {})


def arrays(parts, weights, letters: dict[str, int]) -> dict:
    """The sorted hash arrays of pandas frames parts and weights(order, lang, key, value)."""
    langs = sorted(letters)

    def own(frame, order: int, lang: str) -> tuple[np.ndarray, np.ndarray]:
        rows = frame[(frame.order == order) & (frame.lang == lang)]
        keys = rows.key.to_numpy().view(np.uint64)
        by = np.argsort(keys)
        return keys[by], rows.value.to_numpy()[by]

    share = {(o, x): own(parts, o, x) for o in range(1, ORDER + 1) for x in langs}
    lower = {(o, x): own(weights, o, x) for o in range(1, ORDER + 1) for x in langs}

    def probability(x: str, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1 / (letters[x] + 1))
        weight = _found(*lower[order, x], keys >> np.uint64(16), 1.0)
        return _found(*share[order, x], keys, 0.0) + weight * probability(x, _suffix(keys, order - 1), order - 1)

    def hashed(keys: np.ndarray, order: int, values) -> tuple[np.ndarray, np.ndarray]:
        logs = np.stack([np.log2(values(x)) for x in langs], axis=1).astype(np.float32)
        by = np.argsort(_hashed(keys, order))
        return _hashed(keys, order)[by], logs[by]

    orders, contexts = [], []
    for o in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([share[o, x][0] for x in langs]))
        orders.append(hashed(keys, o, lambda x, keys=keys, o=o: probability(x, keys, o)))
        keys = np.unique(np.concatenate([lower[o, x][0] for x in langs]))
        contexts.append(hashed(keys, o, lambda x, keys=keys, o=o: _found(*lower[o, x], keys, 1.0)))
    floor = np.log2([1 / (letters[x] + 1) for x in langs]).astype(np.float32)
    return {"langs": langs, "orders": orders, "contexts": contexts, "floor": floor}


def _found(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], otherwise)


def log_probabilities(model: dict, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bits of each string's last letter after its others, by language: a lookup, or the context's weight and one order less."""
    if order == 0:
        return np.broadcast_to(model["floor"], (len(keys), len(model["langs"])))
    hashes, logs = model["orders"][order - 1]
    wanted = _hashed(keys, order)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    out = logs[at]
    if len(missing := np.flatnonzero(hashes[at] != wanted)):
        known, weights = model["contexts"][order - 1]
        context = _hashed(keys[missing] >> np.uint64(16), order)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        weight = np.where((known[at] == context)[:, None], weights[at], np.float32(0))
        out[missing] = weight + log_probabilities(model, _suffix(keys[missing], order - 1), order - 1)
    return out


def cross_entropies(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per letter of each text in each language, and the number of letters (with blanks); 0 letters if it has no letter."""
    keys, owner = streams(texts)
    bits = -log_probabilities(model, keys)
    n = np.bincount(owner, minlength=len(texts))
    has_letter = np.bincount(owner, _suffix(keys, 1) != _BLANK, minlength=len(texts)) > 0
    total = np.stack([np.bincount(owner, bits[:, k], minlength=len(texts)) for k in range(len(model["langs"]))], axis=1)
    n = np.where(has_letter, n, 0)
    return total / np.maximum(n, 1)[:, None], n


def with_bits(docs: DataFrame, model: dict) -> DataFrame:
    """docs with their cross-entropies by language, array<double>, and their letters, long, under names of our own."""
    return _by_arrays(docs, model) if model["arrays"] else _by_joins(docs, model)


_BITS, _N = f"{OWN}bits", f"{OWN}letters"


def _by_arrays(docs: DataFrame, model: dict) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model["arrays"])  # BROADCAST bytes at most

    @F.arrow_udf("struct<bits:array<double>,letters:bigint>")
    def judged(texts: pa.Array) -> pa.Array:
        own, bits, letters = resident(key, lambda: shared.value), [], []
        for block in _blocks((t or "",) for t in text_rows(texts)):
            entropy, n = cross_entropies(own, [t for (t,) in block])
            bits += entropy.tolist()
            letters += n.tolist()
        return struct(bits=(bits, pa.list_(pa.float64())), letters=(letters, pa.int64()))

    return docs.withColumn(f"{OWN}j", judged(F.col("text"))).select("*", F.col(f"{OWN}j.bits").alias(_BITS), F.col(f"{OWN}j.letters").alias(_N)).drop(f"{OWN}j")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1, t2, key, n: the counts of each text's strings."""
    release()
    for batch in batches:
        for t1, t2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_rows(batch.column(2)), strict=True):
            keys, n = counted(streams([text])[0])
            yield pa.RecordBatch.from_arrays([pa.array([t1] * len(keys), pa.int64()), pa.array([t2] * len(keys), pa.int64()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["t1", "t2", "key", "n"])


def _by_joins(docs: DataFrame, model: dict) -> DataFrame:
    """The same for a model of any size: each distinct string is looked up once, by joins, and each distinct text summed once."""
    langs, letters = model["langs"], model["letters"]
    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    text_batches(docs.sparkSession)
    texts = docs.where("text is not null").select(t1.alias("t1"), t2.alias("t2"), "text").dropDuplicates(["t1", "t2"])
    strings = staged(texts.mapInArrow(_strings, "t1 long, t2 long, key long, n long"), "text-strings")
    rows = strings.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, langs))).alias("lang"))
    of = F.element_at(F.create_map(*(F.lit(x) for lang in langs for x in (lang, 1 / (letters[lang] + 1)))), F.col("lang"))
    part = lambda order, key: (F.col("key") if order == ORDER else F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))).alias(key)
    for order in range(1, ORDER + 1):
        mine = lambda name, into: model[name].where(F.col("order") == order).select("lang", F.col("key").alias("at"), F.col("value").alias(into))  # noqa: B023, E731
        rows = rows.withColumn("at", part(order, "at")).join(mine("parts", "part"), ["lang", "at"], "left")
        rows = rows.withColumn("at", F.shiftrightunsigned("at", 16)).join(mine("weights", "weight"), ["lang", "at"], "left")
        below = of if order == 1 else F.col("p")
        rows = rows.withColumn("p", F.coalesce("part", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * below).drop("part", "weight", "at")
    logs = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lang", F.log2("p").alias("log")))).alias("logs"))  # one entry for each language
    found = strings.join(staged(logs, "logs"), "key").groupBy("t1", "t2").agg(
        F.sum("n").alias("n"), F.max(F.col("key").bitwiseAND(F.lit(0xFFFF)) != _BLANK).alias("has"), F.array(*(F.sum(-F.col("n") * F.get("logs", F.lit(i))["log"]) for i in range(len(langs)))).alias("total")
    )
    found = found.select(F.col("t1").alias(f"{OWN}t1"), F.col("t2").alias(f"{OWN}t2"), F.when(F.col("has"), F.col("n")).otherwise(0).alias(_N), F.transform("total", lambda x: x / F.col("n")).alias(_BITS))
    joined = docs.withColumns({f"{OWN}t1": t1, f"{OWN}t2": t2}).join(found, [f"{OWN}t1", f"{OWN}t2"], "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(_BITS, F.array_repeat(F.lit(0.0), len(langs))).alias(_BITS), F.coalesce(_N, F.lit(0)).cast("long").alias(_N))


def learning(docs: DataFrame) -> DataFrame:
    """Documents to learn from: with a language and text, and not held out."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, calibration: int = CALIBRATION, broadcast: int = BROADCAST) -> dict | None:
    """The calibrated model of docs(doc_id, text, lang), or None if they have nothing to learn from."""
    known = learning(docs)
    kept = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(calibration)) == 0, F.lit(False))
    parts, weights, letters = tables(string_counts(known.where(~kept)))
    if not letters:
        parts, weights, letters = tables(string_counts(known))  # so few documents that all of them calibrate
    if not letters:
        return None
    model = {"langs": sorted(letters), "letters": letters, "parts": parts, "weights": weights, "arrays": None}
    if (parts.count() + weights.count()) * (8 + 4 * len(letters)) <= broadcast:
        rows = [x.select(F.col("order").cast("byte").alias("order"), "lang", "key", F.col("value").cast("double").alias("value")).toArrow().to_pandas(strings_to_categorical=True) for x in (parts, weights)]
        model["arrays"] = arrays(*rows, letters)
    judged = with_bits(known.where(kept).select("lang", "text"), model).select("lang", F.col(_BITS).alias("bits"), F.col(_N).alias("n"))
    return model | calibrated(model["langs"], judged)


def calibrated(langs: list[str], judged: DataFrame) -> dict:
    """Temperature, and means, deviations and limit for rejection, of all rows of judged(lang, bits, n): cross-entropies by language, and letters."""
    own = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    # Staged before n is looked at: a filter on it would be pushed below, and judge each text a second time, by workers of its own
    rows = staged(judged.where(F.col("lang").isin(langs)).select(own.alias("own"), "bits", "n"), "calibration").where("n > 0")
    grid = np.geomspace(1, 1e5, 201)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_row = np.zeros(len(grid)), False
        for batch in batches:
            k, bits, n = np.array(batch.column(0)), np.array(batch.column(1).flatten()).reshape(-1, len(langs)), np.array(batch.column(2), float)
            excess, any_row = (bits - bits[np.arange(len(k)), k][:, None]) * n[:, None], any_row or len(k) > 0
            sums += [np.logaddexp2.reduce(np.clip(-excess / t, -1e6, 1e6), axis=1).sum() for t in grid]
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(sums)], names=["i", "loss"])

    best = rows.mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).orderBy("loss", "i").first()
    by_language = lambda values, otherwise: [float(values.get(k, otherwise)) for k in range(len(langs))]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("own") + 1)
    half = lambda x: F.percentile_approx(x, 0.5, ACCURACY)
    right = rows.where(F.array_position("bits", F.array_min("bits")) == F.col("own") + 1).select("own", "n", F.element_at("bits", F.col("own") + 1).alias("b"))
    median = by_language(dict(right.groupBy("own").agg(half("n")).collect()), 1)  # a row for each language, as below
    long, short = F.col("n") >= of(median), F.col("n") <= of(median)
    mean = by_language(dict(right.where(long).groupBy("own").agg(half("b")).collect()), 8)
    off = F.col("b") - of(mean)
    spreads = right.groupBy("own").agg(half(F.when(long, F.abs(off))).alias("far"), half(F.when(short, F.abs(off) * F.sqrt("n"))).alias("near")).collect()
    far, near = ([max(1.4826 * x, least) for x in by_language({r.own: r[name] for r in spreads}, 0)] for name, least in (("far", 0.02), ("near", 0.5)))
    z = off / F.sqrt(F.pow(of(far), 2) + F.pow(of(near), 2) / F.col("n"))
    limit = right.agg(F.percentile_approx(z, 1 - REJECTED, ACCURACY)).first()[0]
    return {"temperature": float(grid[best.i]) if best else 1.0, "mean": mean, "far": far, "near": near, "limit": max((limit or 0.0) * MARGIN, LEAST_LIMIT)}


def _judged(docs: DataFrame, model: dict) -> tuple[DataFrame, Column, Column, Column]:
    """docs with their cross-entropies; language, score and whether they are rejected."""
    judged, n = with_bits(docs, model), F.col(_N)
    least = F.array_min(_BITS)
    place = F.array_position(_BITS, least).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), place)
    odds = F.aggregate(F.transform(_BITS, lambda b: F.pow(F.lit(2.0), F.greatest((least - b) * n / model["temperature"], F.lit(-1000.0)))), F.lit(0.0), lambda acc, x: acc + x)
    deviation = F.sqrt(F.pow(pick(model["far"]), 2) + F.pow(pick(model["near"]), 2) / F.greatest(n, F.lit(1)))
    return judged, F.when(n > 0, pick(model["langs"])).otherwise("und"), F.when(n > 0, 1 / odds).otherwise(0.0), (n == 0) | (least > pick(model["mean"]) + model["limit"] * deviation)


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred, score and rejected: und, or further from its language than the limit allows.

    Columns of docs that have these names give way.
    """
    docs = besides(docs, "lang_pred", "score", "rejected")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    judged, lang, score, rejected = _judged(docs, model)
    return judged.withColumns({"lang_pred": lang, "score": score, "rejected": rejected}).drop(_BITS, _N)


def in_a_language(docs: DataFrame) -> DataFrame:
    """docs without those rejected, by a model learned from docs; without anything to learn from all are."""
    if (model := learn(docs)) is None:
        return docs.limit(0)
    judged, _, _, rejected = _judged(docs, model)
    return judged.where(~rejected).drop(_BITS, _N)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identified(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
