"""Difficulty of works from the ranks of their words: peak words, rank histograms, standard scores, one integer.

Ranks are those of all dictionary readings, words that never occur included. In a bucket of ranks the first word (by
id) counts once and each further one by its occurrences, while every peak word counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.numbering import summed_before
from ..plans.registry import query
from ..plans.staging import staged
from ..plans.star import BUCKET, STAR_SQL, Star
from .frequency import totals_by_reading, totals_by_word
from .ranking import competition_rank

PEAK_SHARE = 0.1
#: The weights of the parts of the score.
WEIGHTS = {"word_difficulty": 25, "peak_difficulty": 15, "character_count": 0, "unique_word_count": 15, "unique_kanji_count": 30, "sentence_length": 15}

DIFFICULTY_SQL = f"""{STAR_SQL},
ranked AS (
  SELECT pw.*, rr.reading_rank, CASE WHEN rr.reading_type = 1 THEN wr.frequency_rank ELSE rr.reading_rank END AS used_rank
  FROM pw JOIN rr USING (word_id, reading_index) JOIN wr USING (word_id)),
cum AS (
  SELECT *, row_number() OVER w AS rn, sum(occurrences) OVER (w ROWS UNBOUNDED PRECEDING) - occurrences AS before, sum(occurrences) OVER (PARTITION BY deck_id) AS all_occ
  FROM ranked WINDOW w AS (PARTITION BY deck_id ORDER BY reading_rank DESC, deck_word_id)),
marked AS (SELECT *, rn = 1 OR before < CAST(floor(all_occ * 0.1) AS BIGINT) AS peak, used_rank // {BUCKET} AS bucket FROM cum),
buckets AS (
  SELECT deck_id, peak, bucket, CASE WHEN peak THEN count(*) ELSE sum(occurrences) - arg_min(occurrences, deck_word_id) + 1 END AS weight FROM marked GROUP BY deck_id, peak, bucket),
wd AS (
  SELECT b.deck_id, coalesce(sum(weight / s.word_count * 100 * exp(bucket / 7.0)) FILTER (NOT peak), 0) AS word_difficulty, coalesce(sum(weight / s.word_count * 100 * exp(bucket / 4.0)) FILTER (peak), 0) AS peak_difficulty
  FROM buckets b JOIN stats s USING (deck_id) GROUP BY b.deck_id),
measures AS (
  SELECT d.deck_id, d.media_type, coalesce(word_difficulty, 0) AS word_difficulty, coalesce(peak_difficulty, 0) AS peak_difficulty, CAST(d.character_count AS DOUBLE) AS character_count,
    CAST(d.unique_word_count AS DOUBLE) AS unique_word_count, CAST(d.unique_kanji_count AS DOUBLE) AS unique_kanji_count,
    CAST(CAST(CASE WHEN d.sentence_count = 0 THEN 0 ELSE d.character_count / d.sentence_count END AS FLOAT) AS DOUBLE) AS sentence_length
  FROM decks d LEFT JOIN wd USING (deck_id))
"""
_W = f"WITH {DIFFICULTY_SQL}"


def ranked_words(star: Star) -> DataFrame:
    """Deck words with their reading's rank, and the rank used: the word's own for kana readings."""
    of_readings = staged(totals_by_reading(star), "reading-totals")
    of_words = of_readings.groupBy("word_id").agg(F.sum("total").alias("total"))
    words = competition_rank(of_words, "total", "frequency_rank").select("word_id", "frequency_rank")
    readings = competition_rank(of_readings, "total", "reading_rank", ready=True).select("word_id", "reading_index", "reading_type", "reading_rank")
    used = F.when(F.col("reading_type") == 1, F.col("frequency_rank")).otherwise(F.col("reading_rank"))
    return star.parent_words().join(readings.join(words, "word_id"), ["word_id", "reading_index"]).withColumn("used_rank", used)


def marked_words(star: Star) -> DataFrame:
    """With peak: the rarest words up to a share of the deck's occurrences, the crossing one and in any case the first included.

    Words that occur are meant: each has one occurrence at least. A deck's sums run over ranges of its words, so that a
    large deck is no single task's.
    """
    rarest = [F.desc("reading_rank"), F.col("deck_word_id")]
    rows = summed_before(ranked_words(star), "occurrences", rarest, ("deck_id",), "_so_far", "_of_deck")
    target = F.greatest(F.floor(F.col("_of_deck") * PEAK_SHARE), F.lit(1))
    return rows.withColumn("peak", F.col("_so_far") < target).withColumn("bucket", F.expr(f"used_rank div {BUCKET}")).drop("_so_far", "_of_deck")


def bucket_weights(star: Star) -> DataFrame:
    counted = F.sum("occurrences") - F.min_by("occurrences", "deck_word_id") + 1
    return marked_words(star).groupBy("deck_id", "peak", "bucket").agg(F.when(F.col("peak"), F.count("*")).otherwise(counted).alias("weight"))


def word_difficulties(star: Star) -> DataFrame:
    stats = star.stats().select("deck_id", "word_count")
    scaled = lambda by: F.col("weight") / F.col("word_count") * 100 * F.exp(F.col("bucket") / by)
    return bucket_weights(star).join(stats, "deck_id").groupBy("deck_id").agg(
        F.coalesce(F.sum(F.when(~F.col("peak"), scaled(7.0))), F.lit(0.0)).alias("word_difficulty"), F.coalesce(F.sum(F.when(F.col("peak"), scaled(4.0))), F.lit(0.0)).alias("peak_difficulty")
    )


def measures(star: Star) -> DataFrame:
    """What the score is made of, for each primary deck."""
    length = F.when(F.col("sentence_count") == 0, 0).otherwise(F.col("character_count") / F.col("sentence_count")).cast("float").cast("double")
    decks = star.decks().join(word_difficulties(star), "deck_id", "left").fillna(0.0, ["word_difficulty", "peak_difficulty"])
    return decks.select("deck_id", "media_type", "word_difficulty", "peak_difficulty", *(F.col(c).cast("double").alias(c) for c in ("character_count", "unique_word_count", "unique_kanji_count")), length.alias("sentence_length"))


def moments(decks: DataFrame, values: list[str], within: str = "media_type") -> DataFrame:
    """Mean and deviation of each value by kind of deck, a row for each kind. decks is read twice, for the means and for distances from them.

    As in SQL a deviation is infinite where squares overflow, not a number where one of several values is infinite, and 0
    where all are equal or one is alone. Spark's stddev_pop() has no number where squares overflow: merging a task's first
    moments into none multiplies an infinite square by no rows.
    """
    each = {"n": F.count, "low": F.min, "high": F.max, "mean": F.avg}
    means = decks.groupBy(F.col(within).alias("_kind")).agg(*(f(v).alias(f"{v}_{k}") for v in values for k, f in each.items()))
    apart = lambda v: F.col(v) - F.col(f"{v}_mean")

    def deviation(v: str) -> Column:
        n, low, high = (F.any_value(f"{v}_{k}") for k in ("n", "low", "high"))
        alone = (n == 1) | ((low == high) & (F.abs(high) < float("inf")))
        return F.when(n > 0, F.when(alone, 0.0).otherwise(F.sqrt(F.sum(apart(v) * apart(v)) / n)))

    around = decks.select(within, *values).join(F.broadcast(means), F.col(within).eqNullSafe(F.col("_kind")))
    return around.groupBy(within).agg(*(c for v in values for c in (F.any_value(f"{v}_mean").alias(f"{v}_mean"), deviation(v).alias(f"{v}_deviation"))))


def with_moments(decks: DataFrame, values: list[str], within: str = "media_type") -> DataFrame:
    """decks with mean and deviation of each value among decks of the same kind: a row for each kind is broadcast, no kind is put into one task."""
    decks = staged(decks, "measures")  # used three times
    return decks.join(F.broadcast(moments(decks, values, within)), within)


def zscore(value: str, weight: int) -> Column:
    """Standard score by with_moments(), cut at two deviations, mapped to 0..weight."""
    if not weight:
        return F.lit(0.0).cast("float")
    z = F.try_divide(F.col(value) - F.col(f"{value}_mean"), F.col(f"{value}_deviation"))
    mapped = (F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)) + 2) / 4 * weight
    return F.when(z.isNull(), weight / 2).otherwise(mapped).cast("float")  # least() and greatest() skip nulls


def _zsql(value: str, weight: int) -> str:
    if not weight:
        return "0"
    spread = f"stddev_pop({value}) OVER (PARTITION BY media_type)"
    return f"CAST(CASE WHEN {spread} = 0 THEN {weight / 2} ELSE (greatest(-2.0, least(2.0, ({value} - avg({value}) OVER (PARTITION BY media_type)) / {spread})) + 2) / 4 * {weight} END AS FLOAT)"


@query(f"{_W} SELECT deck_id, deck_word_id, word_id, reading_index, reading_rank FROM marked WHERE peak")
def peak_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_words(Star(spark, sf_dir, once=True)).where("peak").select("deck_id", "deck_word_id", "word_id", "reading_index", "reading_rank")


@query(f"{_W} SELECT deck_id, peak, bucket, CAST(weight AS BIGINT) AS weight FROM buckets")
def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_weights(Star(spark, sf_dir, once=True))


@query(f"{_W} SELECT deck_id, round(word_difficulty, 6) AS word_difficulty, round(peak_difficulty, 6) AS peak_difficulty FROM wd")
def deck_word_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_difficulties(Star(spark, sf_dir, once=True)).select("deck_id", F.round("word_difficulty", 6).alias("word_difficulty"), F.round("peak_difficulty", 6).alias("peak_difficulty"))


@query(f"{_W} SELECT media_type, round(avg(word_difficulty), 6) AS mean, round(stddev_pop(word_difficulty), 6) AS deviation, round(avg(sentence_length), 4) AS mean_length FROM measures GROUP BY media_type")
def deck_stat_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = staged(measures(Star(spark, sf_dir, once=True)), "measures")
    by = moments(decks, ["word_difficulty", "sentence_length"])
    return by.select("media_type", F.round("word_difficulty_mean", 6).alias("mean"), F.round("word_difficulty_deviation", 6).alias("deviation"), F.round("sentence_length_mean", 4).alias("mean_length"))


@query(f"{_W} SELECT deck_id, round({_zsql('unique_kanji_count', 30)}, 4) AS kanji_part FROM measures")
def zscore_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_moments(measures(Star(spark, sf_dir, once=True)), ["unique_kanji_count"]).select("deck_id", F.round(zscore("unique_kanji_count", 30), 4).alias("kanji_part"))


@query(f"{_W} SELECT deck_id, media_type, CAST(round_even({' + '.join(f'CAST({_zsql(k, w)} AS DOUBLE)' for k, w in WEIGHTS.items())}, 0) AS INTEGER) AS difficulty FROM measures")
def deck_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [zscore(k, w).cast("double") for k, w in WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return with_moments(measures(Star(spark, sf_dir, once=True)), list(WEIGHTS)).select("deck_id", "media_type", F.bround(total, 0).cast("int").alias("difficulty"))


@query(f"""WITH {STAR_SQL},
h AS (SELECT frequency_rank // {BUCKET} AS bucket, count(*) AS n FROM (SELECT DISTINCT word_id FROM pw WHERE deck_id = 1) JOIN wr USING (word_id) GROUP BY ALL),
p AS (SELECT bucket, n, n / (SELECT sum(n) FROM h) * 100 AS pct FROM h)
SELECT bucket, n, round(pct, 6) AS pct, round(pct * exp(bucket / 10.0), 6) AS points, round(pct * exp(bucket / 10.0) / sum(pct * exp(bucket / 10.0)) OVER () * 100, 6) AS share FROM p""")
def debug_deck_histogram(spark: SparkSession, sf_dir: str, deck_id: int = 1) -> DataFrame:
    """One deck's words by bucket of ranks, with points and their shares."""
    star = Star(spark, sf_dir, once=True)
    own = star.parent_words().where(F.col("deck_id") == deck_id).select("word_id").distinct()
    ranks = competition_rank(totals_by_word(star), "total", "frequency_rank")
    by = own.join(ranks, "word_id").groupBy(F.expr(f"frequency_rank div {BUCKET}").alias("bucket")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # as many rows as buckets
    pct = F.col("n") / F.sum("n").over(everything) * 100
    by = by.withColumn("pct", pct).withColumn("points", F.col("pct") * F.exp(F.col("bucket") / 10.0))
    return by.select("bucket", "n", F.round("pct", 6).alias("pct"), F.round("points", 6).alias("points"), F.round(F.col("points") / F.sum("points").over(everything) * 100, 6).alias("share"))
