"""Corpus-wide frequencies of words and readings: totals, ranks, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.star import STAR_SQL, Star
from .ranking import competition_rank

_W = f"WITH {STAR_SQL}"


def totals_by_word(star: Star) -> DataFrame:
    """Every dictionary word with occurrences over primary decks and the number of decks, zeros included."""
    used = star.parent_words().groupBy("word_id").agg(F.sum("occurrences").alias("total"), F.countDistinct("deck_id").alias("used_in"))
    return star.words().select("word_id").join(used, "word_id", "left").fillna(0)


def totals_by_reading(star: Star) -> DataFrame:
    """Every (word, reading) with occurrences and uses, zeros included."""
    used = star.parent_words().groupBy("word_id", "reading_index").agg(F.sum("occurrences").alias("total"), F.count("*").alias("used_in"))
    return star.readings().join(used, ["word_id", "reading_index"], "left").fillna(0, ["total", "used_in"])


def shares(star: Star) -> DataFrame:
    """Observed frequency of each reading, of all and of its word in percent; zero where nothing occurs."""
    words = totals_by_word(star).select("word_id", F.col("total").alias("word_total"))
    everything = words.agg(F.sum("word_total").alias("all_total"))
    joined = totals_by_reading(star).join(words, "word_id").crossJoin(F.broadcast(everything))  # one row
    return joined.withColumn("observed", F.coalesce(F.try_divide("total", "all_total"), F.lit(0.0))).withColumn("percentage", F.coalesce(F.try_divide("total", "word_total") * 100, F.lit(0.0)))


@query(f"{_W} SELECT word_id, total, used_in FROM wt WHERE total > 0")
def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Star(spark, sf_dir).parent_words()
    return words.groupBy("word_id").agg(F.sum("occurrences").alias("total"), F.countDistinct("deck_id").alias("used_in"))


@query(f"{_W} SELECT word_id, reading_index, total, used_in FROM rt WHERE total > 0")
def reading_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Star(spark, sf_dir).parent_words()
    return words.groupBy("word_id", "reading_index").agg(F.sum("occurrences").alias("total"), F.count("*").alias("used_in"))


@query(f"{_W} SELECT word_id, reading_index, reading, total, used_in FROM rt")
def reading_totals_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals_by_reading(Star(spark, sf_dir)).select("word_id", "reading_index", "reading", "total", "used_in")


@query(f"""{_W} SELECT word_id, reading_index, round(CASE WHEN g = 0 THEN 0 ELSE rt.total / g END, 9) AS observed, round(CASE WHEN wt.total = 0 THEN 0 ELSE rt.total / wt.total * 100 END, 6) AS percentage
FROM rt JOIN wt USING (word_id), (SELECT sum(total) AS g FROM wt)""")
def observed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(Star(spark, sf_dir)).select("word_id", "reading_index", F.round("observed", 9).alias("observed"), F.round("percentage", 6).alias("percentage"))


@query(f"{_W} SELECT word_id, total, frequency_rank FROM wr")
def word_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competition_rank(totals_by_word(Star(spark, sf_dir)), "total", "frequency_rank").select("word_id", "total", "frequency_rank")


@query(f"{_W} SELECT word_id, reading_index, total, reading_rank FROM rr")
def reading_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competition_rank(totals_by_reading(Star(spark, sf_dir)), "total", "reading_rank").select("word_id", "reading_index", "total", "reading_rank")


@query(f"""{_W} SELECT arg_min(reading, struct_pack(a := -rt.total, b := reading_index)) AS reading, any_value(frequency_rank) AS rank, word_id
FROM rt JOIN wr USING (word_id) GROUP BY word_id""")
def global_frequency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's most frequent reading, the first among equals, with the word's rank."""
    best = totals_by_reading(Star(spark, sf_dir)).groupBy("word_id").agg(F.max_by("reading", F.struct("total", -F.col("reading_index"))).alias("reading"), F.sum("total").alias("total"))
    return competition_rank(best, "total", "rank").select("reading", "rank", "word_id")


@query(f"{_W} SELECT word_id, reading_index, round(CASE WHEN wt.total = 0 THEN 0 ELSE rt.total / wt.total * 100 END, 6) AS percentage, row_number() OVER (PARTITION BY word_id ORDER BY rt.total DESC, reading_index) AS place FROM rt JOIN wt USING (word_id)")
def readings_by_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("word_id").orderBy(F.desc("total"), "reading_index"))
    return shares(Star(spark, sf_dir)).select("word_id", "reading_index", F.round("percentage", 6).alias("percentage"), place.alias("place"))
