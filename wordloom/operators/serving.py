"""Deck words kept for serving: rolled up and ranked once, then read by deck or by word without a shuffle.

The table is written twice, in ranges by deck and in ranges by word, each sorted. A request's filter reaches the files'
statistics, so it reads the row groups that can hold its deck or word; a large deck, or a word that all decks have, lies in
as many files as it fills. Ranks are joined when the table is built, not when it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import shared_dir, staged
from ..plans.star import STAR_SQL, Star
from .browsing import DECK, READING, WORD, with_rank

_W = f"WITH {STAR_SQL}"
#: The two copies and what each is sorted by.
COPIES = {"by_deck": ("deck_id", "deck_word_id"), "by_word": ("word_id", "reading_index", "deck_id")}


def build(star: Star, path: str) -> None:
    words = staged(with_rank(star.parent_words(), star), "deck-words")
    for name, keys in COPIES.items():
        words.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/{name}")


def words_of_deck(spark: SparkSession, path: str, deck_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/by_deck").where(F.col("deck_id") == deck_id)


def decks_with_word(spark: SparkSession, path: str, word_id: int, reading_index: int) -> DataFrame:
    return spark.read.parquet(f"{path}/by_word").where((F.col("word_id") == word_id) & (F.col("reading_index") == reading_index))


def _built(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/served-{uuid.uuid4().hex}"
    build(Star(spark, sf_dir, once=True), path)
    return path


@query(f"{_W} SELECT deck_word_id, word_id, reading_index, occurrences, reading_rank FROM pw JOIN rr USING (word_id, reading_index) WHERE deck_id = 1")
def served_deck_words(spark: SparkSession, sf_dir: str, deck_id: int = DECK) -> DataFrame:
    return words_of_deck(spark, _built(spark, sf_dir), deck_id).select("deck_word_id", "word_id", "reading_index", "occurrences", "reading_rank")


@query(f"{_W} SELECT deck_id, occurrences FROM pw WHERE word_id = 1 AND reading_index = 0")
def served_decks_with_word(spark: SparkSession, sf_dir: str, word_id: int = WORD, reading_index: int = READING) -> DataFrame:
    return decks_with_word(spark, _built(spark, sf_dir), word_id, reading_index).select("deck_id", "occurrences")
