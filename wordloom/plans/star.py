"""Works from the star schema: suppliers are works, (supplier, line status) their parts, parts of the catalogue are words.

A deck word is a (deck, word, reading) with its occurrences. Word ids within a deck follow the first order in which the
word occurs, so that the chronological id needs a sort within one deck only, never a global one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged

#: Ids of a deck's words are deck_id * DECK_SPAN and a running number: 31 bits for the deck, 32 for its words, of which it
#: has no more than the dictionary has readings.
DECK_SPAN = 1 << 32
MEDIA_TYPES = {1: "Anime", 2: "Drama", 3: "Movie", 4: "Novel", 5: "Non-Fiction", 6: "Video Game", 7: "Visual Novel", 8: "Web Novel", 9: "Manga"}
BUCKET = 100


class Star:
    """The works of a folder of tables. With once, the rollup of their words is staged when it is first needed: for queries that use it in several places."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False):
        self.spark = spark
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self._once, self._rollup, self._stats = once, None, None

    def child_groups(self) -> DataFrame:
        """(child deck, word, reading) with occurrences and the first order."""
        open_line = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
        reading = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        return (
            self.read("lineitem")
            .groupBy((1_000_000 + F.col("l_suppkey") * 2 + open_line).alias("deck_id"), (F.col("l_suppkey") + 1).alias("parent_deck_id"), F.col("l_partkey").alias("word_id"), reading.alias("reading_index"))
            .agg(F.sum("l_quantity").cast("long").alias("occurrences"), F.min("l_orderkey").alias("fo"))
        )

    @staticmethod
    def numbered(groups: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("deck_id").orderBy("fo", "word_id", "reading_index"))
        return groups.select("deck_id", "word_id", "reading_index", "occurrences", (F.col("deck_id").cast("long") * DECK_SPAN + nth).alias("deck_word_id"))

    def child_words(self) -> DataFrame:
        return self.numbered(self.child_groups())

    def parent_words(self) -> DataFrame:
        """Words of primary decks: the sums over their children."""
        if self._rollup is not None:
            return self._rollup
        sums = self.child_groups().groupBy(F.col("parent_deck_id").alias("deck_id"), "word_id", "reading_index")
        out = self.numbered(sums.agg(F.sum("occurrences").alias("occurrences"), F.min("fo").alias("fo")))
        if self._once:
            out = self._rollup = staged(out, "rollup")
        return out

    def readings(self) -> DataFrame:
        """Long form of the dictionary: word_id, reading_index, reading, reading_type."""
        texts = F.array(*(F.concat("p_name", F.lit(f"#{c}")) for c in "ANR"))
        return self.read("part").select(F.col("p_partkey").alias("word_id"), F.posexplode(texts).alias("reading_index", "reading")).withColumn("reading_type", F.when(F.col("reading_index") == 0, 1).otherwise(0))

    def words(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("word_id"), "p_name", "p_brand", "p_type", "p_size")

    def titles(self) -> DataFrame:
        """Primary decks without statistics."""
        english = F.when(F.col("s_suppkey") % 5 == 0, None).otherwise(F.concat("s_name", F.lit(" (en)")))
        return self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            (F.col("s_suppkey") + 1).alias("deck_id"), (F.col("s_nationkey") % 9 + 1).alias("media_type"), F.col("s_name").alias("original_title"),
            F.concat_ws("-", "n_name", F.col("s_suppkey").cast("string")).alias("romaji_title"), english.alias("english_title"),
        )

    def stats(self) -> DataFrame:
        """Statistics of primary decks: words from the rollup, lines (as sentences) and sizes (as kanji) from the order lines."""
        if self._stats is not None:
            return self._stats
        words = self.parent_words().join(self.words().select("word_id", F.length("p_name").alias("length"), "p_size"), "word_id")
        per_word = words.groupBy("deck_id", "word_id").agg(F.sum("occurrences").alias("occ"), F.max((F.col("occurrences") == 1).cast("int")).alias("once"), F.first("length").alias("length"), F.first("p_size").alias("p_size"))
        by_words = per_word.groupBy("deck_id").agg(
            F.sum(F.col("occ") * F.col("length")).alias("character_count"), F.sum("occ").alias("word_count"), F.count("*").alias("unique_word_count"),
            F.sum("once").cast("long").alias("unique_word_used_once_count"), F.countDistinct("p_size").alias("unique_kanji_count"),
        )
        lines = self.read("lineitem").groupBy((F.col("l_suppkey") + 1).alias("deck_id")).agg(F.countDistinct("l_orderkey").alias("sentence_count"))
        out = by_words.join(lines, "deck_id")
        if self._once:
            out = self._stats = staged(out, "stats")
        return out

    def decks(self) -> DataFrame:
        return self.titles().join(self.stats(), "deck_id", "left").fillna(0, ["character_count", "word_count", "unique_word_count", "unique_word_used_once_count", "unique_kanji_count", "sentence_count"])

    def children(self) -> DataFrame:
        """Child decks: deck_id, parent_deck_id, deck_order, title."""
        kinds = self.read("lineitem").select("l_suppkey", "l_linestatus").distinct()
        open_line = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
        return kinds.select((1_000_000 + F.col("l_suppkey") * 2 + open_line).alias("deck_id"), (F.col("l_suppkey") + 1).alias("parent_deck_id"), (open_line + 1).alias("deck_order"), F.concat(F.lit("Volume "), (open_line + 1).cast("string")).alias("original_title"))


#: The same as SQL for DuckDB, to stand behind WITH.
STAR_SQL = """
child AS (
  SELECT 1000000 + l_suppkey * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS deck_id, l_suppkey + 1 AS parent_deck_id, l_partkey AS word_id,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS reading_index, CAST(sum(l_quantity) AS BIGINT) AS occurrences, min(l_orderkey) AS fo
  FROM lineitem GROUP BY ALL),
rolled AS (SELECT parent_deck_id AS deck_id, word_id, reading_index, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(fo) AS fo FROM child GROUP BY ALL),
pw AS (SELECT deck_id, word_id, reading_index, occurrences, CAST(deck_id AS BIGINT) * 4294967296 + row_number() OVER (PARTITION BY deck_id ORDER BY fo, word_id, reading_index) AS deck_word_id FROM rolled),
cw AS (SELECT deck_id, word_id, reading_index, occurrences, CAST(deck_id AS BIGINT) * 4294967296 + row_number() OVER (PARTITION BY deck_id ORDER BY fo, word_id, reading_index) AS deck_word_id FROM child),
readings AS (SELECT p_partkey AS word_id, i AS reading_index, p_name || '#' || ['A', 'N', 'R'][i + 1] AS reading, CASE i WHEN 0 THEN 1 ELSE 0 END AS reading_type FROM part, (VALUES (0), (1), (2)) t(i)),
titles AS (
  SELECT s_suppkey + 1 AS deck_id, s_nationkey % 9 + 1 AS media_type, s_name AS original_title, n_name || '-' || s_suppkey AS romaji_title,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name || ' (en)' END AS english_title
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
perword AS (
  SELECT deck_id, word_id, sum(occurrences) AS occ, max(CASE WHEN occurrences = 1 THEN 1 ELSE 0 END) AS once, any_value(length(p_name)) AS len, any_value(p_size) AS p_size
  FROM rolled JOIN part ON p_partkey = word_id GROUP BY ALL),
stats AS (
  SELECT p.deck_id, CAST(sum(occ * len) AS BIGINT) AS character_count, CAST(sum(occ) AS BIGINT) AS word_count, count(*) AS unique_word_count,
    CAST(sum(once) AS BIGINT) AS unique_word_used_once_count, count(DISTINCT p_size) AS unique_kanji_count, any_value(l.n) AS sentence_count
  FROM perword p JOIN (SELECT l_suppkey + 1 AS deck_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL) l USING (deck_id) GROUP BY p.deck_id),
decks AS (
  SELECT t.*, coalesce(character_count, 0) AS character_count, coalesce(word_count, 0) AS word_count, coalesce(unique_word_count, 0) AS unique_word_count,
    coalesce(unique_word_used_once_count, 0) AS unique_word_used_once_count, coalesce(unique_kanji_count, 0) AS unique_kanji_count, coalesce(sentence_count, 0) AS sentence_count
  FROM titles t LEFT JOIN stats USING (deck_id)),
children AS (
  SELECT DISTINCT 1000000 + l_suppkey * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS deck_id, l_suppkey + 1 AS parent_deck_id,
    CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END AS deck_order, 'Volume ' || CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END AS original_title FROM lineitem),
wt AS (SELECT r.word_id, coalesce(sum(occurrences), 0) AS total, count(DISTINCT deck_id) AS used_in FROM (SELECT DISTINCT word_id FROM readings) r LEFT JOIN pw USING (word_id) GROUP BY ALL),
rt AS (SELECT r.word_id, r.reading_index, reading, reading_type, coalesce(sum(occurrences), 0) AS total, count(deck_id) AS used_in FROM readings r LEFT JOIN pw USING (word_id, reading_index) GROUP BY ALL),
wr AS (SELECT *, rank() OVER (ORDER BY total DESC) AS frequency_rank FROM wt),
rr AS (SELECT *, rank() OVER (ORDER BY total DESC) AS reading_rank FROM rt)
"""
