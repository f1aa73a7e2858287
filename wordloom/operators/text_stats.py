"""Statistics of texts: token counts, variants, characters, sentences; dictionary matching of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..plans.documents import TOKENS_SQL, WORDS_SQL, Corpus, counted
from ..plans.registry import query


@query(f"WITH {TOKENS_SQL} SELECT doc_id, token, count(*) AS n, min(pos) AS first_pos FROM tok GROUP BY ALL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(Corpus(spark, sf_dir).token_arrays(), "n", "first_pos").withColumnRenamed("item", "token")


@query(f"WITH {TOKENS_SQL} SELECT doc_id, pos, token FROM tok WHERE trim(token) <> ''")
def tok_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).tokens().where(F.trim("token") != "")


def merged_variants(words: DataFrame, parity: bool = True) -> DataFrame:
    """Variants of a word as one: the sum, or in parity the first variant's occurrences less one, plus the number of variants."""
    first = F.min_by("occurrences", F.struct("first_pos", "reading_index"))
    total = first - 1 + F.count("*") if parity else F.sum("occurrences")
    return words.groupBy("doc_id", "word").agg(total.alias("occurrences"), F.count("*").alias("variants"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, word, arg_min(occurrences, first_pos) - 1 + count(*) AS occurrences, count(*) AS variants FROM dw GROUP BY ALL")
def merge_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_variants(Corpus(spark, sf_dir).deck_words())


@query(f"WITH {WORDS_SQL} SELECT doc_id, word, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM dw GROUP BY ALL")
def merge_variants_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_variants(Corpus(spark, sf_dir).deck_words(), parity=False).drop("variants")


@query(rf"""WITH {WORDS_SQL}, s AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, e' \n\t') <> '')) AS sentence_count, length(text) AS character_count FROM documents)
SELECT s.doc_id, character_count, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS word_count, count(word) AS unique_count, count(*) FILTER (occurrences = 1) AS used_once, sentence_count FROM s LEFT JOIN dw USING (doc_id) GROUP BY ALL""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(spark, sf_dir)
    words = corpus.deck_words().groupBy("doc_id").agg(F.sum("occurrences").alias("word_count"), F.count("*").alias("unique_count"), F.count_if(F.col("occurrences") == 1).alias("used_once"))
    rows = corpus.documents.select("doc_id", F.length("text").alias("character_count"), F.size(sentences(F.col("text"))).alias("sentence_count"))
    return rows.join(words, "doc_id", "left").fillna(0)


@query(r"WITH ch AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM documents) GROUP BY ALL) SELECT doc_id, count(*) AS unique_chars, count(*) FILTER (n = 1) AS once FROM ch GROUP BY doc_id")
def unique_chars(spark: SparkSession, sf_dir: str, chars: str = r"[^\x00-\x7F]") -> DataFrame:
    """Distinct characters of a class in each document, and those used once; for Japanese the class of kanji."""
    found = Corpus(spark, sf_dir).documents.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(chars), F.lit(0))).alias("c")).where("c is not null")
    return found.groupBy("doc_id", "c").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("unique_chars"), F.count_if(F.col("n") == 1).alias("once"))


@query(r"""WITH ch AS (SELECT source, c, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM documents) GROUP BY ALL) SELECT source, count(*) AS unique_chars, count(*) FILTER (n = 1) AS once FROM ch GROUP BY source""")
def unique_chars_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a parent of many documents: characters are counted per parent, no text is put together."""
    found = Corpus(spark, sf_dir).documents.select("source", F.explode_outer(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("c")).where("c is not null")
    return found.groupBy("source", "c").agg(F.count("*").alias("n")).groupBy("source").agg(F.count("*").alias("unique_chars"), F.count_if(F.col("n") == 1).alias("once"))


_DICTIONARY_SQL = "words AS (SELECT lower(unnest(string_split(p_name, ' '))) AS key, p_partkey AS word_id, p_size AS score, p_brand AS pos FROM part)"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lookup key, word_id, score, pos: the words of part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("key"), F.col("p_partkey").alias("word_id"), F.col("p_size").alias("score"), F.col("p_brand").alias("pos"))


@query(f"WITH {_DICTIONARY_SQL} SELECT p.p_partkey, p.key, count(DISTINCT word_id) AS n, min(word_id) AS first_id FROM (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS key FROM part) p LEFT JOIN words USING (key) GROUP BY ALL")
def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each token by its lookup key: the dictionary is summed by key before the tokens are joined."""
    tokens = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower(F.get(F.split("p_name", " "), F.lit(0))).alias("key"))
    keys = dictionary(spark, sf_dir).groupBy("key").agg(F.countDistinct("word_id").alias("n"), F.min("word_id").alias("first_id"))
    return tokens.join(keys, "key", "left").select("p_partkey", "key", "n", "first_id")


def best_of(candidates: DataFrame, token: list[str], pos_matches: Column) -> DataFrame:
    """The best candidate of each token: matching part of speech first, then the highest score, then the lowest id."""
    rank = F.row_number().over(Window.partitionBy(*token).orderBy(pos_matches.desc(), F.desc("score"), "word_id"))
    return candidates.withColumn("_nth", rank).where("_nth = 1").drop("_nth")


@query(f"WITH {_DICTIONARY_SQL} SELECT key, word_id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (pos LIKE '%1') DESC, score DESC, word_id) AS n FROM words) WHERE n = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of(dictionary(spark, sf_dir), ["key"], F.endswith("pos", F.lit("1"))).select("key", "word_id", "score")


@query("SELECT p_partkey AS word_id, unnest(list_distinct([lower(p_name), lower(replace(p_name, ' ', ''))])) AS lookup_key FROM part")
def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's lookup keys, without doubles."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("word_id"), F.explode(F.array_distinct(F.array(F.lower("p_name"), F.lower(F.replace("p_name", F.lit(" "), F.lit("")))))).alias("lookup_key"))


@query("""WITH o AS (SELECT p_partkey, t.i, string_split(p_name, ' ')[i] AS reading FROM part, (VALUES (1), (2)) t(i)), d AS (SELECT p_size, min(p_partkey) AS pitch, string_split(p_name, ' ')[1] AS reading FROM part GROUP BY ALL),
f AS (SELECT reading, min(pitch) AS pitch FROM d GROUP BY reading) SELECT p_partkey, arg_min(pitch, i) AS pitch FROM o JOIN f USING (reading) WHERE reading IS NOT NULL GROUP BY p_partkey""")
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of each word's first reading that has one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.split("p_name", " ")
    readings = part.select("p_partkey", F.posexplode(F.slice(words, 1, 2)).alias("i", "reading"))
    entries = part.select(F.get(words, F.lit(0)).alias("reading"), "p_partkey").groupBy("reading").agg(F.min("p_partkey").alias("pitch"))
    return readings.join(entries, "reading").groupBy("p_partkey").agg(F.min_by("pitch", "i").alias("pitch"))


@query(f"""WITH {TOKENS_SQL}, f AS (SELECT *, coalesce(length(token) <= 2 AND length(lag(token) OVER w) > 2, FALSE) AS attach FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN attach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, CAST(island AS BIGINT) AS island, string_agg(token, '' ORDER BY pos) AS merged FROM g GROUP BY doc_id, island""")
def tok_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tokens attached to a longer token before them: the shape of merges that look at original neighbours only."""
    rows = Corpus(spark, sf_dir).token_arrays()
    short = lambda i: F.length(F.get("tokens", i)) <= 2
    begins = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == 0) | ~short(i) | short(i - 1))
    rows = rows.withColumn("begins", F.when(F.size("tokens") > 0, begins))
    islands = F.transform("begins", lambda i, k: F.struct((k + 1).cast("long").alias("island"), F.array_join(F.slice("tokens", i + 1, F.coalesce(F.get("begins", k + 1), F.size("tokens")) - i), "").alias("merged")))
    return rows.withColumn("islands", islands).select("doc_id", F.inline_outer("islands")).where("island is not null")  # as in counted()
