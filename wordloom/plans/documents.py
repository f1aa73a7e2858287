"""Works from documents: each document is a leaf, documents of some sources are children of their source's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Texts in an Arrow batch at most. Batches are held whole, off the heap and in a worker, and texts may be long; their
#: bytes are bounded by spark.sql.execution.arrow.maxBytesPerBatch besides.
BATCH = 500


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH rows; called where a function over whole texts is planned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
        self.pages = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def lines(self) -> DataFrame:
        """doc_id, line_no from 0, line."""
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    def token_arrays(self) -> DataFrame:
        """doc_id, tokens."""
        return self.documents.select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))

    def tokens(self) -> DataFrame:
        """doc_id, pos from 0, token."""
        return self.documents.select("doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token")).where("token is not null")

    def deck_words(self) -> DataFrame:
        """(doc, word, reading) with occurrences and first position; the reading tells lower, mixed and upper case apart."""
        reading = lambda x: F.when(x == F.lower(x), 0).when(x == F.upper(x), 2).otherwise(1)
        keyed = self.token_arrays().select("doc_id", F.transform("tokens", lambda x: F.struct(F.lower(x).alias("word"), reading(x).alias("reading_index"))).alias("tokens"))
        return counted(keyed, "occurrences", "first_pos").select("doc_id", "item.*", "occurrences", "first_pos")

    def decks(self) -> DataFrame:
        """deck_id, media_type, parent_deck_id, deck_order of each document."""
        from pyspark.sql import Window

        n = F.substring("source", 4, 10).cast("int")
        rows = self.documents.select("doc_id", "source", (F.col("doc_id") + 1).alias("deck_id"), (n % 9 + 1).alias("media_type"), F.when(n >= 10, 2_000_000 + n).alias("parent_deck_id"))
        order = F.row_number().over(Window.partitionBy("parent_deck_id").orderBy("doc_id"))
        return rows.where("parent_deck_id is not null").withColumn("deck_order", order).unionByName(rows.where("parent_deck_id is null").withColumn("deck_order", F.lit(0)))


def counted(rows: DataFrame, n: str, first: str) -> DataFrame:
    """doc_id, item, and how often and where first each distinct item stands in a document's tokens.

    A document's tokens are one row, so they are sorted and counted there, and nothing is shuffled. Not inline(): from that
    a filter is inferred, in which all columns up to here would be evaluated again, for each element.
    """
    ordered = rows.select("doc_id", F.sort_array(F.transform("tokens", lambda x, i: F.struct(x.alias("item"), i.alias("pos")))).alias("s"))
    at = lambda i: F.get("s", i)["item"]
    ordered = ordered.withColumn("starts", F.when(F.size("s") > 0, F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))))
    groups = F.transform("starts", lambda i, k: F.struct(at(i).alias("item"), (F.coalesce(F.get("starts", k + 1), F.size("s")) - i).cast("long").alias(n), F.get("s", i)["pos"].alias(first)))
    return ordered.withColumn("groups", groups).select("doc_id", F.inline_outer("groups")).where(f"{n} is not null")


#: The same as SQL for DuckDB, to stand behind WITH.
LINES_SQL = r"ln AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
TOKENS_SQL = r"tok AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS t FROM documents))"
WORDS_SQL = f"{TOKENS_SQL}, dw AS (SELECT doc_id, lower(token) AS word, CASE WHEN token = lower(token) THEN 0 WHEN token = upper(token) THEN 2 ELSE 1 END AS reading_index, count(*) AS occurrences, min(pos) AS first_pos FROM tok GROUP BY ALL)"
