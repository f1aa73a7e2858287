"""Target-distribution importance resampling (13): documents drawn by how much more likely the target makes their n-grams.

Each text's words are laid out by place (posexplode); a window over a document concatenates each word with the words
after it (lead) for every order, and each such feature is hashed into a bucket. Only the buckets' numbers are kept, staged
by place. Buckets are counted over the corpus and over the target; a bucket's gain is the logarithm of the smoothed ratio,
in thousandths. Gains, a row for each bucket, are joined back to the places, and their floored mean is a document's weight. A
Gumbel number made of its id is added, and the highest scores are the draw, without replacement.

Texts are shuffled once, by a number of the row, so that a document's words lie together and windows need no exchange of
words; no document, however long, is held in one row of features. Ranks come from ranges of scores, not from one task.

Null and wordless texts have no features, weight 0, and aren't drawn. A null doc_id is hashed as an empty one. Repeated
rows are drawn each by itself; equal scores go by the smaller doc_id (null first), and between equal rows it doesn't
matter. An empty target, or an empty corpus, has counts of 0. Whole texts count. Of the documents' columns only doc_id is
returned, so none can clash with results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .common import OWN, staged, table

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS = 2
BUCKETS = 10_000
#: Percentage drawn of the documents with so many words.
PERCENT, MIN_WORDS = 25, 20
SEED = 7

_ROW, _WORD, _PLACE = f"{OWN}row", f"{OWN}word", f"{OWN}place"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def features(docs: DataFrame, id_column: str = "doc_id", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """A row for each word, or one for a text without words: row, id, and b1, b2, ...: the bucket of the run of so many words that begins there, or null."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias(_ROW), F.col(f"`{id_column}`").alias(id_column), F.col("text"))
    # A number of partitions of its own: what comes of a partition is several times its texts, so adaptive execution must not merge them
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _ROW)
    words = rows.select(_ROW, id_column, F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias(_PLACE, _WORD)).withColumn(_WORD, lowered(F.col(_WORD)))
    after = Window.partitionBy(_ROW).orderBy(_PLACE)
    following = words.select(_ROW, id_column, F.col(_WORD).alias("w0"), *(F.lead(_WORD, k).over(after).alias(f"w{k}") for k in range(1, orders)))
    gram = lambda n: F.concat(*(x for k in range(n) for x in ([F.lit(" ")] * (k > 0) + [F.col(f"w{k}")])))
    return following.select(_ROW, id_column, *((F.crc32(gram(n)) % buckets).cast("int").alias(f"b{n}") for n in range(1, orders + 1)))


def counts(rows: DataFrame, orders: int, name: str) -> DataFrame:
    """bucket and how many features are in it."""
    grams = rows.select(F.explode(F.array(*(f"b{n}" for n in range(1, orders + 1)))).alias("bucket"))
    return grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: one row for each bucket."""
    both = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(counts(corpus, orders, "s"), "bucket", "left").join(counts(target, orders, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = staged(both, "bucket-counts")
    all_s, all_t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t").cast("double") + 1) * (all_s + buckets) / ((F.col("s").cast("double") + 1) * (all_t + buckets))
    return both.select(F.col("bucket").cast("int").alias("bucket"), F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(id_column: str, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, made of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    own = staged(features(docs, "doc_id", orders, buckets), "features")
    theirs = staged(features(target.select("text", F.lit(0).alias("item")), "item", orders, buckets), "target-features")
    gain = gains(own, theirs, orders, buckets)
    rows = own
    for n in range(1, orders + 1):  # as many rows as buckets
        rows = rows.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    total = sum((F.coalesce(F.col(f"g{n}"), F.lit(0)) for n in range(2, orders + 1)), F.coalesce(F.col("g1"), F.lit(0)))
    n = sum((F.col(f"b{n}").isNotNull().cast("long") for n in range(2, orders + 1)), F.col("b1").isNotNull().cast("long"))
    sums = rows.groupBy(_ROW, "doc_id").agg(F.count("b1").alias("n_words"), F.sum(n).alias("n_features"), F.sum(total).alias("gain"))
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return sums.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    rows = staged(weighted(docs, target).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scores")
    able = numbered(rows.where(F.col("n_words") >= min_words), [F.desc("score"), F.col("doc_id")], index="i", total="n")
    rank = F.when(F.col("i") < F.expr(f"{percent} * n div 100"), F.col("i") + 1)
    columns = ("doc_id", "n_features", "weight", "score")
    return able.select(*columns, rank.alias("rank")).unionByName(rows.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: CRC-32 of each distinct feature from its bytes; features by joining each word with the next.
ORACLE = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (
  SELECT side, id, unnest(w) AS f FROM w
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM w)),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
k AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT))), lambda c, y: xor(c // 256, tab.t[xor(c % 256, y) + 1])), 4294967295) % 10000 AS k
  FROM u, tab),
c AS (SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN k USING (f) GROUP BY k),
g AS (
  SELECT k, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM c),
m AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM f JOIN k USING (f) JOIN g USING (k) WHERE side = 'd' GROUP BY id),
d AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN m USING (id) WHERE side = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_words >= 20 AND nth <= 25 * n // 100 THEN nth END AS rank FROM r
"""
