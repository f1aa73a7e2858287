"""Browsing queries over works and words: lists, filters, sorts, pages, details, statistics."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.registry import query
from ..plans.star import MEDIA_TYPES, STAR_SQL, Star
from .difficulty import DIFFICULTY_SQL, WEIGHTS, _zsql, measures, with_moments, zscore
from .frequency import totals_by_reading, totals_by_word
from .ranking import competition_rank

_W = f"WITH {STAR_SQL}"
#: Rows of a page of the deck list, of vocabulary, and of sub-decks.
PAGE_DECKS, PAGE_WORDS, PAGE_CHILDREN = 50, 100, 25
WORD, READING, DECK = 1, 0, 1
#: Parts as senses, four to a word, so that words grow with the table.
SENSE_WORD = "p_partkey div 4"


def page(df: DataFrame, offset: int, size: int) -> DataFrame:
    if offset < 0:
        raise ValueError("the offset can't be negative")
    return df.offset(offset).limit(size)


def deep_page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """The same in an order, at any depth: rows are found by their place, and those before them don't pass through one task."""
    if offset < 0:
        raise ValueError("the offset can't be negative")
    rows = numbered(df, order, index="_place")
    return rows.where(F.col("_place").between(offset, offset + size - 1)).orderBy("_place").drop("_place")


def ranked_readings(star: Star) -> DataFrame:
    ranks = competition_rank(totals_by_reading(star), "total", "reading_rank")
    return ranks.select("word_id", "reading_index", "reading", "reading_type", "reading_rank")


def with_rank(words: DataFrame, star: Star) -> DataFrame:
    """Deck words with their reading's rank, 0 if unknown."""
    ranks = ranked_readings(star).select("word_id", "reading_index", "reading_rank")
    return words.join(ranks, ["word_id", "reading_index"], "left").fillna(0, ["reading_rank"])


@query("SELECT s_suppkey + 1 AS deck_id FROM supplier")
def primary_deck_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Star(spark, sf_dir).titles().select("deck_id")


@query("SELECT 'https://example.org/decks/media/' || (s_suppkey + 1) || '/detail' AS loc FROM supplier")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primary_deck_ids(spark, sf_dir).select(F.concat(F.lit("https://example.org/decks/media/"), F.col("deck_id").cast("string"), F.lit("/detail")).alias("loc"))


@query(f"{_W} SELECT deck_id, original_title FROM decks WHERE media_type = 3")
def decks_by_media_type(spark: SparkSession, sf_dir: str, media_type: int = 3) -> DataFrame:
    return Star(spark, sf_dir).titles().where(F.col("media_type") == media_type).select("deck_id", "original_title")


def title_terms(text: str) -> Column:
    """A search text as a condition's score over the three titles: quoted phrases, OR, and -word; a term counts once per title it is in."""
    titles = [F.lower(F.coalesce(c, F.lit(""))) for c in ("original_title", "romaji_title", "english_title")]
    hits = lambda term: sum(((t.contains(term)).cast("int") for t in titles), F.lit(0))
    score, wanted, either = F.lit(0), F.lit(True), None
    tokens = re.findall(r'-?"[^"]+"|\S+', text.lower())
    for i, token in enumerate(tokens):
        if token == "or":
            continue
        if token.startswith("-") and len(token) > 1:
            wanted = wanted & (hits(token[1:].strip('"')) == 0)
            continue
        n = hits(token.strip('"'))
        score = score + n
        joined = i and tokens[i - 1] == "or"
        if joined and either is not None:
            either = either | (n > 0)
        else:
            wanted = wanted if either is None else wanted & either
            either = n > 0
    return F.when(wanted if either is None else wanted & either, score)


@query(f"""{_W}, s AS (SELECT deck_id, original_title, lower(original_title) AS a, lower(romaji_title) AS b, lower(coalesce(english_title, '')) AS c FROM titles)
SELECT deck_id, original_title, contains(a, '(en)')::INT + contains(b, '(en)')::INT + contains(c, '(en)')::INT + contains(a, '01')::INT + contains(b, '01')::INT + contains(c, '01')::INT AS score
FROM s WHERE (contains(a, '(en)') OR contains(b, '(en)') OR contains(c, '(en)')) AND (contains(a, '01') OR contains(b, '01') OR contains(c, '01')) AND NOT (contains(a, 'france') OR contains(b, 'france') OR contains(c, 'france'))""")
def title_search(spark: SparkSession, sf_dir: str, text: str = "(en) 01 -france") -> DataFrame:
    found = Star(spark, sf_dir).titles().withColumn("score", title_terms(text)).where(F.col("score") > 0)
    return found.select("deck_id", "original_title", "score").orderBy(F.desc("score"), "deck_id")


@query(f"{_W} SELECT DISTINCT deck_id, original_title FROM titles SEMI JOIN (SELECT deck_id FROM pw WHERE word_id = 1 AND reading_index = 0) USING (deck_id)")
def decks_containing_word(spark: SparkSession, sf_dir: str, word_id: int = WORD, reading_index: int = READING) -> DataFrame:
    star = Star(spark, sf_dir)
    having = star.parent_words().where((F.col("word_id") == word_id) & (F.col("reading_index") == reading_index))
    return star.titles().join(having, "deck_id", "left_semi").select("deck_id", "original_title")


@query(f"{_W} SELECT word_id, reading_index, occurrences FROM pw JOIN rr USING (word_id, reading_index) WHERE deck_id = 1 AND reading_rank BETWEEN 100 AND 2000")
def words_in_rank_range(spark: SparkSession, sf_dir: str, deck_id: int = DECK, low: int = 100, high: int = 2000) -> DataFrame:
    star = Star(spark, sf_dir)
    ranked = ranked_readings(star).where(F.col("reading_rank").between(low, high))
    return star.parent_words().where(F.col("deck_id") == deck_id).join(ranked, ["word_id", "reading_index"], "left_semi").select("word_id", "reading_index", "occurrences")


@query(f"{_W} SELECT count(*) AS n FROM pw JOIN rr USING (word_id, reading_index) WHERE deck_id = 1 AND reading_rank BETWEEN 100 AND 2000")
def vocab_count_in_rank_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_in_rank_range(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"{_W} SELECT deck_id, word_id, occurrences FROM pw JOIN readings USING (word_id, reading_index) WHERE deck_id = 1 AND NOT regexp_matches(reading, '^[a-z ]+#A$')")
def exclude_kana(spark: SparkSession, sf_dir: str, kana: str = "^[a-z ]+#A$", deck_id: int = DECK) -> DataFrame:
    """Deck words whose reading isn't wholly of the given characters; for Japanese texts the kana blocks."""
    star = Star(spark, sf_dir)
    words = star.parent_words().where(F.col("deck_id") == deck_id).join(star.readings(), ["word_id", "reading_index"])
    return words.where(~F.col("reading").rlike(kana)).select("deck_id", "word_id", "occurrences")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT regexp_matches(substr(o_orderpriority, 1, 1) || o_orderkey, '^[0-9]*$')")
def exclude_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text has something but digits; the empty text counts as all digits."""
    orders = Star(spark, sf_dir).read("orders")
    text = F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string"))
    return orders.where(~text.rlike(r"^\p{Nd}*$")).select("o_orderkey", "o_orderpriority")


@query(f"{_W} SELECT * FROM titles WHERE deck_id = 7")
def deck_by_id(spark: SparkSession, sf_dir: str, deck_id: int = 7) -> DataFrame:
    return Star(spark, sf_dir).titles().where(F.col("deck_id") == deck_id).limit(1)


_DTO = f"""{_W}, kids AS (SELECT parent_deck_id AS deck_id, count(*) AS children_count FROM children GROUP BY ALL)
SELECT d.*, CAST(CASE WHEN sentence_count = 0 THEN 0 ELSE round(CAST(character_count / sentence_count AS FLOAT), 3) END AS DOUBLE) AS average_sentence_length, coalesce(children_count, 0) AS children_count FROM decks d LEFT JOIN kids USING (deck_id)"""


def deck_rows(star: Star) -> DataFrame:
    """Decks as they are shown: with average sentence length and the number of children."""
    kids = star.children().groupBy(F.col("parent_deck_id").alias("deck_id")).agg(F.count("*").alias("children_count"))
    length = F.when(F.col("sentence_count") == 0, F.lit(0.0)).otherwise(F.round((F.col("character_count") / F.col("sentence_count")).cast("float").cast("double"), 3))
    return star.decks().withColumn("average_sentence_length", length).join(kids, "deck_id", "left").fillna(0, ["children_count"])


@query(_DTO.replace("round(CAST(character_count / sentence_count AS FLOAT), 3)", "round(CAST(CAST(character_count / sentence_count AS FLOAT) AS DOUBLE), 3)"))
def deck_dto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_rows(Star(spark, sf_dir))


@query(f"{_W} SELECT media_type, count(*) AS n FROM pw JOIN titles USING (deck_id) WHERE word_id = 1 AND reading_index = 0 GROUP BY media_type")
def word_usage_by_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    used = star.parent_words().where((F.col("word_id") == WORD) & (F.col("reading_index") == READING))
    return used.join(star.titles(), "deck_id").groupBy("media_type").agg(F.count("*").alias("n"))


@query(f"""{_W}, all_of AS (SELECT media_type, count(*) AS total FROM titles GROUP BY ALL), part_of AS (SELECT media_type, count(*) AS n FROM pw JOIN titles USING (deck_id) WHERE word_id = 1 AND reading_index = 0 GROUP BY media_type)
SELECT media_type, CAST(round(coalesce(n, 0) / total * 100, 0) AS BIGINT) AS percent FROM all_of LEFT JOIN part_of USING (media_type)""")
def usage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = decks_count_by_type(spark, sf_dir).select("media_type", F.col("n").alias("total"))
    some = word_usage_by_media_type(spark, sf_dir)
    return every.join(some, "media_type", "left").select("media_type", F.round(F.coalesce("n", F.lit(0)) / F.col("total") * 100, 0).cast("long").alias("percent"))


@query(f"{_W} SELECT deck_word_id, word_id, reading_index, occurrences, p_brand, p_type FROM pw JOIN part ON p_partkey = word_id WHERE deck_id = 1")
def deck_vocab_words(spark: SparkSession, sf_dir: str, deck_id: int = DECK) -> DataFrame:
    star = Star(spark, sf_dir)
    words = star.words().select("word_id", "p_brand", "p_type")
    return star.parent_words().where(F.col("deck_id") == deck_id).join(words, "word_id").select("deck_word_id", "word_id", "reading_index", "occurrences", "p_brand", "p_type")


@query(f"{_W} SELECT deck_id, deck_word_id, coalesce(reading_rank, 0) AS reading_rank FROM pw LEFT JOIN rr USING (word_id, reading_index)")
def deck_words_with_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return with_rank(star.parent_words(), star).select("deck_id", "deck_word_id", "reading_rank")


@query(f"{_W} SELECT c.deck_id, c.original_title, t.original_title AS parent_title FROM children c LEFT JOIN titles t ON c.parent_deck_id = t.deck_id")
def deck_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    parents = star.titles().select(F.col("deck_id").alias("parent_deck_id"), F.col("original_title").alias("parent_title"))
    return star.children().join(parents, "parent_deck_id", "left").select("deck_id", "original_title", "parent_title")


@query("SELECT s_suppkey + 1 AS deck_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS links FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY s_suppkey")
def deck_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    lines = star.read("lineitem").join(star.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_suppkey") + 1).alias("deck_id"), "o_orderpriority").distinct()
    links = lines.groupBy("deck_id").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",").alias("links"))
    return star.titles().select("deck_id").join(links, "deck_id", "left")


@query(f"{_W} SELECT t.deck_id, count(c.deck_id) AS children_count FROM titles t LEFT JOIN children c ON c.parent_deck_id = t.deck_id GROUP BY t.deck_id")
def deck_children_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_rows(Star(spark, sf_dir)).select("deck_id", "children_count")


_LABELS = ", ".join(f"({k}, '{v}')" for k, v in MEDIA_TYPES.items())


@query(f"{_W}, kinds(media_type, label) AS (VALUES {_LABELS}) SELECT label, count(d.deck_id) AS n, CAST(coalesce(sum(character_count), 0) AS BIGINT) AS characters FROM kinds LEFT JOIN decks d USING (media_type) GROUP BY label")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks and characters of each media type, those without decks included."""
    kinds = spark.createDataFrame(list(MEDIA_TYPES.items()), "media_type long, label string")
    decks = Star(spark, sf_dir).decks()
    by = decks.groupBy("media_type").agg(F.count("*").alias("n"), F.sum("character_count").alias("characters"))
    return F.broadcast(kinds).join(by, "media_type", "left").fillna(0).select("label", "n", "characters")


@query(f"{_W} SELECT media_type, count(*) AS n FROM titles GROUP BY ALL")
def decks_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Star(spark, sf_dir).titles().groupBy("media_type").agg(F.count("*").alias("n"))


@query(f"{_W} SELECT count(*) AS total FROM titles")
def decks_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Star(spark, sf_dir).titles().agg(F.count("*").alias("total"))


#: Sort keys of the deck list: the column or expression, and the filter that goes with it.
SORTS: dict[str, tuple[str, str | None]] = {
    "title": ("romaji_title", None), "difficulty": ("difficulty", "difficulty <> 0"), "char_count": ("character_count", None), "sentence_length": ("character_count div (sentence_count + 1)", "sentence_count <> 0"),
    "word_count": ("word_count", None), "unique_kanji": ("unique_kanji_count", None), "unique_words": ("unique_word_count", None), "used_once": ("unique_word_used_once_count", None),
}


def deck_list(star: Star, sort: str = "title", descending: bool = False, offset: int = 0, media_type: int | None = None) -> DataFrame:
    """A page of the deck list; rows that a sort key leaves out are filtered after the total was counted."""
    key, condition = SORTS[sort]
    rows = star.decks() if media_type is None else star.decks().where(F.col("media_type") == media_type)
    if sort == "difficulty":
        parts = [zscore(k, w).cast("double") for k, w in WEIGHTS.items()]
        scores = with_moments(measures(star), list(WEIGHTS)).select("deck_id", F.bround(sum(parts[1:], parts[0]), 0).cast("int").alias("difficulty"))
        rows = rows.join(scores, "deck_id")
    rows = rows.where(condition) if condition else rows
    by = F.expr(key).desc_nulls_first() if descending else F.expr(key).asc_nulls_last()
    return page(rows.withColumn("sort_key", F.expr(key).cast("string")).orderBy(by, "deck_id"), offset, PAGE_DECKS).select("deck_id", "sort_key")


def _sorted_query(spark: SparkSession, sf_dir: str, sort: str, descending: bool) -> DataFrame:
    return deck_list(Star(spark, sf_dir), sort, descending)


for _sort, (_key, _condition) in SORTS.items():
    for _descending in (False, True) if _sort in ("char_count", "title") else (_sort != "difficulty",):
        _source = f"WITH {DIFFICULTY_SQL}, scored AS (SELECT deck_id, CAST(round_even({' + '.join(f'CAST({_zsql(k, w)} AS DOUBLE)' for k, w in WEIGHTS.items())}, 0) AS INTEGER) AS difficulty FROM measures) SELECT d.*, difficulty FROM decks d JOIN scored USING (deck_id)" if _sort == "difficulty" else f"{_W} SELECT * FROM decks"
        _expr = _key.replace(" div ", " // ")
        _order = f"{_expr} {'DESC NULLS FIRST' if _descending else 'ASC NULLS LAST'}, deck_id"
        query(f"SELECT deck_id, CAST({_expr} AS VARCHAR) AS sort_key FROM ({_source}) {'WHERE ' + _condition if _condition else ''} ORDER BY {_order} LIMIT {PAGE_DECKS}", f"decks_sorted_{_sort}" + "_desc" * (_descending and _sort in ("char_count", "title")))(partial(_sorted_query, sort=_sort, descending=_descending))


#: Sort keys of a deck's vocabulary. By frequency in the deck, ascending means the most frequent first.
VOCAB_SORTS = {"chrono": "deck_word_id", "deck_freq": "-occurrences", "global_freq": "reading_rank"}


def vocabulary_page(star: Star, deck_id: int, sort: str = "chrono", offset: int = 0, descending: bool = False) -> DataFrame:
    words = with_rank(star.parent_words().where(F.col("deck_id") == deck_id), star)
    key = F.expr(VOCAB_SORTS[choice(sort, tuple(VOCAB_SORTS))])
    order = [key.desc_nulls_first() if descending else key.asc_nulls_last(), F.col("deck_word_id")]
    return deep_page(words, order, offset, PAGE_WORDS) if offset else page(words.orderBy(*order), 0, PAGE_WORDS)


def _vocab_query(spark: SparkSession, sf_dir: str, sort: str, offset: int = 0) -> DataFrame:
    return vocabulary_page(Star(spark, sf_dir), DECK, sort, offset).select("deck_word_id", "occurrences", "reading_rank")


for _sort, _key in VOCAB_SORTS.items():
    query(f"{_W} SELECT deck_word_id, occurrences, reading_rank FROM pw JOIN rr USING (word_id, reading_index) WHERE deck_id = 1 ORDER BY {_key}, deck_word_id LIMIT {PAGE_WORDS}", f"vocab_sorted_{_sort}")(partial(_vocab_query, sort=_sort))
query(f"{_W} SELECT deck_word_id, occurrences, reading_rank FROM pw JOIN rr USING (word_id, reading_index) WHERE deck_id = 1 ORDER BY deck_word_id LIMIT {PAGE_WORDS} OFFSET 200", "paginate")(partial(_vocab_query, sort="chrono", offset=200))


@query(f"""{_W}, n AS (SELECT count(*) AS total FROM titles)
SELECT page, page * 25 AS page_offset, CAST(ceil(total / 25) AS BIGINT) AS total_pages, page * 25 + 25 < total AS has_next, page > 0 AS has_previous FROM n, range(0, CAST(ceil(total / 25) AS BIGINT)) r(page)""")
def page_info(spark: SparkSession, sf_dir: str, size: int = PAGE_CHILDREN) -> DataFrame:
    """Offsets and neighbours of all pages of the deck list."""
    total = decks_total(spark, sf_dir).withColumn("total_pages", F.ceil(F.col("total") / size))
    pages = total.select("total", "total_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_pages") - 1)).alias("page"))
    return pages.select("page", (F.col("page") * size).alias("page_offset"), "total_pages", (F.col("page") * size + size < F.col("total")).alias("has_next"), (F.col("page") > 0).alias("has_previous"))


@query(f"{_W} SELECT deck_word_id, occurrences FROM (SELECT * FROM pw WHERE deck_id = 1 ORDER BY occurrences DESC, deck_word_id LIMIT 40 OFFSET 10)")
def download_top_deck_freq(spark: SparkSession, sf_dir: str, low: int = 10, high: int = 50) -> DataFrame:
    words = Star(spark, sf_dir).parent_words().where(F.col("deck_id") == DECK)
    return page(words.orderBy(F.desc("occurrences"), "deck_word_id"), low, high - low).orderBy("deck_word_id").select("deck_word_id", "occurrences")


@query(f"{_W} SELECT deck_word_id, occurrences FROM (SELECT * FROM pw WHERE deck_id = 1 ORDER BY deck_word_id LIMIT 40 OFFSET 10)")
def download_top_chrono(spark: SparkSession, sf_dir: str, low: int = 10, high: int = 50) -> DataFrame:
    words = Star(spark, sf_dir).parent_words().where(F.col("deck_id") == DECK)
    return page(words.orderBy("deck_word_id"), low, high - low).orderBy(F.desc("occurrences"), "deck_word_id").select("deck_word_id", "occurrences")


@query(f"{_W} SELECT deck_id, original_title, word_count, role, deck_order FROM (SELECT deck_id, original_title, word_count, 'main' AS role, 0 AS deck_order FROM decks WHERE deck_id = 1 UNION ALL SELECT c.deck_id, c.original_title, (SELECT CAST(sum(occurrences) AS BIGINT) FROM child WHERE child.deck_id = c.deck_id), 'sub', deck_order FROM children c WHERE parent_deck_id = 1)")
def deck_detail(spark: SparkSession, sf_dir: str, deck_id: int = DECK) -> DataFrame:
    """The deck itself and a page of its sub-decks in order."""
    star = Star(spark, sf_dir)
    main = star.decks().where(F.col("deck_id") == deck_id).select("deck_id", "original_title", "word_count", F.lit("main").alias("role"), F.lit(0).alias("deck_order"))
    counts = star.child_groups().where(F.col("parent_deck_id") == deck_id).groupBy("deck_id").agg(F.sum("occurrences").alias("word_count"))
    subs = star.children().where(F.col("parent_deck_id") == deck_id).join(counts, "deck_id", "left").select("deck_id", "original_title", "word_count", F.lit("sub").alias("role"), "deck_order")
    return main.union(page(subs.orderBy("deck_order", "deck_id"), 0, PAGE_CHILDREN))


@query(f"""{_W}, alt AS (SELECT word_id, list(reading ORDER BY reading_index) AS all_readings FROM readings GROUP BY ALL)
SELECT deck_word_id, all_readings[reading_index + 1] AS main_reading, array_to_string(list_concat(all_readings[1:reading_index], all_readings[reading_index + 2:]), '|') AS others, occurrences
FROM pw JOIN alt USING (word_id) WHERE deck_id = 1 ORDER BY deck_word_id LIMIT {PAGE_WORDS}""")
def deck_vocabulary(spark: SparkSession, sf_dir: str, deck_id: int = DECK, offset: int = 0) -> DataFrame:
    """A page of a deck's words with their main and alternative readings."""
    star = Star(spark, sf_dir)
    texts = star.readings().groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("reading_index", "reading"))).alias("r"))
    words = page(star.parent_words().where(F.col("deck_id") == deck_id).orderBy("deck_word_id"), offset, PAGE_WORDS).join(texts, "word_id")
    main = F.get(F.col("r.reading"), F.col("reading_index"))
    others = F.array_join(F.filter(F.col("r.reading"), lambda x, i: i != F.col("reading_index")), "|")
    return words.select("deck_word_id", main.alias("main_reading"), others.alias("others"), "occurrences")


@query(f"{_W} SELECT word_id, reading_index, (SELECT string_agg(reading, '|' ORDER BY reading_index) FROM readings o WHERE o.word_id = r.word_id AND o.reading_index <> r.reading_index) AS others FROM readings r")
def alt_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = Star(spark, sf_dir).readings()
    texts = readings.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("reading_index", "reading"))).alias("r"))
    return readings.join(texts, "word_id").select("word_id", "reading_index", F.array_join(F.filter(F.col("r.reading"), lambda x, i: i != F.col("reading_index")), "|").alias("others"))


@query(f"""{_W} SELECT rr.reading_index, rr.reading, reading_rank, frequency_rank, rr.used_in, round(CASE WHEN wr.total = 0 THEN 0 ELSE rr.total / wr.total * 100 END, 6) AS percentage
FROM rr JOIN wr USING (word_id) WHERE word_id = 1""")
def word_detail(spark: SparkSession, sf_dir: str, word_id: int = WORD) -> DataFrame:
    """All readings of a word, the main one included, with ranks and shares."""
    star = Star(spark, sf_dir)
    readings = competition_rank(totals_by_reading(star), "total", "reading_rank").where(F.col("word_id") == word_id)
    words = competition_rank(totals_by_word(star), "total", "frequency_rank").select("word_id", "frequency_rank", F.col("total").alias("word_total"))
    share = F.coalesce(F.try_divide("total", "word_total") * 100, F.lit(0.0))
    return readings.join(words, "word_id").select("reading_index", "reading", "reading_rank", "frequency_rank", "used_in", F.round(share, 6).alias("percentage"))


@query(f"""{_W} SELECT deck_id, unique_word_count AS full_count, 40 AS slice_count, least(unique_word_count, 5000) AS default_high FROM decks""")
def card_count(spark: SparkSession, sf_dir: str, low: int = 10, high: int = 50) -> DataFrame:
    """Cards of an export: all unique words, or the width of a slice; a slice ends at 5000 at most by default."""
    return Star(spark, sf_dir).decks().select("deck_id", F.col("unique_word_count").alias("full_count"), F.lit(high - low).alias("slice_count"), F.least("unique_word_count", F.lit(5000)).alias("default_high"))


def validated(text: str, limit: int = 200) -> str:
    """A text for parsing, refused if it is too long."""
    if len(text) > limit:
        raise ValueError(f"the text has more than {limit} characters")
    return text


def choice(value: str, allowed: tuple[str, ...] | list[str]) -> str:
    """One of the allowed values, met without regard to case; another is refused."""
    for known in allowed:
        if known.lower() == value.lower():
            return known
    raise ValueError(f"{value!r} is none of {', '.join(allowed)}")


def found(rows: DataFrame, **key: int) -> DataFrame:
    """The rows of a key; refused if there are none, such as for an unknown deck. The key reaches the scan, and one row is read to know."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == value)
    if rows.isEmpty():
        raise LookupError(f"there is nothing with {key}")
    return rows


#: Answers to requests, by their status.
OK, REFUSED, UNKNOWN = 200, 400, 404
#: Kinds of order that the requests of request_answers may name.
KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def answers(requests: DataFrame, decks: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """requests(deck_id, kind and others) with the status of their answer: a kind that isn't known is refused, then a deck that isn't is unknown.

    Nulls are neither known kinds nor known decks. Repeated requests are each answered, and decks' repeated rows count once.
    """
    known = decks.select("deck_id").distinct().withColumn("_known", F.lit(True))
    status = F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), REFUSED).when(F.col("_known"), OK).otherwise(UNKNOWN)
    return requests.join(known, "deck_id", "left").withColumn("status", status).drop("_known")


@query(f"""{_W} SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 400 WHEN d.deck_id IS NULL THEN 404 ELSE 200 END AS status
FROM orders LEFT JOIN titles d ON d.deck_id = o_custkey""")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of requests, which orders stand for: each asks for the deck of its customer's number and an order by its priority."""
    star = Star(spark, sf_dir)
    requests = star.read("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("deck_id"), F.col("o_orderpriority").alias("kind"))
    return answers(requests, star.titles()).select("request_id", "status")


@query("SELECT doc_id, length(text) > 200 AS refused FROM documents")
def validation(spark: SparkSession, sf_dir: str, limit: int = 200) -> DataFrame:
    """Texts that are too long to be parsed on request."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.length("text") > limit).alias("refused"))


@query(f"{_W} SELECT word_id, p_type, row_number() OVER w AS definition_index, p_brand IS DISTINCT FROM lag(p_brand) OVER w AS changed FROM (SELECT p_partkey // 4 AS word_id, p_partkey, p_type, p_brand FROM part WHERE p_type <> '') WINDOW w AS (PARTITION BY word_id ORDER BY p_partkey)")
def definition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions numbered within their word, and whether the part of speech differs from the previous one's."""
    order = Window.partitionBy("word_id").orderBy("p_partkey")
    rows = Star(spark, sf_dir).read("part").where("p_type <> ''").withColumn("word_id", F.expr(SENSE_WORD))
    before = F.lag("p_brand").over(order)
    first = F.row_number().over(order)
    return rows.select("word_id", "p_type", first.alias("definition_index"), (~F.col("p_brand").eqNullSafe(before)).alias("changed"))


@query("SELECT p_partkey, p_brand IS DISTINCT FROM lag(p_brand) OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS changed FROM part")
def lag_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("p_brand").over(Window.partitionBy(F.expr(SENSE_WORD)).orderBy("p_partkey"))
    return Star(spark, sf_dir).read("part").select("p_partkey", (~F.col("p_brand").eqNullSafe(before)).alias("changed"))


@query("SELECT p_partkey // 4 AS word_id, array_to_string(list(p_type ORDER BY p_partkey), '; ') AS definitions FROM part GROUP BY ALL")
def definitions_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Star(spark, sf_dir).read("part").groupBy(F.expr(SENSE_WORD).alias("word_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("d"))
    return rows.select("word_id", F.array_join("d.p_type", "; ").alias("definitions"))


@query("SELECT word_id, string_agg(p_brand, ',' ORDER BY first_key) AS parts_of_speech FROM (SELECT p_partkey // 4 AS word_id, p_brand, min(p_partkey) AS first_key FROM part GROUP BY ALL) GROUP BY word_id")
def word_pos_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of speech of a word's senses, each once, in the order of first appearance."""
    firsts = Star(spark, sf_dir).read("part").groupBy(F.expr(SENSE_WORD).alias("word_id"), "p_brand").agg(F.min("p_partkey").alias("first"))
    return firsts.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("first", "p_brand"))).alias("p")).select("word_id", F.array_join("p.p_brand", ",").alias("parts_of_speech"))


def in_given_order(rows: DataFrame, column: str, ids: list[int]) -> DataFrame:
    """The rows of some ids in the order in which these were given, with their place from 0; an id given twice has its first place."""
    places = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{column} long, place int")
    return rows.join(F.broadcast(places), column).orderBy("place")  # as many as were asked for


#: Words asked for in an order of their own.
ASKED = [42, 7, 19, 3, 42, 100, 11]


@query(f"SELECT p_partkey AS word_id, p_name AS word, CAST(i AS INT) AS place FROM part JOIN (SELECT row_number() OVER (ORDER BY min(i)) - 1 AS i, w FROM (SELECT unnest({ASKED}) AS w, unnest(range({len(ASKED)})) AS i) GROUP BY w) ON p_partkey = w")
def words_as_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Star(spark, sf_dir).words().select("word_id", F.col("p_name").alias("word"))
    return in_given_order(words, "word_id", ASKED)


@query("SELECT s_suppkey + 1 AS deck_id, s_suppkey % 3 = 0 AS defaulted, CASE WHEN s_suppkey % 3 <> 0 THEN '2020-01-01' END AS given FROM supplier")
def deck_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works without a date of creation get the time of the load."""
    titles = Star(spark, sf_dir).titles()
    given = F.when((F.col("deck_id") - 1) % 3 != 0, F.to_timestamp(F.lit("2020-01-01")))
    created = F.coalesce(given, F.current_timestamp())
    return titles.select("deck_id", (created >= F.current_timestamp()).alias("defaulted"), F.date_format(given, "yyyy-MM-dd").alias("given"))
