"""The column functions as queries over the tables, or over small tables of their own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.documents import TOKENS_SQL, Corpus
from ..plans.registry import query
from . import text as t


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '０１２３４５６７８９') AS wide, CAST(o_orderkey AS VARCHAR) AS narrow FROM orders")
def fn_digit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = t.wide_digits(F.col("o_orderkey").cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", wide.alias("wide"), t.narrow_digits(wide).alias("narrow"))


@query("SELECT page_id, replace(replace(html, '<', ' '), '>', ' ') AS clean FROM pages")
def fn_preclean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", t.precleaned(F.col("html")).alias("clean"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, pos, regexp_replace(token, '[^a-zA-Z0-9]', '', 'g') AS clean FROM tok")
def fn_token_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).tokens().select("doc_id", "pos", t.cleaned_token(F.col("token")).alias("clean"))


@query(r"SELECT doc_id, len(s) AS n, coalesce(s[1], '') AS first FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, e' \n\t')), lambda x: x <> '') AS s FROM documents)")
def fn_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").withColumn("s", t.sentences(F.col("text")))
    return rows.select("doc_id", F.size("s").alias("n"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


@query("SELECT p_partkey, p_name AS plain FROM part")
def fn_strip_ruby(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("p_name", F.lit("["), "p_type", F.lit("]"))
    return _table(spark, sf_dir, "part").select("p_partkey", t.stripped_ruby(marked).alias("plain"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s = 0 THEN '0' WHEN s <= 0.1 THEN '<0.1' WHEN s < 1 THEN '<1' WHEN s > 99 AND s < 100 THEN '>99' ELSE CAST(CAST(floor(s) AS BIGINT) AS VARCHAR) END AS shown FROM (SELECT *, l_tax * l_quantity * 25 AS s FROM lineitem)")
def fn_pct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("l_tax") * F.col("l_quantity") * 25
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.approximate_percentage(share).alias("shown"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '-r' ELSE s_name || ' (en)' END AS title FROM supplier")
def fn_localise_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat("s_name", F.lit(" (en)")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", t.localised_title(F.col("s_name"), F.concat("s_name", F.lit("-r")), english).alias("title"))


@query("SELECT n_nationkey, coalesce(['Anime', 'Drama', 'Movie', 'Novel', 'Non-Fiction', 'Video Game', 'Visual Novel', 'Web Novel', 'Manga'][n_nationkey % 10 + 1], 'Unknown') AS label FROM nation")
def fn_media_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", t.media_label(F.col("n_nationkey") % 10 + 1).alias("label"))


_CODES = ["n", "adj-i", "adj-na", "adv", "v1", "v5k", "vs", "prt", "int", "exp", "conj", "pn", "pref", "suf", "ctr", "aux-v", "uk", "xyz"]
_CODE_SQL = f"SELECT p_partkey, {_CODES!r}[p_partkey % {len(_CODES)} + 1] AS code FROM part"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for each part of the catalogue."""
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % len(_CODES)).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


@query(f"""SELECT p_partkey, code, CASE code WHEN 'n' THEN 'noun' WHEN 'adj-i' THEN 'i-adjective' WHEN 'adj-na' THEN 'na-adjective' WHEN 'adv' THEN 'adverb' WHEN 'v1' THEN 'ichidan verb' WHEN 'vs' THEN 'suru verb' WHEN 'prt' THEN 'particle'
  WHEN 'int' THEN 'interjection' WHEN 'exp' THEN 'expression' WHEN 'conj' THEN 'conjunction' WHEN 'pn' THEN 'pronoun' WHEN 'pref' THEN 'prefix' WHEN 'suf' THEN 'suffix' WHEN 'ctr' THEN 'counter' WHEN 'uk' THEN 'usually kana' ELSE code END AS label FROM ({_CODE_SQL})""")
def fn_pos_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("p_partkey", "code", F.get(t.pos_labels(F.array("code")), F.lit(0)).alias("label"))


@query(f"""SELECT p_partkey, code, CASE WHEN code = 'n' THEN 'Noun' WHEN code = 'adj-i' THEN 'IAdjective' WHEN starts_with(code, 'v') THEN 'Verb' WHEN code = 'adj-na' THEN 'NaAdjective' WHEN code = 'adv' THEN 'Adverb' WHEN code = 'prt' THEN 'Particle' WHEN code = 'conj' THEN 'Conjunction'
  WHEN starts_with(code, 'aux') THEN 'Auxiliary' WHEN code = 'pn' THEN 'Pronoun' WHEN code = 'int' THEN 'Interjection' WHEN code = 'pref' THEN 'Prefix' WHEN code = 'suf' THEN 'Suffix' WHEN code = 'ctr' THEN 'Counter' WHEN code = 'exp' THEN 'Expression' ELSE 'Unknown' END AS kind FROM ({_CODE_SQL})""")
def fn_pos_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("p_partkey", "code", t.pos_kind(F.col("code")).alias("kind"))


@query("SELECT c_custkey, c_mktsegment || ' ; ' || c_name AS shown FROM customer")
def fn_conjugation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array("c_name", F.lit("(stem)"), F.lit(" "), "c_mktsegment")
    return _table(spark, sf_dir, "customer").select("c_custkey", t.conjugation_text(steps).alias("shown"))


@query("SELECT event_id, replace(props, '\"', '\"\"') AS quoted FROM events")
def fn_csv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", t.csv_quoted(F.col("props")).alias("quoted"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS value FROM events")
def fn_zero_if_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    maybe = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").select("event_id", t.zero_if_nan(maybe).alias("value"))


@query("SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE round(CAST(CAST(n_chars / n AS FLOAT) AS DOUBLE), 3) END AS DOUBLE) AS average FROM (SELECT doc_id, n_chars, len(regexp_extract_all(text, '[.!?]')) AS n FROM documents)")
def fn_avg_sentence_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[.!?]"))
    average = F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.try_divide("n_chars", n).cast("float").cast("double"), 3))
    return _table(spark, sf_dir, "documents").select("doc_id", average.alias("average"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN make_date(year(o_orderdate), 1, 1) WHEN 2 THEN DATE '2099-01-01' ELSE DATE '0001-01-01' END AS VARCHAR) AS released FROM orders""")
def fn_lenient_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    given = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.date_format("o_orderdate", "yyyy")).when(kind == 2, "tba").otherwise("soon")
    return _table(spark, sf_dir, "orders").select("o_orderkey", t.lenient_date(given).cast("string").alias("released"))


@query("""WITH p AS (
  SELECT p_partkey, p_partkey % 2 = 0 AS ichi1, p_partkey % 3 = 0 AS news2, p_partkey % 5 = 0 AS gai1, p_partkey % 7 = 0 AS nf, p_size, p_partkey % 4 = 1 AS spec1, p_partkey % 11 < 5 AS uk, p_partkey % 13 < 6 AS kana FROM part),
q AS (SELECT *, ichi1::INT * 20 + news2::INT * 10 + gai1::INT * 5 + CASE WHEN nf THEN greatest(0, 5 - CAST(round_even(p_size / 10, 0) AS INT)) ELSE 0 END AS points FROM p)
SELECT p_partkey, CASE WHEN NOT (ichi1 OR news2 OR gai1 OR nf OR spec1) THEN 0 ELSE CASE WHEN points = 0 AND spec1 THEN 15 ELSE points END + CASE WHEN NOT uk THEN 0 WHEN kana THEN 10 ELSE -10 END END AS score FROM q""")
def fn_priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of priority by a part's key, the frequency band by its size."""
    key = F.col("p_partkey")
    band = F.concat(F.lit("nf"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    tags = F.array_compact(F.array(F.when(key % 2 == 0, "ichi1"), F.when(key % 3 == 0, "news2"), F.when(key % 5 == 0, "gai1"), F.when(key % 7 == 0, band), F.when(key % 4 == 1, "spec1")))
    return _table(spark, sf_dir, "part").select("p_partkey", t.priority_score(tags, key % 11 < 5, key % 13 < 6).alias("score"))


#: Letters as katakana, so that names of parts are words of kana, with long marks.
_LATIN, _KANA = "abcdefghijklmnopqrstuvwxyz ", "アカサデエフゲヒイジケレムノオプクルスーウヴワガヨゾン"
_KANA_SQL = f"SELECT p_partkey, translate(lower(p_name), '{_LATIN}', '{_KANA}') AS word FROM part"


def _kana_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.translate(F.lower("p_name"), _LATIN, _KANA).alias("word"))


def _long_sql(text: str) -> str:
    vowels = {"あ": "あかさたなはまやらわがざだばぱぁゃゎ", "い": "いきしちにひみりぎじぢびぴぃ", "う": "うくすつぬふむゆるぐずづぶぷぅゅ", "え": "えけせてねへめれげぜでべぺぇ", "お": "おこそとのほもよろをごぞどぼぽぉょ"}
    for vowel, kana in vowels.items():
        text = f"regexp_replace({text}, '([{kana}])ー', '\\1{'う' if vowel == 'お' else vowel}', 'g')"
    return text


@query(f"SELECT p_partkey, word, h AS plain, {_long_sql('h')} AS long, translate(h, '{t.HIRAGANA}', '{t.KATAKANA}') AS katakana FROM (SELECT *, translate(word, '{t.KATAKANA}', '{t.HIRAGANA}') AS h FROM ({_KANA_SQL}))")
def fn_to_hiragana(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word")
    return _kana_words(spark, sf_dir).select("p_partkey", "word", t.to_hiragana(word).alias("plain"), t.to_hiragana(word, True).alias("long"), t.to_katakana(t.to_hiragana(word)).alias("katakana"))


_RUBY_SQL = r"regexp_replace(word, '([一-龯々]+)\[(.+?)\]', '<ruby>\1<rp>(</rp><rt>\2</rt><rp>)</rp></ruby>', 'g')"


@query(rf"""WITH w AS (SELECT p_partkey, CAST(p_size % 5 AS INT) AS accent, translate(word, '{t.KATAKANA}', '{t.HIRAGANA}') AS r, CASE p_partkey % 3 WHEN 0 THEN '食' WHEN 1 THEN '日本' ELSE '人々' END AS k FROM ({_KANA_SQL}) JOIN part USING (p_partkey)),
f AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN k || '[' || r || ']' ELSE k || '[' || r || ']べ物[もの]' END AS word FROM w),
m AS (SELECT *, len(regexp_extract_all(regexp_replace(word, '[一-鿿\[\]]', '', 'g'), '[぀-ヿ][ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ]?')) AS n FROM f)
SELECT p_partkey, word, regexp_replace(word, '[^぀-ヿ]', '', 'g') AS kana, regexp_replace(word, '([^\s一-鿿])([一-鿿]+\[)', '\1 \2', 'g') AS spaced, {_RUBY_SQL} AS ruby,
  array_to_string(list_transform(range(1, n + 2), lambda i: CASE WHEN CASE accent WHEN 0 THEN i > 1 WHEN 1 THEN i = 1 ELSE i > 1 AND i <= accent END THEN 'H' ELSE 'L' END), '') AS pitch FROM m""")
def fn_furigana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of kanji with kana made of a part's name, and an accent by its size."""
    key = F.col("p_partkey")
    kanji = F.when(key % 3 == 0, "食").when(key % 3 == 1, "日本").otherwise("人々")
    given = _kana_words(spark, sf_dir).join(_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).cast("int").alias("accent")), "p_partkey")
    bracketed = F.concat(kanji, F.lit("["), t.to_hiragana(F.col("word")), F.lit("]"))
    word = F.col("furigana")
    given = given.select("p_partkey", "accent", F.when(key % 2 == 0, bracketed).otherwise(F.concat(bracketed, F.lit("べ物[もの]"))).alias("furigana"))
    return given.select("p_partkey", word.alias("word"), t.kana_of(word).alias("kana"), t.spaced_furigana(word).alias("spaced"), t.ruby_markup(word).alias("ruby"), t.pitch_pattern(word, F.col("accent")).alias("pitch"))


#: Vowels as kana, so that documents have what a tokenizer is given, among what it isn't.
_VOWELS, _VOWEL_KANA = "aeiou", "あえいおう"
_GIVEN_SQL = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", t.INPUT)


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE translate(text, '{_VOWELS}', '{_VOWEL_KANA}') END AS t FROM documents),
k AS (SELECT doc_id, regexp_replace(translate(t, '0123456789', '{t.WIDE_DIGITS}'), '{_GIVEN_SQL}', '', 'g') AS g FROM d)
SELECT doc_id, CASE WHEN regexp_full_match(g, '[\x00-\x7FĀāĒēĪīŌōŪūÂâÊêÎîÔôÛû‘’“”]*') THEN '' ELSE g END AS given FROM k""")
def fn_tokenizer_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their vowels as kana, but for every fifth one, which has nothing Japanese."""
    text = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.translate("text", _VOWELS, _VOWEL_KANA))
    return _table(spark, sf_dir, "documents").select("doc_id", t.tokenizer_input(text).alias("given"))


@query(f"SELECT p_partkey, word, replace(word, 'ッー', '') AS plain, translate(word, 'ゎヮ', 'わわ') AS wa, regexp_full_match(word, '[一-龯々]+') AS kanji, regexp_full_match(word, '[ -~]+') AS romaji FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN word || 'ッー' WHEN 1 THEN 'ヮ' || word || 'ゎ' WHEN 2 THEN '人々' ELSE p_name END AS word FROM ({_KANA_SQL}) JOIN part USING (p_partkey))")
def fn_word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    words = _kana_words(spark, sf_dir).join(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    words = words.select("p_partkey", F.when(key % 4 == 0, F.concat("word", F.lit("ッー"))).when(key % 4 == 1, F.concat(F.lit("ヮ"), "word", F.lit("ゎ"))).when(key % 4 == 2, "人々").otherwise(F.col("p_name")).alias("word"))
    word = F.col("word")
    return words.select("p_partkey", "word", t.without_drawn_out(word).alias("plain"), t.large_wa(word).alias("wa"), t.is_kanji(word).alias("kanji"), t.is_romaji(word).alias("romaji"))


@query("SELECT s_suppkey, substr(s_name || '-' || s_suppkey || '-a rather long title of a work', 1, 30) AS file_name FROM supplier")
def fn_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select("s_suppkey", t.file_name(F.concat("s_name", F.lit("-"), F.col("s_suppkey").cast("string"), F.lit("-a rather long title of a work"))).alias("file_name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '|' || p_type END AS parts FROM part""")
def fn_json_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One string or a list of strings in JSON, as a list."""
    part = _table(spark, sf_dir, "part")
    json = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise(F.to_json(F.array("p_brand", "p_type")))
    return part.select("p_partkey", F.array_join(t.listed(json), "|").alias("parts"))
