"""Dictionary sources: XML entries, entity names, furigana and pitch files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "ent_seq INT, k_ele ARRAY<STRUCT<keb: STRING, ke_pri: ARRAY<STRING>>>, r_ele ARRAY<STRUCT<reb: STRING, re_restr: ARRAY<STRING>, re_inf: ARRAY<STRING>, re_pri: ARRAY<STRING>>>, sense ARRAY<STRUCT<stagr: ARRAY<STRING>, pos: ARRAY<STRING>, misc: ARRAY<STRING>, gloss: ARRAY<STRUCT<_VALUE: STRING, `_xml:lang`: STRING>>>>"


def entries(xml: Column) -> Column:
    """An entry of the dictionary from its XML; entity references become their names, which are the codes wanted."""
    return F.from_xml(F.regexp_replace(xml, r"&(\w[\w-]*);", "$1"), ENTRY)


def words(parsed: DataFrame) -> DataFrame:
    """word_id, readings, reading_types, obsolete, parts_of_speech of parsed(entry)."""
    e = F.col("entry")
    kanji = F.coalesce(F.transform(e["k_ele"], lambda k: k["keb"]), F.array())
    usable = F.filter(e["r_ele"], lambda r: ~F.array_contains(F.coalesce(r["re_inf"], F.array(F.lit(""))), "ok"))
    kana = F.transform(usable, lambda r: r["reb"])
    obsolete = F.transform(F.filter(e["r_ele"], lambda r: F.array_contains(F.coalesce(r["re_inf"], F.array(F.lit(""))), "ok")), lambda r: r["reb"])
    pos = F.array_distinct(F.flatten(F.transform(e["sense"], lambda s: F.concat(F.coalesce(s["pos"], F.array()), F.coalesce(s["misc"], F.array())))))
    return parsed.select(
        e["ent_seq"].alias("word_id"), F.concat(kanji, kana).alias("readings"), F.concat(F.transform(kanji, lambda _: F.lit(0)), F.transform(kana, lambda _: F.lit(1))).alias("reading_types"), obsolete.alias("obsolete"), pos.alias("parts_of_speech"),
    )


def definitions(parsed: DataFrame) -> DataFrame:
    """word_id, sense from 0, parts_of_speech, meanings by language; glosses without a language are English."""
    senses = parsed.select(F.col("entry.ent_seq").alias("word_id"), F.posexplode("entry.sense").alias("sense", "s"))
    lang = F.coalesce(F.col("g")["_xml:lang"], F.lit("eng"))
    glosses = senses.select("word_id", "sense", F.col("s.pos").alias("parts_of_speech"), F.posexplode("s.gloss").alias("i", "g")).select("word_id", "sense", "parts_of_speech", "i", lang.alias("lang"), F.col("g")["_VALUE"].alias("meaning"))
    by = glosses.groupBy("word_id", "sense", "parts_of_speech", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "meaning"))).alias("m"))
    return by.groupBy("word_id", "sense", "parts_of_speech").agg(F.map_from_entries(F.collect_list(F.struct("lang", "m.meaning"))).alias("meanings"))


def entity_names(lines: DataFrame) -> DataFrame:
    """name, value of the entity declarations among lines(line)."""
    found = lines.select(F.regexp_extract("line", '<!ENTITY (.*) "(.*)">', 1).alias("name"), F.regexp_extract("line", '<!ENTITY (.*) "(.*)">', 2).alias("value"))
    return found.where("name <> ''")


def furigana(rows: DataFrame) -> DataFrame:
    """text, reading, furigana as ruby[rt], of rows(pos, text, reading, furigana); the first for each text wins."""
    joined = F.array_join(F.transform("furigana", lambda x: F.when(x["rt"].isNull() | (x["rt"] == ""), x["ruby"]).otherwise(F.concat(x["ruby"], F.lit("["), x["rt"], F.lit("]")))), "")
    return rows.withColumn("joined", joined).groupBy("text").agg(F.min_by("reading", "pos").alias("reading"), F.min_by("joined", "pos").alias("furigana"))


def pitches(rows: DataFrame) -> DataFrame:
    """word, positions of rows(pos, bank): bank is the JSON text of [word, type, {reading, pitches}]; the first for each word wins."""
    parts = F.from_json("bank", "array<string>")
    detail = F.from_json(F.get(parts, F.lit(2)), "reading string, pitches array<struct<position: int>>")
    read = rows.select("pos", F.get(parts, F.lit(0)).alias("word"), detail.alias("d")).select("pos", "word", F.col("d.pitches.position").alias("positions"))
    first = F.row_number().over(Window.partitionBy("word").orderBy("pos"))
    return read.withColumn("n", first).where("n = 1").select("word", "positions")


def allowed_readings(restriction: Column, seen: Column) -> Column:
    """Whether a reading or sense applies: it has no restriction, or one of its forms has been seen."""
    return (F.coalesce(F.size(restriction), F.lit(0)) <= 0) | F.arrays_overlap(restriction, seen)


def shown_reading(word: Column, first_kana: Column, known: Column) -> Column:
    """Furigana of a word: a single kanji with its first kana reading, else the known form, else the word itself."""
    return F.when(word.rlike(r"^[\p{InCJKUnifiedIdeographs}]$") & first_kana.isNotNull(), F.concat(word, F.lit("["), first_kana, F.lit("]"))).otherwise(F.coalesce(known, word))


def read_json_banks(spark: SparkSession, path: str) -> DataFrame:
    """pos, bank of files that are one JSON array each."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "bank"))
