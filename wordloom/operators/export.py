"""Exports of a work's vocabulary: CSV rows, plain readings, readings repeated by occurrences, flash-card fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.star import STAR_SQL, Star
from .browsing import DECK, found, with_rank

_W = f"WITH {STAR_SQL}"


def export_rows(star: Star, deck_id: int = DECK) -> DataFrame:
    """A deck's words with readings, ranks and definitions; an unknown deck is refused."""
    found(star.titles(), deck_id=deck_id)
    words = with_rank(star.parent_words().where(F.col("deck_id") == deck_id), star)
    return words.join(star.readings().drop("reading_type"), ["word_id", "reading_index"]).join(star.words(), "word_id")


@query(f"""{_W} SELECT reading AS "Reading", reading AS "ReadingFurigana", regexp_replace(reading, '[^A-Z]', '', 'g') AS "ReadingKana", occurrences AS "Occurences", reading_rank AS "ReadingFrequency", p_size AS "PitchPositions", replace(p_type || ' "' || p_brand || '"', '"', '""') AS "Definitions"
FROM pw JOIN rr USING (word_id, reading_index) JOIN part ON p_partkey = word_id WHERE deck_id = 1""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the CSV export; quotes are doubled in the definitions only. Write with quoteAll."""
    rows = export_rows(Star(spark, sf_dir))
    quoted = F.replace(F.concat("p_type", F.lit(' "'), "p_brand", F.lit('"')), F.lit('"'), F.lit('""'))
    return rows.select(F.col("reading").alias("Reading"), F.col("reading").alias("ReadingFurigana"), F.regexp_replace("reading", "[^A-Z]", "").alias("ReadingKana"), F.col("occurrences").alias("Occurences"), F.col("reading_rank").alias("ReadingFrequency"), F.col("p_size").alias("PitchPositions"), quoted.alias("Definitions"))


@query(f"{_W} SELECT reading FROM pw JOIN readings USING (word_id, reading_index) WHERE deck_id = 1")
def export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(Star(spark, sf_dir)).select("reading")


@query(f"{_W} SELECT reading, count(*) AS lines FROM (SELECT reading, unnest(range(occurrences)) FROM pw JOIN readings USING (word_id, reading_index) WHERE deck_id = 1) GROUP BY reading")
def export_txt_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings, each as many times as it occurs; counted here, as the lines of one reading are all alike."""
    lines = export_rows(Star(spark, sf_dir)).select(F.explode(F.array_repeat("reading", F.col("occurrences").cast("int"))).alias("reading"))
    return lines.groupBy("reading").agg(F.count("*").alias("lines"))


#: The fields of a card, in order.
CARD = (
    "Expression", "ExpressionFurigana", "ExpressionReading", "ExpressionAudio", "SelectionText", "MainDefinition", "DefinitionPicture", "Sentence", "SentenceFurigana", "SentenceAudio", "Picture",
    "Glossary", "Hint", "IsWordAndSentenceCard", "IsClickCard", "IsSentenceCard", "PitchPosition", "PitchCategories", "Frequency", "FreqSort", "Occurrences", "MiscInfo",
)


def cards(rows: DataFrame, filled: dict[str, Column]) -> DataFrame:
    """All fields of flash cards as strings, in order: those given, and empty ones."""
    unknown = set(filled) - set(CARD)
    if unknown:
        raise ValueError(f"a card has no such fields: {sorted(unknown)}")
    return rows.select(*(filled.get(name, F.lit("")).cast("string").alias(name) for name in CARD))


_FILLED = {
    "Expression": "reading", "ExpressionFurigana": "regexp_replace(reading, '#', '[') || ']'", "ExpressionReading": "regexp_replace(reading, '[^A-Z]', '', 'g')",
    "MainDefinition": "'<ul><li>' || p_type || '</li><li>' || p_brand || '</li></ul>'", "PitchPosition": "CAST(p_size AS VARCHAR)",
    "Frequency": "'<ul><li>' || occurrences || ' occurrences ; #' || reading_rank || ' global rank</li></ul>'", "FreqSort": "CAST(reading_rank AS VARCHAR)", "Occurrences": "CAST(occurrences AS VARCHAR)", "MiscInfo": "'From ' || original_title",
}
_FIELDS = ", ".join(f"""{_FILLED.get(name, "''")} AS "{name}\"""" for name in CARD)


@query(f"{_W} SELECT {_FIELDS} FROM pw JOIN rr USING (word_id, reading_index) JOIN part ON p_partkey = word_id JOIN titles USING (deck_id) WHERE deck_id = 1")
def export_anki_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flash cards of a deck's words: every field, in the order of the note type."""
    star = Star(spark, sf_dir)
    rows = export_rows(star).join(star.titles().select("deck_id", "original_title"), "deck_id")
    definitions = F.concat(F.lit("<ul>"), *(F.concat(F.lit("<li>"), F.col(c), F.lit("</li>")) for c in ("p_type", "p_brand")), F.lit("</ul>"))
    return cards(rows, {
        "Expression": F.col("reading"), "ExpressionFurigana": F.concat(F.regexp_replace("reading", "#", "["), F.lit("]")), "ExpressionReading": F.regexp_replace("reading", "[^A-Z]", ""), "MainDefinition": definitions, "PitchPosition": F.col("p_size"),
        "Frequency": F.format_string("<ul><li>%d occurrences ; #%d global rank</li></ul>", "occurrences", "reading_rank"), "FreqSort": F.col("reading_rank"), "Occurrences": F.col("occurrences"), "MiscInfo": F.concat(F.lit("From "), F.col("original_title")),
    })


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select(rows.columns[0]).write.text(path)
