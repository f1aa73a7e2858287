"""Extractors: lines of scripts, subtitles and OCR turned into plain text.

Each takes lines(file, line_no, line) and returns file, line_no, text of the lines it keeps. What an extractor knows of
its format is its patterns; filtering, looking at the line before, and replacing are the DataFrame's.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Beginnings of lines that are code, by format.
GENERIC_CODE = ["*", "$", "{", "}", ";", "tf", "if", "var", "for", "sf", "kag", "extra", "dispose", "function", "/", "else", "class", "return", "sys", "nvl", "[eval", "[bg", "@", "<", "^", "none", "\\", "○", "●", "#"]
KRKR_CODE = [";", "@", "}", "tf", "if", "kag", "f.", "["]
CS2_CODE = ["#", "undo", "bg", "cg", "fg", "eg", "fw", "pl", "part", "plac", "wait", "auto", "draw", "wipe", "frame", "novel", "view", "se", "rdraw", "rwipe", "next", "pcm", "wbreak", "if", "fselect", "fes", "wiat", "str", "jump", "movie", "title", "end_of", "init", "sysbtn", "keyskip"]
SUBTITLE_NOTES = ["---", "本字幕由", "更多中日", "本整理", "压制", "日听", "校对", "时轴", "台本整理", "听翻", "翻译", "ED", "OP", "字幕", "诸神", "负责", "阿里", "日校", "翻译", "校对", "片源", "◎", "m"]
#: Control codes that are dropped within lines.
CS2_CODES = [r"\\r", r"\\pc", r"\\p", r"\\@", r"\\n", r"\\fl", r"\\f\d+;", r"\\w0;", r"\\fs", r"\\fn", r"\\m", "・"]
NEXAS_CODES = ["^ことね$", "^達観$", "^海希$", "^千尋$", "^結$", "^根津$", r"@v\d+", "@n", r"@m\d+", r"@t\d+", r"@s\d+", "@k", "@e", "@d", r"^(?!.*[\u3040-\u30FF\u4E00-\u9FFF]).*$", r"@h[a-zA-Z\d_]+(?![\u3040-\u30FF\u4E00-\u9FFF])", "2", "@h", "@r", "@"]
OCR_NOISE = [("^[０-９Ａ-Ｚａ-ｚ－一．第話第章：]*$", ""), ("^[．！？]*$", ""), ("．．．．*", "．．．"), (r"^[\u3040-\u309F\u30A0-\u30FF][．！？]*$", ""), ("[Ａ-Ｚａ-ｚ：／．]{3,}", "")]

TAGS = r"\[.*?\]"


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """lines(file, line_no, line) of all files under a path; other encodings than UTF-8 are decoded from the bytes, file by file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content")
    if encoding.lower() in ("utf-8", "utf8"):
        text = F.decode("content", "UTF-8")
    else:

        @F.arrow_udf("string")
        def decoded(contents: pa.Array) -> pa.Array:
            return pa.array([None if c is None else c.decode(encoding, errors="replace") for c in contents.to_pylist()], pa.string())

        text = decoded(F.col("content"))
    return files.select("file", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "line"))


def _starts(text: Column, beginnings: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(re.escape(b) for b in beginnings) + ")")


def _without(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def _kept(lines: DataFrame, text: Column, blanks: bool = False) -> DataFrame:
    out = lines.select("file", "line_no", text.alias("text"))
    return out if blanks else out.where(F.trim("text", F.lit(" \t　")) != "")


def _before(lines: DataFrame) -> Column:
    return F.lag("line").over(Window.partitionBy("file").orderBy("line_no"))


def plain(lines: DataFrame) -> DataFrame:
    return _kept(lines, F.trim("line"))


def generic(lines: DataFrame) -> DataFrame:
    """Code lines dropped; ruby [kanji'reading] as kanji; tags dropped."""
    kept = lines.where((F.ltrim("line") != "") & ~_starts(F.ltrim("line"), GENERIC_CODE))
    return _kept(kept, F.regexp_replace(F.regexp_replace(F.ltrim("line"), r"\[(.*?)'.*?\]", "$1"), TAGS, ""))


def krkr(lines: DataFrame) -> DataFrame:
    """Code lines dropped, a leading tab too; ruby and tags as in generic. Lines that end blank stay."""
    kept = lines.where((F.trim("line") != "") & ~_starts(F.trim("line"), KRKR_CODE))
    return _kept(kept, F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^\t", ""), r"\[(.*?)'.*?\]", "$1"), TAGS, ""), blanks=True)


def after_marker(lines: DataFrame, marker: str, pattern: str) -> DataFrame:
    """Of each line that follows a marker line, what the pattern's group finds."""
    marked = lines.withColumn("_before", _before(lines)).where((F.col("_before") == marker) & (F.col("line") != marker))
    return _kept(marked, F.regexp_extract("line", pattern, 1))


#: Codes within messages.
MSC_CODES = ("']", "_n_r", "'", "\\u3000", "_n", "\\\\n")


def msc(lines: DataFrame, marker: str = "#1-MESSAGE") -> DataFrame:
    found = after_marker(lines, marker, r"'([^']*)'")
    text = F.col("text")
    for literal in MSC_CODES:
        text = F.replace(text, F.lit(literal), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "【.*?】", ""), "“<(.*?),.*?>”", "$1"), "<(.*?),.*?>", "$1")
    return _kept(found, _without(text, [TAGS]))


def mes(lines: DataFrame) -> DataFrame:
    return _kept(found := after_marker(lines, "#1-STR_UNCRYPT", '"([^"]*)"'), F.trim(found["text"]))


def cs2(lines: DataFrame) -> DataFrame:
    """Control codes and code lines dropped; choices without their code; ruby [k/r] as k; speakers before quotes dropped."""
    coded = lines.withColumn("line", F.trim(_without(F.col("line"), CS2_CODES)))
    text = F.regexp_replace(F.regexp_replace("line", r"^\d+\s+\S+\s+", ""), r"\[(.+?)/.*?\]", "$1")
    text = F.regexp_replace(text, "^.*\t(?=(?:「.*」|（.*）|『.*』)$)", "")  # a speaker before a quoted line
    return _kept(coded.where((F.col("line") != "") & ~_starts(F.col("line"), CS2_CODE)), text)


def nexas(lines: DataFrame) -> DataFrame:
    follows = lines.withColumn("_before", _before(lines)).where(F.startswith("_before", F.lit("○")) & ~F.startswith("line", F.lit("○")))
    return _kept(follows, _without(F.col("line"), NEXAS_CODES))


def whale(lines: DataFrame) -> DataFrame:
    """Lines that begin with kana, kanji or a speaker; of a speaker's line the quoted part."""
    quoted = F.regexp_extract("line", "[「（](.+?)[」）s]", 0)
    text = F.when(F.startswith("line", F.lit("【")) & (quoted != ""), quoted).otherwise(F.col("line"))
    return _kept(lines.where(F.col("line").rlike(r"^[\p{InHiragana}\p{InKatakana}\p{InCJKUnifiedIdeographs}【]")), F.trim(F.replace(text, F.lit("[n]"), F.lit(""))))


def yuris(lines: DataFrame) -> DataFrame:
    return _kept(lines, F.regexp_replace("line", "^[^「]*「", "「"))


def utf(lines: DataFrame) -> DataFrame:
    kept = lines.where((F.trim("line") != "") & ~F.contains("line", F.lit("GS")) & ~F.contains("line", F.lit("::")))
    return _kept(kept, F.trim(_without(F.trim("line"), ["^-", "=", ">>", "<.{4}>"])), blanks=True)


def bgi(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Messages behind the second ◇, but for names(name) standing alone and messages beginning with an underscore."""
    found = lines.select("file", "line_no", F.regexp_extract("line", "◇.+◇(.+)$", 1).alias("text")).where("text <> ''")
    found = found.withColumn("name", F.trim("text")).join(names, "name", "left_anti").where(~F.startswith("text", F.lit("_")))
    return _kept(found, F.replace(_without(F.col("text"), [TAGS, r"\{.*?\}"]), F.lit("( 、)"), F.lit("")))


def psb(scenes: DataFrame) -> DataFrame:
    """file, text of scenes(file, scenes array<struct<texts: array<array<string>>>>): the third item of each text."""
    texts = scenes.select("file", F.explode("scenes").alias("s")).select("file", F.explode("s.texts").alias("t")).select("file", F.get("t", F.lit(2)).alias("text"))
    return texts.where("text is not null").select("file", F.replace(F.regexp_replace("text", TAGS, ""), F.lit("\\n"), F.lit("")).alias("text"))


def mokuro(pages: DataFrame) -> DataFrame:
    """file, text of pages(file, blocks array<struct<lines: array<string>>>): one line for each block, without OCR noise."""

    def cleaned(x: Column) -> Column:
        for pattern, by in OCR_NOISE:
            x = F.regexp_replace(x, pattern, by)
        return F.trim(x)

    blocks = pages.select("file", F.explode("blocks").alias("b"))
    return blocks.select("file", F.array_join(F.filter(F.transform("b.lines", cleaned), lambda x: x != ""), "").alias("text"))


def subtitle_lines(lines: DataFrame) -> DataFrame:
    """Spoken lines of .srt and .ass/.ssa files: numbers, times and headers dropped, of dialogue lines the text behind the ninth comma."""
    ass = F.lower("file").rlike(r"\.(ass|ssa)$")
    spoken = F.regexp_replace(F.regexp_extract("line", r"^Dialogue:(?:[^,]*,){9}(.*)$", 1), r"\{.*?\}", "")
    srt = F.when(F.trim("line").rlike(r"^\d+$|-->"), "").otherwise(F.regexp_replace("line", "<[^>]*>", ""))
    kept = lines.where(~(ass & (F.startswith(F.ltrim("line"), F.lit(";")) | F.contains("line", F.lit("cn")))))
    text = kept.select("file", "line_no", F.posexplode(F.split(F.when(ass, spoken).otherwise(srt), r"\\[Nn]")).alias("part", "text"))
    return text.where(F.trim("text") != "").select("file", "line_no", F.trim("text").alias("text"))


def clean_subtitles(lines: DataFrame, parity: bool = False) -> DataFrame:
    """Notes of subtitlers and bracketed parts dropped. In parity only what stands behind the last note is cleaned, as there the cleaning goes backwards and stops."""
    trimmed = F.trim("line")
    cleaned = _without(trimmed, [r"\((.*?)\)", "（(.*?)）"])
    note = _starts(trimmed, SUBTITLE_NOTES)
    if not parity:
        return _kept(lines.where(~note), cleaned)
    last = F.max(F.when(note, F.col("line_no"))).over(Window.partitionBy("file"))
    marked = lines.withColumn("_last", F.coalesce(last, F.lit(-1)))
    text = F.when(F.col("line_no") > F.col("_last"), cleaned).otherwise(F.col("line"))
    rows = marked.where("line_no <> _last").withColumn("text", text).where((F.trim("text") != "") | (F.col("line_no") < F.col("_last")))
    return rows.select("file", "line_no", "text")


def episode(name: Column) -> Column:
    """The episode number in a file name, a large one if there is none."""
    found = F.regexp_extract(name, r"S\d{2}E([0-9]{2,4})|([0-9]{2,4})", 0)
    return F.coalesce(F.regexp_replace(found, r"^S\d{2}E", "").try_cast("int"), F.lit((1 << 31) - 1))


#: Elements whose text isn't the book's.
SILENT = ("script", "style", "title", "rt", "rp")


class _Text(HTMLParser):
    """Text nodes without scripts, styles and ruby readings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in SILENT and self.silent > 0

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


#: Names of files that are chapters.
CHAPTERS = r"\b(part\d{4,5}\.x?html|p-\d{3}\.x?html|\d{4}\.x?html)|text\d{4,5}\.x?html|index_split_\d{3}\.x?html|a_\d_\d{2}.x?html|k\d+_\d{4}.x?html\b|kd\d+_\d{4}.x?html\b"


def book_lines(content: bytes, chapters: str | None = None) -> list[str]:
    """Sentences of an e-book's files in reading order, cut behind 。！？; with chapters only of files whose names it is found in."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        package = next(n for n in book.namelist() if n.endswith(".opf"))
        opf = book.read(package).decode("utf-8", errors="replace")
        items = {i: h for tag in re.findall(r"<item\b[^>]*>", opf) for i in re.findall(r'\bid="([^"]*)"', tag) for h in re.findall(r'\bhref="([^"]*)"', tag)}
        folder = package.rpartition("/")[0]
        text = []
        for ref in re.findall(r'<itemref\b[^>]*idref="([^"]*)"', opf):
            name = f"{folder}/{items.get(ref, '')}".lstrip("/")
            if name in book.namelist() and (chapters is None or re.search(chapters, items[ref], re.ASCII)):
                parser = _Text()
                parser.feed(book.read(name).decode("utf-8", errors="replace"))
                text.append(re.sub(r"\s+", "", "".join(parser.out)))
    return [x for x in re.split("(?<=[。！？])", "".join(text)) if x.strip()]


def epub(files: DataFrame, chapters: str | None = None) -> DataFrame:
    """file, line_no, text of files(path, content); a book is one row, and its lines leave the worker one batch at a time.

    chapters is a pattern for names of files, such as CHAPTERS, that keeps title pages, contents and notes out; a book
    without such files gives no lines.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = book_lines(content, chapters)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())], names=["file", "line_no", "text"])

    return files.select("path", "content").mapInArrow(read, "file string, line_no int, text string")
