"""The extractors as queries: over the documents' lines, put into what each format has around them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.documents import LINES_SQL, Corpus
from ..plans.registry import query
from ..plans.staging import shared_dir
from . import dictionary, scripts


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).lines().withColumnRenamed("doc_id", "file")


@query(f"WITH {LINES_SQL} SELECT doc_id AS file, line_no, trim(line) AS text FROM ln WHERE trim(line, e' \\t　') <> ''")
def src_txt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.plain(_lines(spark, sf_dir))


def _starting(beginnings: list[str]) -> str:
    return " OR ".join(f"starts_with(t, '{b}')" for b in beginnings)


@query(f"WITH {LINES_SQL}, s AS (SELECT *, ltrim(line) AS t FROM ln), k AS (SELECT doc_id AS file, line_no, regexp_replace(regexp_replace(t, '\\[(.*?)''.*?\\]', '\\1', 'g'), '\\[.*?\\]', '', 'g') AS text FROM s WHERE t <> '' AND NOT ({_starting(scripts.GENERIC_CODE)})) SELECT * FROM k WHERE trim(text) <> ''")
def src_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.generic(_lines(spark, sf_dir))


@query(f"WITH {LINES_SQL}, s AS (SELECT *, trim(line) AS t FROM ln) SELECT doc_id AS file, line_no, regexp_replace(regexp_replace(regexp_replace(line, '^\\t', ''), '\\[(.*?)''.*?\\]', '\\1', 'g'), '\\[.*?\\]', '', 'g') AS text FROM s WHERE t <> '' AND NOT ({_starting(scripts.KRKR_CODE)})")
def src_krkr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.krkr(_lines(spark, sf_dir))


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_id, 2 * line_no AS line_no, line FROM ln UNION ALL SELECT doc_id, 2 * line_no - 1, '#1-MESSAGE' FROM ln WHERE line_no % 3 = 0), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM m) SELECT doc_id AS file, line_no, regexp_extract(line, '(\\w+) \\w+\\.', 1) AS text FROM b WHERE prev = '#1-MESSAGE' AND line <> '#1-MESSAGE' AND regexp_extract(line, '(\\w+) \\w+\\.', 1) <> ''")
def src_marker_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind marker lines, which are put before every third line here."""
    lines = _lines(spark, sf_dir)
    marked = lines.select("file", (2 * F.col("line_no")).alias("line_no"), "line").union(lines.where("line_no % 3 = 0").select("file", 2 * F.col("line_no") - 1, F.lit("#1-MESSAGE")))
    return scripts.after_marker(marked, "#1-MESSAGE", r"(\w+) \w+\.")


@query(f"WITH {LINES_SQL} SELECT doc_id AS file, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(line), '^-', ''), '=', '', 'g'), '>>', '', 'g'), '<.{{4}}>', '', 'g')) AS text FROM ln WHERE trim(line) <> '' AND NOT contains(line, 'GS') AND NOT contains(line, '::')")
def src_utf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.utf(_lines(spark, sf_dir))


@query(f"WITH {LINES_SQL}, n AS (SELECT DISTINCT trim(line) AS name FROM ln WHERE doc_id % 10 = 0) SELECT doc_id AS file, line_no, regexp_replace(regexp_replace(line, '\\[.*?\\]', '', 'g'), '\\{{.*?\\}}', '', 'g') AS text FROM ln ANTI JOIN n ON trim(line) = name WHERE trim(line) <> '' AND NOT starts_with(line, '_') AND trim(regexp_replace(regexp_replace(line, '\\[.*?\\]', '', 'g'), '\\{{.*?\\}}', '', 'g')) <> ''")
def src_bgi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put behind marks, without those that stand in a list of names, here the lines of every tenth document."""
    lines = _lines(spark, sf_dir).where(F.trim("line") != "")
    names = lines.where("file % 10 = 0").select(F.trim("line").alias("name")).distinct()
    return scripts.bgi(lines.withColumn("line", F.concat(F.lit("◇x◇"), "line")), names)


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def src_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))
    return Corpus(spark, sf_dir).pages.select("page_id", text.alias("text"))


@query("SELECT p_partkey, CAST(coalesce(nullif(regexp_replace(regexp_extract(f, 'S\\d{2}E([0-9]{2,4})|([0-9]{2,4})', 0), '^S\\d{2}E', ''), ''), '2147483647') AS INTEGER) AS episode FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x S01E' || (p_partkey % 90 + 10) || '.srt' WHEN p_partkey % 3 = 1 THEN 'y ' || (p_partkey % 900 + 10) || '.ass' ELSE 'z.srt' END AS f FROM part)")
def src_episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("x S01E"), (k % 90 + 10).cast("string"), F.lit(".srt"))).when(k % 3 == 1, F.concat(F.lit("y "), (k % 900 + 10).cast("string"), F.lit(".ass"))).otherwise("z.srt")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scripts.episode(name).alias("episode"))
    return rows.orderBy("episode", "p_partkey")


@query(f"WITH {LINES_SQL}, s AS (SELECT *, trim(line) AS t FROM ln), k AS (SELECT doc_id AS file, line_no, regexp_replace(regexp_replace(t, '\\((.*?)\\)', '', 'g'), '（(.*?)）', '', 'g') AS text FROM s WHERE NOT ({_starting(sorted(set(scripts.SUBTITLE_NOTES)))})) SELECT * FROM k WHERE trim(text) <> ''")
def src_clean_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.clean_subtitles(_lines(spark, sf_dir))


#: SQL for the codes that an extractor drops within lines.
def _dropped(text: str, patterns: list[str]) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN 'bg 01 ' || line WHEN 1 THEN '太郎' || chr(9) || '「[漢字/かんじ]' || line || '\\n」' WHEN 2 THEN '1 abc ' || line ELSE '\\f12;' || line END AS line FROM ln),
c AS (SELECT doc_id AS file, line_no, trim({_dropped("line", scripts.CS2_CODES)}) AS t FROM s),
k AS (SELECT file, line_no, regexp_replace(regexp_replace(regexp_replace(t, '^\\d+\\s+\\S+\\s+', ''), '\\[(.+?)/.*?\\]', '\\1', 'g'), '^.*\\t((?:「.*」|（.*）|『.*』)$)', '\\1') AS text FROM c WHERE t <> '' AND NOT ({_starting(scripts.CS2_CODE)}))
SELECT * FROM k WHERE trim(text, e' \\t　') <> ''""")
def src_cs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as code, as a speaker's, as choices, and with a control code."""
    n, line = F.col("line_no") % 4, F.col("line")
    coded = F.when(n == 0, F.concat(F.lit("bg 01 "), line)).when(n == 1, F.concat(F.lit("太郎\t「[漢字/かんじ]"), line, F.lit(r"\n」"))).when(n == 2, F.concat(F.lit("1 abc "), line)).otherwise(F.concat(F.lit(r"\f12;"), line))
    return scripts.cs2(_lines(spark, sf_dir).withColumn("line", coded))


@query(f"WITH {LINES_SQL} SELECT doc_id AS file, 3 * line_no AS line_no, 'え' || replace(replace(line, '@', ' '), '2', '') || 'です' AS text FROM ln WHERE line_no % 2 = 0")
def src_nexas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line of the documents as a voiced line behind a mark, the others without kana."""
    lines = _lines(spark, sf_dir).withColumn("line", F.replace("line", F.lit("@"), F.lit(" ")))
    voiced = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("@v001え"), "line", F.lit("です@k"))).otherwise(F.col("line"))
    spoken = lines.select("file", (3 * F.col("line_no")).alias("line_no"), voiced.alias("line"))
    return scripts.nexas(spoken.union(lines.select("file", 3 * F.col("line_no") - 1, F.concat(F.lit("○"), "line"))).union(lines.select("file", 3 * F.col("line_no") + 1, F.lit("次の行"))))


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id AS file, line_no, CASE line_no % 3 WHEN 0 THEN '【太郎】「' || line || '」' WHEN 1 THEN '地[n]' || line ELSE line END AS line FROM ln),
q AS (SELECT *, regexp_extract(line, '[「（](.+?)[」）s]', 0) AS quoted FROM s)
SELECT file, line_no, trim(replace(CASE WHEN line LIKE '【%' AND quoted <> '' THEN quoted ELSE line END, '[n]', '')) AS text FROM q WHERE regexp_matches(line, '^[぀-ヿ一-鿿【]')""")
def src_whale(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, line = F.col("line_no") % 3, F.col("line")
    return scripts.whale(_lines(spark, sf_dir).withColumn("line", F.when(n == 0, F.concat(F.lit("【太郎】「"), line, F.lit("」"))).when(n == 1, F.concat(F.lit("地[n]"), line)).otherwise(line)))


@query(f"WITH {LINES_SQL} SELECT doc_id AS file, line_no, CASE WHEN line_no % 2 = 0 THEN '「' || line || '」' ELSE line END AS text FROM ln WHERE line_no % 2 = 0 OR trim(line, e' \\t　') <> ''")
def src_yuris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.yuris(_lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 2 == 0, F.concat("line", F.lit("「"), "line", F.lit("」"))).otherwise(F.col("line"))))


@query(f"WITH {LINES_SQL}, s AS (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM ln) SELECT doc_id AS file, 2 * line_no AS line_no, trim(replace(line, chr(34), '')) AS text FROM ln WHERE line_no % 2 = 0 AND trim(replace(line, chr(34), ''), e' \\t　') <> ''")
def src_mes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted texts behind marker lines, which every second line has before it."""
    lines = _lines(spark, sf_dir)
    quoted = F.concat(F.lit(' a " '), F.replace("line", F.lit('"'), F.lit("")), F.lit(' " '))
    return scripts.mes(lines.select("file", (2 * F.col("line_no")).alias("line_no"), quoted.alias("line")).union(lines.where("line_no % 2 = 0").select("file", 2 * F.col("line_no") - 1, F.lit("#1-STR_UNCRYPT"))))


@query(f"WITH {LINES_SQL} SELECT doc_id AS file, line AS text FROM ln WHERE trim(line) <> ''")
def src_psb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each document: the third item of each text, blank lines without one."""
    text = lambda x: F.when(F.trim(x) != "", F.array(F.lit("x"), F.lit("y"), F.concat(F.lit("[r]"), x, F.lit("\\n")))).otherwise(F.array(F.lit("x"), F.lit("y")))
    scenes = F.array(F.struct(F.transform(F.split("text", "\n"), text).alias("texts")))
    return scripts.psb(Corpus(spark, sf_dir).documents.select(F.col("doc_id").alias("file"), scenes.alias("scenes")))


@query(f"WITH {LINES_SQL} SELECT doc_id AS file, trim(line) || CASE WHEN length(line) % 2 = 0 THEN 'そうか' ELSE '' END AS text FROM ln")
def src_mokuro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, a block for each line, between what the reader of pictures makes of noise."""
    block = lambda x: F.struct(F.array(F.lit("第１話"), x, F.when(F.length(x) % 2 == 0, "そう．．．．．．か").otherwise("え！"), F.lit("ＡＢＣＤ"), F.lit("！？")).alias("lines"))
    return scripts.mokuro(Corpus(spark, sf_dir).documents.select(F.col("doc_id").alias("file"), F.transform(F.split("text", "\n"), block).alias("blocks")))


@query(f"""WITH {LINES_SQL}
SELECT doc_id || '.srt' AS file, 3 * line_no + 2 AS line_no, trim(line) AS text FROM ln WHERE doc_id % 2 = 0 AND trim(line) <> ''
UNION ALL SELECT doc_id || '.ass', 3 * line_no + 2, trim(unnest([line, 'そうです'])) FROM ln WHERE doc_id % 2 = 1 AND NOT contains(line, 'cn') AND trim(line) <> ''""")
def src_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as subtitle files of both kinds: numbers, times and notes between the spoken lines."""
    lines = _lines(spark, sf_dir).where(F.trim("line") != "")
    srt = F.col("file") % 2 == 0
    name = F.concat(F.col("file").cast("string"), F.when(srt, ".srt").otherwise(".ass"))
    spoken = F.when(srt, F.concat(F.lit("<i>"), "line", F.lit("</i>"))).otherwise(F.concat(F.lit(r"Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\an8}"), "line", F.lit(r"\Nそうです")))
    kinds = [F.when(srt, F.col("line_no").cast("string")).otherwise("; note"), F.when(srt, "00:00:01,000 --> 00:00:02,000").otherwise("[Events]"), spoken]
    rows = lines.select(name.alias("file"), F.posexplode(F.array(*kinds)).alias("k", "l"), "line_no")
    return scripts.subtitle_lines(rows.select("file", (3 * F.col("line_no") + F.col("k")).alias("line_no"), F.col("l").alias("line")))


@query(f"WITH {LINES_SQL} SELECT line, count(*) AS n FROM ln GROUP BY line")
def src_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files: the documents are written as text files, and read again line by line."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    Corpus(spark, sf_dir).documents.select("text").write.text(path)
    lines = scripts.read_lines(spark, path).where(F.col("file").endswith(".txt"))
    # A file ends with a line end, behind which nothing stands
    last = lines.groupBy("file").agg(F.max("line_no").alias("line_no"))
    return lines.join(last, ["file", "line_no"], "left_anti").groupBy("line").agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS INT) AS word_id, string_split(p_name, ' ')[1] || ',' || p_brand AS readings, '0,1' AS reading_types, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS obsolete,
  CASE WHEN p_partkey % 2 = 0 THEN 'v1,uk,n' ELSE 'v1,n' END AS parts_of_speech, 'to ' || p_name AS english FROM part""")
def dict_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the catalogue as entries in XML: two senses, a reading out of use for every third one, glosses in two languages."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    tag = lambda name, *x: F.concat(F.lit(f"<{name}>"), *x, F.lit(f"</{name}>"))
    old = F.when(key % 3 == 0, tag("r_ele", tag("reb", "p_type"), F.lit("<re_inf>&ok;</re_inf>"))).otherwise("")
    misc = F.when(key % 2 == 0, "<misc>&uk;</misc>").otherwise("")
    senses = F.concat(tag("sense", F.lit("<pos>&v1;</pos>"), misc, tag("gloss", F.lit("to "), "p_name"), F.lit("<gloss xml:lang='ger'>essen</gloss>")), F.lit("<sense><pos>&n;</pos><gloss>thing</gloss></sense>"))
    xml = tag("entry", tag("ent_seq", key.cast("string")), tag("k_ele", tag("keb", F.substring_index("p_name", " ", 1)), F.lit("<ke_pri>ichi1</ke_pri>")), tag("r_ele", tag("reb", "p_brand")), old, senses)
    parsed = p.select(dictionary.entries(xml).alias("entry"))
    found = dictionary.words(parsed).select("word_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("readings", "reading_types", "obsolete", "parts_of_speech")))
    meanings = dictionary.definitions(parsed).where("sense = 0").select("word_id", F.get(F.element_at("meanings", "eng"), F.lit(0)).alias("english"))
    return found.join(meanings, "word_id")


@query("SELECT p_brand AS text, arg_min('r' || p_partkey, p_partkey) AS reading, arg_min(p_brand || '[r' || p_partkey || ']' || p_type, p_partkey) AS furigana FROM part GROUP BY p_brand")
def dict_furigana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a text's readings the first one, with its furigana."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    reading = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    ruby = F.array(F.struct(F.col("p_brand").alias("ruby"), reading.alias("rt")), F.struct(F.col("p_type").alias("ruby"), F.lit(None).cast("string").alias("rt")))
    return dictionary.furigana(p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("text"), reading.alias("reading"), ruby.alias("furigana")))


@query("SELECT p_name AS word, arg_min(p_size || ',' || p_size % 3, p_partkey) AS positions FROM part GROUP BY p_name")
def dict_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a word's lines in a bank the first one's accents."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    bank = F.concat(F.lit('["'), "p_name", F.lit('","pitch",{"reading":"はし","pitches":[{"position":'), F.col("p_size").cast("string"), F.lit('},{"position":'), (F.col("p_size") % 3).cast("string"), F.lit("}]}]"))
    found = dictionary.pitches(p.select(F.col("p_partkey").alias("pos"), bank.alias("bank")))
    return found.select("word", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT 'n' || p_partkey AS name, p_name AS value FROM part WHERE p_partkey % 3 <> 0")
def dict_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entities among the lines of a document type, every third of which declares something else."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "<!ELEMENT n").otherwise("<!ENTITY n")
    line = F.concat(kind, F.col("p_partkey").cast("string"), F.lit(' "'), "p_name", F.lit('">'))
    return dictionary.entity_names(spark.read.parquet(f"{sf_dir}/part.parquet").select(line.alias("line")))


@query("SELECT p_partkey, p_partkey % 4 = 0 OR list_has_any(CASE WHEN p_partkey % 4 = 0 THEN [] ELSE string_split(p_name, ' ') END, ['red', 'small', 'widget']) AS allowed FROM part")
def dict_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings restricted to forms, some of which have been seen."""
    given = F.when(F.col("p_partkey") % 4 != 0, F.split("p_name", " "))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", dictionary.allowed_readings(given, F.array(*map(F.lit, ("red", "small", "widget")))).alias("allowed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '本[' || p_type || ']' WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS shown FROM part")
def dict_shown_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single kanji with its first kana reading, else the known form, else the word."""
    key = F.col("p_partkey")
    shown = dictionary.shown_reading(F.when(key % 2 == 0, "本").otherwise(F.col("p_name")), F.col("p_type"), F.when(key % 3 == 0, F.col("p_brand")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", shown.alias("shown"))
