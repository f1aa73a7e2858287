"""Small hand-made cases: what the tables don't hold."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as t
from wordloom.operators import browsing, hierarchy
from wordloom.operators.difficulty import with_moments, zscore
from wordloom.operators.ranking import competition_rank
from wordloom.operators.text_stats import merged_variants
from wordloom.sources import dictionary, scripts


def values(df):
    return [tuple(r) for r in df.collect()]


def test_competition_rank_has_ties_and_zeros_last(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 2), ("d", 0), ("e", 0)], "k string, n int")
    assert sorted(values(competition_rank(df, "n", "r").select("k", "r"))) == [("a", 1), ("b", 1), ("c", 3), ("d", 4), ("e", 4)]


def test_zscore_without_spread_is_half_the_weight(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 0.0), (2, 10.0)], "media_type int, x double")
    assert sorted(values(with_moments(df, ["x"]).select("media_type", zscore("x", 30)))) == [(1, 15.0), (1, 15.0), (2, 7.5), (2, 22.5)]


def test_moments_that_overflow_are_those_of_sql(spark):
    import duckdb

    from wordloom.operators.difficulty import _zsql, moments

    inf = float("inf")
    kinds = [[1e187, 3e186, 5e187, 1e187], [inf, 1.0, 2.0], [inf, inf], [inf], [1e200], [1e200] * 3, [1e100, 1e200], [0.1] * 3, [3e30, 1e30, 7.0], [None, 4.0]]
    rows = [(kind, x) for kind, xs in enumerate(kinds) for x in xs]
    df = spark.createDataFrame(rows, "media_type int, x double").repartition(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (media_type INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    of_kinds = con.execute("SELECT media_type, avg(x), stddev_pop(x) FROM t GROUP BY 1 ORDER BY 1").fetchall()
    for (kind, *own), (_, *theirs) in zip(sorted(values(moments(df, ["x"]))), of_kinds, strict=True):
        assert own == pytest.approx(theirs, rel=1e-12, nan_ok=True), kind
    scores = con.execute(f"SELECT media_type, {_zsql('x', 30)} FROM t WHERE x IS NOT NULL ORDER BY ALL").fetchall()
    found = with_moments(df, ["x"]).where("x is not null").select("media_type", zscore("x", 30))
    assert [x for r in sorted(values(found)) for x in r] == pytest.approx([x for r in scores for x in r])


def test_deck_moments_that_overflow(spark, monkeypatch):
    from wordloom.operators import difficulty

    rows = [(1, 1e187, 1.0), (1, 3e186, 2.0), (2, 1e200, 3.0), (None, 2.0, 4.0), (None, 4.0, 5.0)]
    monkeypatch.setattr(difficulty, "measures", lambda star: spark.createDataFrame(rows, "media_type int, word_difficulty double, sentence_length double").repartition(3))
    found = {r.media_type: (r.mean, r.deviation, r.mean_length) for r in difficulty.deck_stat_moments(spark, "").collect()}
    assert found == {1: (pytest.approx(6.5e186), float("inf"), 1.5), 2: (1e200, 0.0, 3.0), None: (3.0, 1.0, 4.5)}


def test_decks_sorted_by_difficulties_that_overflow(spark, monkeypatch):
    names = ["word_difficulty", "peak_difficulty", "character_count", "unique_word_count", "unique_kanji_count", "sentence_length"]
    rows = [(1, 1, 1e187, float("inf"), *[1.0] * 4), (2, 1, 3e186, float("inf"), *[3.0] * 4)]
    monkeypatch.setattr(browsing, "measures", lambda star: spark.createDataFrame(rows, "deck_id int, media_type int, " + ", ".join(f"{n} double" for n in names)).repartition(2))

    class Decks:
        @staticmethod
        def decks():
            return spark.createDataFrame([(1,), (2,)], "deck_id int")

    # Halves of 25 and, by deviations of one, a quarter and three quarters of 60; the whole of 15, as all are at infinity
    assert values(browsing.deck_list(Decks, "difficulty")) == [(1, "42"), (2, "72")]


def test_variants_lose_occurrences_in_parity_only(spark):
    df = spark.createDataFrame([(1, "a", 0, 5, 0), (1, "a", 1, 3, 4)], "doc_id int, word string, reading_index int, occurrences int, first_pos int")
    assert values(merged_variants(df).select("occurrences")) == [(6,)]
    assert values(merged_variants(df, parity=False).select("occurrences")) == [(8,)]


def test_kana(spark):
    df = spark.createDataFrame([("ラーメン",), ("コーヒー",), ("ケーキ",)], "w string")
    assert values(df.select(t.to_hiragana(F.col("w")), t.to_hiragana(F.col("w"), True))) == [("らーめん", "らあめん"), ("こーひー", "こうひい"), ("けーき", "けえき")]
    assert values(df.select(t.is_kana(F.col("w")))) == [(True,)] * 3


def test_furigana_and_pitch(spark):
    df = spark.createDataFrame([("お食[た]べ物[もの]", 2)], "w string, a int")
    assert values(df.select(t.kana_of(F.col("w")), t.spaced_furigana(F.col("w")), t.stripped_ruby(F.col("w")), t.pitch_pattern(F.lit("きょう"), F.lit(1)), t.pitch_pattern(F.lit("はし"), F.lit(0)))) == [("おたべもの", "お 食[た]べ 物[もの]", "お食べ物", "HLL", "LHH")]


def test_priority_score(spark):
    df = spark.createDataFrame([(["nf01"], True, True), (["spec1"], True, False), ([], True, True), (None, True, False)], "p array<string>, uk boolean, kana boolean")
    assert values(df.select(t.priority_score(F.col("p"), F.col("uk"), F.col("kana")))) == [(15,), (5,), (0,), (0,)]


def test_upsert_and_children(spark):
    old = spark.createDataFrame([("a", 1, 5, "old"), ("b", 1, 5, "old"), ("c", 1, 5, "old")], "title string, media_type int, updated int, payload string")
    new = spark.createDataFrame([("a", 1, 6, "new"), ("b", 1, 5, "new"), ("d", 1, 1, "new")], "title string, media_type int, updated int, payload string")
    assert sorted(values(hierarchy.merged(old, new).select("title", "payload", "action"))) == [("a", "new", "update"), ("b", "old", "keep"), ("c", "old", "keep"), ("d", "new", "insert")]
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "parent_id int, title string")
    with pytest.raises(ValueError, match="2 children"):
        hierarchy.unique_titles(twice)


def test_validation():
    with pytest.raises(ValueError):
        browsing.validated("x" * 201)
    assert browsing.validated("x" * 200)


def script(spark, lines, file="a"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")


def texts(df):
    return [r.text for r in df.orderBy("file", "line_no").collect()]


def test_extractors(spark):
    assert texts(scripts.generic(script(spark, ["@code", "[漢字'かんじ]を[r]読む", "  "]))) == ["漢字を読む"]
    assert texts(scripts.msc(script(spark, ["#1-MESSAGE", "x '【太郎】<愛,あい>_n[r]です' y", "'skip'"]))) == ["愛です"]
    assert texts(scripts.mes(script(spark, ["#1-STR_UNCRYPT", ' a " はい " b']))) == ["はい"]
    assert texts(scripts.cs2(script(spark, ["bg 01", "太郎\t「[漢字/かんじ]です」", "1 abc 選ぶ"]))) == ["「漢字です」", "選ぶ"]
    assert texts(scripts.nexas(script(spark, ["○a", "@v001こんにちは@k", "x", "○b", "abc"]))) == ["こんにちは"]
    assert texts(scripts.whale(script(spark, ["【太郎】「はい」", "地[n]の文", "code"]))) == ["「はい」", "地の文"]
    assert texts(scripts.yuris(script(spark, ["太郎「はい」"]))) == ["「はい」"]
    names = spark.createDataFrame([("太郎",)], "name string")
    assert texts(scripts.bgi(script(spark, ["◇1◇太郎", "◇1◇[a]はい{b}", "◇1◇_x"]), names)) == ["はい"]


def test_subtitles(spark):
    lines = ["前の行(a)", "字幕 x", "後(b)", "(c)"]
    assert texts(scripts.clean_subtitles(script(spark, lines))) == ["前の行", "後"]
    assert texts(scripts.clean_subtitles(script(spark, lines), parity=True)) == ["前の行(a)", "後"]
    assert texts(scripts.subtitle_lines(script(spark, ["1", "00:01 --> 00:02", "<i>はい</i>"], "a.srt"))) == ["はい"]


def test_encodings_and_books(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_bytes("日本語\r\n次".encode("shift_jis"))
    assert [r.line for r in scripts.read_lines(spark, str(tmp_path / "s"), "shift_jis").orderBy("line_no").collect()] == ["日本語", "次"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("o/c.opf", '<item id="x" href="1.html"/><spine><itemref idref="x"/></spine>')
        z.writestr("o/1.html", "<p><ruby>漢字<rt>かんじ</rt></ruby>。次の<script>x</script>文</p>")
    books = spark.createDataFrame([("b", bytearray(buffer.getvalue()))], "path string, content binary")
    assert texts(scripts.epub(books)) == ["漢字。", "次の文"]
    assert texts(scripts.epub(books, scripts.CHAPTERS)) == []  # no file is named like a chapter


def test_chapters_of_books(spark):
    names = ["cover.xhtml", "p-001.xhtml", "part00012.html", "nav.xhtml", "0003.html", "index_split_004.html", "p-1.xhtml"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("c.opf", "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(names)) + "<spine>" + "".join(f'<itemref idref="i{k}"/>' for k in range(len(names))) + "</spine>")
        for n in names:
            z.writestr(n, f"<html><head><title>題</title></head><body><p>{n}。</p></body></html>")
    books = spark.createDataFrame([("b", bytearray(buffer.getvalue()))], "path string, content binary")
    assert texts(scripts.epub(books)) == [f"{n}。" for n in names]
    assert texts(scripts.epub(books, scripts.CHAPTERS)) == ["p-001.xhtml。", "part00012.html。", "0003.html。", "index_split_004.html。"]


def test_dictionary(spark):
    xml = "<entry><ent_seq>1</ent_seq><k_ele><keb>食べる</keb></k_ele><r_ele><reb>たべる</reb></r_ele><r_ele><reb>たぶる</reb><re_inf>&ok;</re_inf></r_ele><sense><pos>&v1;</pos><gloss>to eat</gloss><gloss xml:lang='ger'>essen</gloss></sense></entry>"
    parsed = spark.createDataFrame([(xml,)], "xml string").select(dictionary.entries(F.col("xml")).alias("entry"))
    assert values(dictionary.words(parsed)) == [(1, ["食べる", "たべる"], [0, 1], ["たぶる"], ["v1"])]
    assert dictionary.definitions(parsed).first().meanings == {"eng": ["to eat"], "ger": ["essen"]}
    allowed = spark.createDataFrame([([], ["a"]), (["b"], ["a"]), (["a"], ["a"])], "r array<string>, s array<string>")
    assert values(allowed.select(dictionary.allowed_readings(F.col("r"), F.col("s")))) == [(True,), (False,), (True,)]


def test_rates_run_on_a_stream(spark):
    from wordloom.streaming.rates import watched

    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*.parquet")
    running = watched(events).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == 1000


def test_deconjugation(spark):
    from wordloom.functions.deconjugation import deconjugated, forms_of, parse_rules

    words = spark.createDataFrame([(w,) for w in ("終わってしまった", "わからない", "みて", "作る", "なかった")], "word string")
    forms = {}
    for r in deconjugated(words).collect():
        forms.setdefault(r.word, set()).add(r.form)
    for word, wanted in {"終わってしまった": "終わる", "わからない": "わかる", "みて": "みる", "作る": "作る", "なかった": "ない"}.items():
        assert wanted in forms[word]
    rules = parse_rules('[\n// note\n{"type": "onlyfinalrule", "dec_end": ["b", "c"], "con_end": "a", "dec_tag": "t", "con_tag": "u", "detail": "d"}, {"type": "neverfinalrule", "dec_end": "z", "con_end": "b", "dec_tag": "v", "con_tag": "t", "detail": "e"}, {"type": "rewriterule", "dec_end": "q", "con_end": "xb", "dec_tag": "w", "con_tag": "t", "detail": "f"}]')
    assert [f.text for f in forms_of("xa", rules)] == ["xa", "xb", "xc", "xz", "q"]


def test_token_passes(spark):
    from wordloom.functions.tokens import CASES, TOKEN, Token, honorifics_apart, merged, with_gaps

    df = spark.createDataFrame([*CASES, (None, None)], f"tokens array<{TOKEN}>, wanted array<string>")
    for r in df.select(merged(F.col("tokens"))["text"].alias("found"), "wanted").collect():
        assert r.found == r.wanted
    own = df.limit(9).select(merged(F.col("tokens"), frozenset({("３", "本")}))["text"].alias("found")).collect()[8].found
    assert own == ["３", "人", "静かな"]
    assert [x.text for x in honorifics_apart([Token("太郎さん", "Noun", "太郎さん", "PersonName"), Token("皆さん", "Noun")])] == ["太郎", "さん", "皆さん"]
    gaps = spark.createDataFrame([("本を、読んだ。", ["本", "を", "読んだ"])], "text string, words array<string>").select(with_gaps(F.col("text"), F.col("words")).alias("g")).first().g
    assert [(g.word, g.start, g.known) for g in gaps] == [("本", 1, True), ("を", 2, True), ("、", 3, False), ("読んだ", 4, True), ("。", 7, False)]
