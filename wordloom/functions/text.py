"""Column functions over texts: cleaning, splitting, kana and furigana, display forms, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.star import MEDIA_TYPES

WIDE_DIGITS = "０１２３４５６７８９"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Kana by the vowel that a long mark behind them stands for.
_VOWELS = {"あ": "あかさたなはまやらわがざだばぱぁゃゎ", "い": "いきしちにひみりぎじぢびぴぃ", "う": "うくすつぬふむゆるぐずづぶぷぅゅ", "え": "えけせてねへめれげぜでべぺぇ", "お": "おこそとのほもよろをごぞどぼぽぉょ"}
#: The vowel a long mark is written with, by the vowel before it.
_LONG = {"あ": "あ", "い": "い", "う": "う", "え": "え", "お": "う"}


def wide_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", WIDE_DIGITS)


def narrow_digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, "0123456789")


def precleaned(text: Column) -> Column:
    """Angle brackets as spaces."""
    return F.translate(text, "<>", "  ")


def cleaned_token(token: Column) -> Column:
    """A token without what is no Latin letter, digit, kana, kanji, wide form or one of 々 and ．"""
    return F.regexp_replace(token, r"[^a-zA-Z0-9぀-ゟ゠-ヿ一-龯Ａ-Ｚａ-ｚ０-９々．]", "")


def sentences(text: Column, ends: str = r".!?") -> Column:
    """array<string>: a text cut behind each sentence end, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, f"(?<=[{ends}])"), lambda x: F.trim(x, F.lit(" \n\t"))), lambda x: x != "")


def japanese_sentences(text: Column) -> Column:
    """Cut behind 。！？」） and behind … or — before a line end; each from its first Japanese character; blanks dropped."""
    parts = F.split(text, "(?<=[。！？」）])|(?<=[…—])\r\n")
    return F.filter(F.transform(parts, lambda x: F.regexp_extract(x, r"[぀-ヿ一-鿿].*", 0)), lambda x: x != "")


def to_hiragana(text: Column, long_vowels: bool = False) -> Column:
    """Katakana as hiragana; long marks as the vowel they stand for, if asked."""
    out = F.translate(text, KATAKANA, HIRAGANA)
    if long_vowels:
        for _ in range(2):  # a mark may follow a mark
            for vowel, kana in _VOWELS.items():
                out = F.regexp_replace(out, f"(?<=[{kana}])ー", _LONG[vowel])
    return out


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def is_kana(text: Column) -> Column:
    return text.rlike(r"^[぀-ヿ]+$")


def is_kanji(text: Column) -> Column:
    return text.rlike(r"^[一-龯々]+$")


def is_romaji(text: Column) -> Column:
    """Nothing but Latin letters, digits, marks and spaces."""
    return text.rlike(r"^[\x00-\x7FĀāĒēĪīŌōŪūÂâÊêÎîÔôÛû‘’“”]+$")


#: Fixed value: what a tokenizer is given.
INPUT = r"[^\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FAF\uFF21-\uFF3A\uFF41-\uFF5A\uFF10-\uFF19\u3005\u3001-\u3003\u3008-\u3011\u3014-\u301F\uFF01-\uFF0F\uFF1A-\uFF1F\uFF3B-\uFF3F\uFF5B-\uFF60\uFF62-\uFF65．\n…\u3000―\u2500() 」]"


def tokenizer_input(text: Column) -> Column:
    """A text with wide digits and without what a tokenizer isn't given; empty if nothing Japanese is left."""
    kept = F.regexp_replace(wide_digits(text), INPUT, "")
    return F.when((kept == "") | is_romaji(kept), "").otherwise(kept)


def without_drawn_out(token: Column) -> Column:
    return F.replace(token, F.lit("ッー"), F.lit(""))


def large_wa(text: Column) -> Column:
    """Small wa as wa."""
    return F.translate(text, "ゎヮ", "わわ")


def file_name(title: Column, most: int = 30) -> Column:
    return F.substring(title, 1, most)


def listed(json: Column) -> Column:
    """array<string> of a JSON value that is one string or a list of them; null of null."""
    one = F.array(F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x"))
    return F.when(F.trim(json).startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull(), one)


def kana_of(furigana: Column) -> Column:
    """The kana of a text with furigana in brackets."""
    return F.regexp_replace(furigana, r"[^぀-ヿ]", "")


def spaced_furigana(furigana: Column) -> Column:
    """A space before each kanji run with a reading that stands behind other text."""
    return F.regexp_replace(furigana, r"(?<=[^\s\p{InCJKUnifiedIdeographs}])(?=\p{InCJKUnifiedIdeographs}+\[)", " ")


def stripped_ruby(text: Column) -> Column:
    return F.regexp_replace(text, r"\[.*?\]", "")


def ruby_markup(text: Column) -> Column:
    """kanji[reading] as ruby markup."""
    return F.regexp_replace(text, r"([\p{InCJKUnifiedIdeographs}々]+)\[(.+?)\]", "<ruby>$1<rp>(</rp><rt>$2</rt><rp>)</rp></ruby>")


def morae(reading: Column) -> Column:
    """array<string>: kana, small ones joined to the kana before."""
    return F.regexp_extract_all(reading, F.lit(r"[぀-ヿ][ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ]?"), F.lit(0))


def pitch_pattern(reading: Column, accent: Column) -> Column:
    """H and L for each mora and the particle behind: 0 stays high, 1 falls after the first, n after the n-th."""
    n = F.size(morae(F.regexp_replace(reading, r"[\p{InCJKUnifiedIdeographs}\[\]]", "")))
    high = lambda i: F.when(accent == 0, i > 1).when(accent == 1, i == 1).otherwise((i > 1) & (i <= accent))
    return F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.when(high(i), "H").otherwise("L")), "")


def approximate_percentage(share: Column) -> Column:
    return F.when(share == 0, "0").when(share <= 0.1, "<0.1").when(share < 1, "<1").when((share > 99) & (share < 100), ">99").otherwise(F.floor(share).cast("string"))


def localised_title(original: Column, romaji: Column, english: Column, language: str = "english") -> Column:
    """The title in the wanted form, or the next one that isn't empty."""
    full = lambda c: F.nullif(c, F.lit(""))
    order = {"english": (english, romaji, original), "romaji": (romaji, english, original), "original": (original, romaji, english)}[language]
    return F.coalesce(*map(full, order))


def media_label(media_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair)), media_type.cast("int")), F.lit("Unknown"))


#: Readable parts of speech; codes that aren't here are shown as they are.
POS_LABELS = {"n": "noun", "adj-i": "i-adjective", "adj-na": "na-adjective", "adv": "adverb", "v1": "ichidan verb", "v5": "godan verb", "vs": "suru verb", "prt": "particle", "int": "interjection", "exp": "expression", "conj": "conjunction", "pn": "pronoun", "pref": "prefix", "suf": "suffix", "ctr": "counter", "uk": "usually kana", "aux": "auxiliary"}


def pos_labels(codes: Column) -> Column:
    """array<string>: readable forms of codes, unknown ones as they are."""
    known = F.create_map(*(F.lit(x) for pair in POS_LABELS.items() for x in pair))
    return F.transform(codes, lambda x: F.coalesce(F.element_at(known, x), x))


def pos_kind(code: Column) -> Column:
    """The kind of a part of speech; the rule for verbs comes after the named ones."""
    return (
        F.when(code.isin("n", "n-t", "n-adv"), "Noun").when(code.isin("adj-i", "adj-ix"), "IAdjective").when(code.startswith("v"), "Verb").when(code == "adj-na", "NaAdjective")
        .when(code == "adv", "Adverb").when(code == "prt", "Particle").when(code.isin("conj", "cop"), "Conjunction").when(code.startswith("aux"), "Auxiliary").when(code == "pn", "Pronoun").when(code == "int", "Interjection")
        .when(code == "pref", "Prefix").when(code == "suf", "Suffix").when(code == "ctr", "Counter").when(code == "exp", "Expression").otherwise("Unknown")
    )


def conjugation_text(steps: Column) -> Column:
    """Steps of a conjugation in reading order, without bracketed and blank ones."""
    return F.array_join(F.reverse(F.filter(steps, lambda x: (F.trim(x) != "") & ~x.rlike(r"^\(.*\)$"))), " ; ")


def csv_quoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def zero_if_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def lenient_date(text: Column) -> Column:
    """A full date; a year alone as its first day; TBA far in the future; else the first of all days."""
    year = F.regexp_extract(text, r"^\s*(\d{4})\s*$", 1).try_cast("int")
    full = F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(full, F.make_date(year, F.lit(1), F.lit(1)), F.when(F.upper(F.trim(text)) == "TBA", F.lit("2099-01-01").cast("date")), F.lit("0001-01-01").cast("date"))


def priority_score(priorities: Column, usually_kana: Column, kana: Column) -> Column:
    """Points of a reading's priority tags; nothing without tags, not even for usual kana."""
    has = lambda tag, points: F.when(F.array_contains(priorities, tag), points).otherwise(0)
    band = F.filter(priorities, lambda x: x.rlike(r"^nf\d\d$"))
    by_band = F.when(F.size(band) > 0, F.greatest(F.lit(0), 5 - F.bround(F.substring(F.get(band, F.lit(0)), 3, 2).cast("int") / 10, 0).cast("int"))).otherwise(0)
    points = has("ichi1", 20) + has("ichi2", 10) + has("news1", 15) + has("news2", 10) + F.when(F.arrays_overlap(priorities, F.array(F.lit("gai1"), F.lit("gai2"))), 5).otherwise(0) + by_band
    points = F.when(points == 0, has("spec1", 15) + has("spec2", 5)).otherwise(points)
    return F.when(F.coalesce(F.size(priorities), F.lit(0)) <= 0, 0).otherwise(points + F.when(usually_kana, F.when(kana, 10).otherwise(-10)).otherwise(0))
