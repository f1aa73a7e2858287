"""Lines of a tokenizer's user dictionary, for dictionary words that the tokenizer splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_katakana
from ..plans.documents import TOKEN
from ..plans.registry import query

#: Names of parts of speech in the tokenizer's dictionary, the first that a word has wins.
POS_NAMES = [("Expression", "表現"), ("Adverb", "副詞"), ("Conjunction", "接続詞"), ("Auxiliary", "助動詞"), ("Pronoun", "代名詞"), ("Noun", "名詞"), ("Particle", "助詞"), ("NaAdjective", "形状詞"), ("IAdjective", "形容詞"), ("Verb", "動詞"), ("NominalAdjective", "形動"), ("Interjection", "感動詞"), ("Numeral", "数詞")]


def pos_name(kinds: Column) -> Column:
    names = [F.when(F.array_contains(kinds, kind), name) for kind, name in POS_NAMES]
    return F.coalesce(*names, F.lit("NULL"))


def user_lines(words: DataFrame, tokens: Column | None = None) -> DataFrame:
    """line of words(word, kana, kinds) that the tokenizer splits into several tokens; tokens is the split, or letter runs."""
    split = F.regexp_extract_all("word", F.lit(TOKEN), F.lit(0)) if tokens is None else tokens
    fields = [F.col("word"), *map(F.lit, ("5146", "5146", "5000")), F.col("word"), pos_name(F.col("kinds")), *map(F.lit, ("普通名詞", "一般", "*", "*", "*")), to_katakana(F.col("kana")), F.col("word"), *[F.lit("*")] * 5]
    return words.where(F.size(split) > 1).select(F.concat_ws(",", *fields).alias("line"))


@query("SELECT concat_ws(',', p_name, '5146', '5146', '5000', p_name, CASE WHEN p_size % 2 = 0 THEN '名詞' ELSE 'NULL' END, '普通名詞', '一般', '*', '*', '*', p_brand, p_name, '*', '*', '*', '*', '*') AS line FROM part WHERE len(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+')) > 1")
def user_dic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Noun"))).otherwise(F.array(F.lit("Suffix")))
    return user_lines(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("word"), F.col("p_brand").alias("kana"), kinds.alias("kinds")))
