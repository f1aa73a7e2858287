"""A corpus cleaned in stages: each takes the documents that its predecessor kept.

Language ID rejects what is in none of the languages it learned from the documents; line dedup removes passages that
stood before; of each group of near duplicates one document stays; documents contaminated by the benchmark go; the rest
are encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontaminate, language, lines, sentencepiece_codec, simhash
from wordloom.llm.common import staged, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that docs teach.

    Null texts and texts without letters go, as all do if docs teach no language. Null doc_id and lang are no obstacle:
    such rows teach nothing. Of languages that fit equally the first by name counts; repeated rows are each judged.
    """
    return language.in_a_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stood before; those of which no word is left go.

    Null texts stay. The first occurrence is that of the least doc_id (null last), then text hash, then place. Rows with
    the same doc_id and text are one document, and each gets its result.
    """
    return lines.without_repeats(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id (null last), then of the least row hash.

    Null and wordless texts are one group. Line dedup has run before, so near copies that shared long passages are no
    longer near here: what is left of them is what they don't share.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in the benchmark's windows; null texts stay, repeated rows are each judged."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decodings, one row for each document; a null text is encoded as empty."""
    trip = sentencepiece_codec.round_trip(docs["text"], spark, sentencepiece_codec.model_path())
    return docs.select("doc_id", trip.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


STAGES = [("language", identify), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontamination), ("sentencepiece", encode)]

#: Language models, fingerprints and merges of a vocabulary have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each but the last leaves a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
