"""Token counts (9): the whole-token shortcut for BPE vocabularies with word ends.

Offline, every vocabulary string is put through the tokenizer by itself; those that come back as exactly their own id
are proven to be one token whenever they stand as a pre-token. Texts are split into pre-tokens, proven ones count one
each, and only the rest go through the merges (each distinct one once, as a worker remembers its length).

Null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text count one token each and separate what
stands around them, as is the library's default. Repeated rows are counted each; other columns pass through, those named
like results give way. Whole texts are counted, however long. The tokenizer must be of the kind that the shortcut knows
(NFC, lower case and single spaces at most, a split by a pattern before byte-level pieces): others raise, and so does a worker whose
first counts of a text's new pre-tokens aren't what the library makes of the whole text.
"""

from __future__ import annotations

import json
import os
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import besides, digest, resident, struct, table, text_batches, text_rows

#: Distinct merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Texts of up to 20,000 characters that each worker also puts through the library whole, the first ones it meets.
CHECKED = 200


#: White space to one space: it separates pre-tokens in any case, and is in none.
SPACES = [{"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]


class PretokenCounter:
    """Counts tokens of texts for one tokenizer file; built once in a worker."""

    def __init__(self, tokenizer_json: str, whole: list[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pretokens = pretoken_pattern(spec).findall
        self.lower = any(n["type"] == "Lowercase" for n in normalizers(spec))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        if unknown := [n for n in normalizers(spec) if n["type"] not in ("NFC", "Lowercase") and n not in SPACES]:
            raise ValueError(f"normalizers that the shortcut doesn't know: {unknown}")
        self.nfc = any(n["type"] == "NFC" for n in normalizers(spec))
        self.checks = CHECKED
        self.whole = whole
        self.cost = dict.fromkeys(whole, 1)

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if self.nfc else text
        # Lower case goes character by character there: no final sigma
        return text.replace("Σ", "σ").lower() if self.lower else text

    def plain(self, text: str) -> int:
        words = self.pretokens(self.normal(text))
        costs = list(map(self.cost.get, words))
        if None in costs:
            if len(self.cost) > len(self.whole) + REMEMBERED:
                self.cost = dict.fromkeys(self.whole, 1)
            new = list({w for w in words if w not in self.cost})
            merged = self.tokenizer.encode_batch(new, add_special_tokens=False)
            self.cost.update((w, len(e.ids)) for w, e in zip(new, merged, strict=True))
            costs = map(self.cost.__getitem__, words)
        return sum(costs)

    def count(self, text: str) -> int:
        n = self.counted(text)
        if self.checks and len(text) < 20_000:
            self.checks -= 1
            if n != len(self.tokenizer.encode(text, add_special_tokens=False).ids):
                raise ValueError(f"not as the library counts it: {text[:80]!r}")
        return n

    def counted(self, text: str) -> int:
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


def normalizers(spec: dict) -> list[dict]:
    n = spec["normalizer"]
    return [] if n is None else n["normalizers"] if n["type"] == "Sequence" else [n]


def pretoken_pattern(spec: dict) -> regex.Pattern:
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    return regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))


def whole_tokens(tokenizer_json: str) -> list[str]:
    """The vocabulary strings proven to encode alone as one token: the proof is the encoding itself."""
    from tokenizers import Tokenizer

    spec, tokenizer = json.loads(tokenizer_json), Tokenizer.from_str(tokenizer_json)
    end = spec["model"].get("end_of_word_suffix") or ""
    to_byte = {c: b for b, c in enumerate(byte_symbols())}
    found = []
    for piece, token in spec["model"]["vocab"].items():
        if not piece.endswith(end):
            continue
        try:
            text = bytes(to_byte[c] for c in piece.removesuffix(end)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and pretoken_pattern(spec).findall(text) == [text]:
            found.append((text, token))
    encoded = tokenizer.encode_batch([t for t, _ in found], add_special_tokens=False)
    return [t for (t, token), e in zip(found, encoded, strict=True) if e.ids == [token]]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _counter(key: str, shared) -> PretokenCounter:
    """The worker's counter for this key: workers outlive tasks, and so does what they remember."""
    return resident(key, lambda: PretokenCounter(*shared.value))


def count_tokens(text: Column, spark: SparkSession, tokenizer_path: str) -> Column:
    """The number of tokens of each text; tokenizer_path is a file of the driver, and its content is what executors get."""
    text_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec)))  # bounded by the vocabulary
    key = digest(spec)

    @F.arrow_udf("struct<n_tokens:bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        counter = _counter(key, shared)
        return struct(n_tokens=([counter.count(t) if t else 0 for t in text_rows(texts)], pa.int64()))

    return counted(text)["n_tokens"]


def token_report(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    docs, text = besides(docs, "n_bytes", "n_tokens", "over_limit"), F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", count_tokens(text, docs.sparkSession, tokenizer_path)).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_report(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
