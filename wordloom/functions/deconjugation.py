"""Dictionary forms of conjugated words, and the dictionary words that tokens match by them.

Rules are data, in the public JSON form: type, context, endings before and after (dec_end, con_end), tags before and
after (dec_tag, con_tag), detail; each list may be one string. They are read from a file of the caller's, or from the
short set below, applied backwards until nothing new comes. They are compiled into a trie of their conjugated endings,
read from the end, with the rules of a node by the tag they ask for: a form meets only the rules that fit its ending and
its last tag, however many there are. Distinct words are deconjugated once each, then joined back.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.documents import TOKENS_SQL, Corpus
from ..plans.registry import query
from ..plans.staging import shared_dir, staged
from .text import is_kana, priority_score, to_hiragana

#: A form may grow by so many characters, and its tags by so many beyond its length.
GROWTH, DENSITY = 10, 6


class Rule(NamedTuple):
    kind: str
    context: str
    dictionary_end: str
    conjugated_end: str
    dictionary_tag: str
    conjugated_tag: str
    detail: str


class Form(NamedTuple):
    text: str
    tags: tuple[str, ...]
    steps: tuple[str, ...]


def _listed(x: str | list[str] | None) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [""])


def parse_rules(text: str) -> list[Rule]:
    """Single rules of a JSON text with // comments; shorter lists go on with their first entry."""
    out = []
    for r in json.loads(re.sub(r"^\s*//.*$", "", text, flags=re.M)):
        parts = [_listed(r.get(k)) for k in ("dec_end", "con_end", "dec_tag", "con_tag")]
        for i in range(len(parts[0])):
            out.append(Rule(r["type"], r.get("contextrule") or "", *(p[i] if i < len(p) else p[0] for p in parts), r.get("detail") or ""))
    return out


def _short_set() -> str:
    """A few common conjugations, for tests and as an example of the form."""
    godan = [("く", "か", "き", "い", "k"), ("す", "さ", "し", "し", "s"), ("つ", "た", "ち", "っ", "t"), ("う", "わ", "い", "っ", "u"), ("る", "ら", "り", "っ", "r"), ("む", "ま", "み", "ん", "m"), ("ぶ", "ば", "び", "ん", "b"), ("ぬ", "な", "に", "ん", "n")]
    column = lambda i: [g[i] for g in godan]
    verbs = [f"v5{g[4]}" for g in godan]
    rule = lambda kind, dec, con, dec_tag, con_tag, detail: {"type": kind, "dec_end": dec, "con_end": con, "dec_tag": dec_tag, "con_tag": con_tag, "detail": detail}
    plain = [(i, v) for i, v in enumerate(verbs) if v[2] not in "mbn"]
    voiced = [(i, v) for i, v in enumerate(verbs) if v[2] in "mbn"]
    return json.dumps(
        [
            rule("stdrule", ["る", *(godan[i][0] for i, _ in plain)], ["て", *(godan[i][3] + "て" for i, _ in plain)], ["v1", *(v for _, v in plain)], "stem-te", "te form"),
            rule("stdrule", [godan[i][0] for i, _ in voiced], [godan[i][3] + "で" for i, _ in voiced], [v for _, v in voiced], "stem-te", "te form"),
            rule("stdrule", ["る", *(godan[i][0] for i, _ in plain)], ["た", *(godan[i][3] + "た" for i, _ in plain)], ["v1", *(v for _, v in plain)], "stem-past", "past"),
            rule("stdrule", [godan[i][0] for i, _ in voiced], [godan[i][3] + "だ" for i, _ in voiced], [v for _, v in voiced], "stem-past", "past"),
            rule("stdrule", ["る", *column(0)], ["ない", *(a + "ない" for a in column(1))], ["v1", *verbs], "adj-i", "negative"),
            rule("stdrule", ["い"], ["かった"], ["adj-i"], "stem-past", "past"),
            rule("stdrule", ["て"], ["てしまう"], ["stem-te"], "v5u", "completely"),
            rule("stdrule", ["る", *column(0)], ["ます", *(i + "ます" for i in column(2))], ["v1", *verbs], "stem-polite", "polite"),
        ],
        ensure_ascii=False,
    )


def _apply(form: Form, rule: Rule, original: str) -> Form | None:
    text, tags, end = form.text, form.tags, rule.conjugated_end
    if not text or len(text) > len(original) + GROWTH or len(tags) > len(original) + DENSITY or not text.endswith(end):
        return None
    first = not tags
    if (first and not rule.detail) or (not first and tags[-1] != rule.conjugated_tag):
        return None
    allowed = {"rewriterule": text == end, "onlyfinalrule": first, "neverfinalrule": not first}.get(rule.kind, True)
    stem = text[: len(text) - len(end)]
    if rule.context == "v1inftrap":
        allowed = allowed and tags != ("stem-ren",)
    elif rule.context == "saspecial":
        allowed = allowed and not stem.endswith("さ")
    if not allowed or stem + rule.dictionary_end == original:
        return None
    return Form(stem + rule.dictionary_end, (*(tags or (rule.conjugated_tag,)), rule.dictionary_tag), (*form.steps, rule.detail))


class Endings:
    """Rules by their conjugated ending, letter by letter from the end, then by the tag a form must end with."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for n, rule in enumerate(rules):
            node = self.root
            for c in reversed(rule.conjugated_end):
                node = node.setdefault(c, {})
            node.setdefault("", {}).setdefault(rule.conjugated_tag, []).append((n, rule))

    def fitting(self, form: Form) -> list[Rule]:
        """The rules whose ending and tag fit a form, in their own order."""
        hits: list[tuple[int, Rule]] = []
        node, at = self.root, len(form.text)
        while True:
            by_tag = node.get("", {})
            for found in [by_tag.get(form.tags[-1], [])] if form.tags else by_tag.values():
                hits += found
            at -= 1
            if at < 0 or form.text[at] not in node:
                return [rule for _, rule in sorted(hits, key=lambda x: x[0])]
            node = node[form.text[at]]


def forms_of(word: str, rules: list[Rule] | Endings) -> list[Form]:
    """The word itself and all that the rules make of it, in the order found."""
    endings = rules if isinstance(rules, Endings) else Endings(rules)
    found: dict[Form, None] = {}
    fresh = [Form(word, (), ())] if word else []
    while fresh:
        found.update(dict.fromkeys(fresh))
        made = (new for form in fresh for rule in endings.fitting(form) if (new := _apply(form, rule, word)))
        fresh = [f for f in dict.fromkeys(made) if f not in found]
    return list(found)


_FORM_FIELDS = {"word": pa.string(), "form": pa.string(), "tags": pa.list_(pa.string()), "steps": pa.list_(pa.string()), "nth": pa.int32(), "first_alike": pa.bool_()}


def deconjugated(words: DataFrame, rules: str | None = None, column: str = "word") -> DataFrame:
    """word, form, tags, steps of the distinct words of a column, with nth, the order found, and whether no form before has its text.

    rules is the JSON text, a few hundred rules. Null and empty words have no forms.
    """
    shared = words.sparkSession.sparkContext.broadcast(Endings(parse_rules(rules or _short_set())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w in batch.column(0).to_pylist():
                seen: set[str] = set()
                for n, f in enumerate(forms_of(w, shared.value)):
                    rows.append((w, f.text, list(f.tags), list(f.steps), n, f.text not in seen))
                    seen.add(f.text)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_FORM_FIELDS.values())], names=list(_FORM_FIELDS))

    distinct = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    return distinct.mapInArrow(run, "word string, form string, tags array<string>, steps array<string>, nth int, first_alike boolean")


INFLECTING = ("Verb", "IAdjective", "NaAdjective")


def attempts(text: str) -> list[str]:
    """What is looked up in turn: the text, then without ends that repeat or draw out, without leading お, without ー, as long as it changes."""
    out = [text]
    while True:
        t = out[-1]
        if len(t) > 2 and (t[-1] in "っー" or t[-1] == t[-2]):
            t = t[:-1]
        elif t.startswith("お"):
            t = t[1:]
        else:
            t = t.replace("ー", "")
        if not t or t == out[-1]:
            return out
        out.append(t)


def _attempted(tokens: DataFrame) -> DataFrame:
    """tokens with attempt, from 0, and its try."""

    @F.arrow_udf("array<string>")
    def tried(texts: pa.Array) -> pa.Array:
        return pa.array([attempts(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return tokens.select("*", F.posexplode(tried(F.col("text"))).alias("attempt", "try"))


#: What a token is matched by.
KEY = ("text", "pos", "lemma", "normalized", "section")
#: A reading index where no reading is spelt like the form.
NO_READING = 255


def _reading_index(spelling: Column) -> Column:
    """The first reading that is spelt so in hiragana, first with long marks left alone, then written out."""
    at = lambda long: F.array_position(F.transform("readings", lambda r: to_hiragana(r, long)), spelling).cast("int")
    return F.when(at(False) > 0, at(False) - 1).when(at(True) > 0, at(True) - 1).otherwise(NO_READING)


def _score(text: Column) -> Column:
    return priority_score(F.col("priorities"), F.col("usually_kana"), is_kana(text))


def match_tokens(tokens: DataFrame, lookups: DataFrame, words: DataFrame, rules: str | None = None) -> DataFrame:
    """The distinct tokens(text, pos, lemma, normalized, section) that a dictionary word is found for, with attempt, word_id, reading_index, steps.

    lookups has (lookup_key, word_id), words has (word_id, readings, kinds, priorities, usually_kana): kinds are parts of
    speech as tokens have them. Each distinct token is matched once, by joins; the first attempt that finds a word counts.

    Tokens that inflect, by part of speech or as their section says, are looked up by the forms of their hiragana. Of all
    entries of their part of speech the highest priority score wins; equal ones go by form: the text itself first, then the
    lemma, then longer forms, then the order found, then the lowest id. If the normalized form isn't kana, the first entry
    in that order which has it as a reading wins over any score. If no form is in the dictionary, that attempt fails; if
    some are, but none of the right part of speech, and for all other tokens, the hiragana itself is looked up: the highest
    score of the right part of speech, or else the lowest id of any. Null texts match nothing; steps are those of the form,
    none for the hiragana itself.
    """
    known = tokens.select(*KEY).where("text is not null").distinct()
    tried = _attempted(known).withColumn("spelling", to_hiragana(F.col("try"), True))
    key = [*KEY, "attempt"]
    inflects = F.coalesce(F.col("pos").isin(*INFLECTING), F.lit(False)) | F.array_contains(F.split(F.coalesce("section", F.lit("")), " "), "Adjectival")
    inflecting = tried.where(inflects)
    forms = deconjugated(inflecting, rules, "spelling").withColumnRenamed("word", "spelling")
    entries = lookups.join(words, "word_id", "left")
    found = inflecting.join(forms, "spelling").join(entries, F.col("form") == F.col("lookup_key"))
    lead = F.when(F.col("form") == F.col("spelling"), 0).when((F.col("form") == to_hiragana(F.col("lemma"), True)) & F.col("first_alike"), 1).otherwise(2)
    named = ~F.coalesce(is_kana(F.col("normalized")), F.lit(False)) & F.coalesce(F.array_contains("readings", F.col("normalized")), F.lit(False))
    result = F.struct("word_id", _reading_index(F.col("form")).alias("reading_index"), "steps")
    order = F.struct((~named).alias("a"), F.when(~named, -_score(F.col("try"))).alias("b"), lead.alias("c"), (-F.length("form")).alias("d"), F.col("nth").alias("e"), result.alias("r"))
    fits = F.coalesce(F.array_contains("kinds", F.col("pos")), F.lit(False))
    by_forms = found.groupBy(*key).agg(F.min(F.when(fits, order))["r"].alias("r"))
    # The others, and those whose forms are no words of the right kind, by their hiragana
    misfits = by_forms.where("r is null").drop("r")
    plain = tried.join(misfits, _alike(tried, misfits, key), "left_semi").union(tried.where(~inflects))
    plain = plain.withColumn("lookup_key", to_hiragana(F.col("try")))
    result = F.struct("word_id", _reading_index(F.col("lookup_key")).alias("reading_index"), F.expr("cast(array() as array<string>)").alias("steps"))
    order = F.struct((~fits).alias("a"), F.when(fits, -_score(F.col("try"))).alias("b"), F.col("word_id").alias("c"), F.when(F.col("readings").isNotNull(), result).alias("r"))
    by_kana = plain.join(entries, "lookup_key").groupBy(*key).agg(F.min(order)["r"].alias("r"))
    whole = by_forms.union(by_kana).where("r is not null")
    first = whole.groupBy(*KEY).agg(F.min(F.struct("attempt", "r")).alias("x"))
    return first.select(*KEY, "x.attempt", "x.r.*")


def _alike(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for k in names:
        out = out & left[k].eqNullSafe(right[k])
    return out


_MEMO = "text string, pos string, lemma string, normalized string, section string, attempt int, word_id long, reading_index int, steps array<string>, load int"


def match_new(tokens: DataFrame, memo: str, lookups: DataFrame, words: DataFrame, load: int, rules: str | None = None) -> DataFrame:
    """Matches of tokens, kept from load to load: only keys that the table at memo doesn't have yet are matched and appended to it.

    Keys without a match are kept too, with a null word_id, so that they aren't tried again. load numbers the batch from
    0; a batch that was broken off is loaded again under its number. Returns the whole memo.
    """
    spark = tokens.sparkSession
    held = spark.read.schema(_MEMO).parquet(*(f"{memo}/load={n}" for n in range(load))) if load else spark.createDataFrame([], _MEMO)
    known = tokens.select(*KEY).where("text is not null").distinct()
    new = staged(known.join(held, _alike(known, held, list(KEY)), "left_anti"), "new-keys")
    matched = match_tokens(new, lookups, words, rules)
    matched = matched.select(*(F.col(k).alias(f"_{k}") for k in KEY), "attempt", F.col("word_id").cast("long").alias("word_id"), "reading_index", "steps")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY))
    rows = new.join(matched, same, "left").select(*KEY, "attempt", "word_id", "reading_index", "steps", F.lit(load).alias("load"))
    rows.write.mode("overwrite").parquet(f"{memo}/load={load}")
    return spark.read.schema(_MEMO).parquet(*(f"{memo}/load={n}" for n in range(load + 1)))


#: Endings of the tables' languages, for the words of documents.
SUFFIXES = [
    Rule("stdrule", "", "", "s", "noun", "plural", "plural"), Rule("stdrule", "", "y", "ies", "noun", "plural", "plural"), Rule("stdrule", "", "", "ing", "verb", "noun", "gerund"), Rule("stdrule", "", "e", "ing", "verb", "noun", "gerund"),
    Rule("stdrule", "", "", "ed", "verb", "past", "past"), Rule("stdrule", "", "", "er", "verb", "noun", "agent"), Rule("stdrule", "", "te", "tion", "verb", "noun", "act"), Rule("stdrule", "", "", "ment", "verb", "noun", "act"),
    Rule("onlyfinalrule", "", "", "ly", "adjective", "adverb", "manner"), Rule("stdrule", "", "al", "aux", "noun", "plural", "plural"), Rule("stdrule", "", "", "able", "verb", "adjective", "able"), Rule("neverfinalrule", "", "", "re", "verb", "verb", "again"),
    Rule("rewriterule", "", "be", "are", "verb", "past", "irregular"), Rule("stdrule", "", "ha", "ra", "verb", "verb", ""), Rule("stdrule", "saspecial", "st", "t", "verb", "verb", "strong"), Rule("stdrule", "", "en", "ein", "noun", "adverb", "article"),
]


def rules_json(rules: list[Rule]) -> str:
    return json.dumps([{"type": r.kind, "contextrule": r.context, "dec_end": r.dictionary_end, "con_end": r.conjugated_end, "dec_tag": r.dictionary_tag, "con_tag": r.conjugated_tag, "detail": r.detail} for r in rules], ensure_ascii=False)


#: Every rule tried on every form, until nothing new comes.
FORMS_SQL = f"""rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r.kind}', '{r.context}', '{r.dictionary_end}', '{r.conjugated_end}', '{r.dictionary_tag}', '{r.conjugated_tag}', '{r.detail}')" for i, r in enumerate(SUFFIXES))}) t(n, kind, context, dec, con, dec_tag, con_tag, detail)),
forms AS (
  SELECT word, word AS form, CAST([] AS VARCHAR[]) AS tags, CAST([] AS VARCHAR[]) AS steps FROM vocabulary
  UNION SELECT word, left(form, length(form) - length(con)) || dec, list_append(CASE WHEN len(tags) = 0 THEN [con_tag] ELSE tags END, dec_tag), list_append(steps, detail)
  FROM forms JOIN rules ON ends_with(form, con)
  WHERE form <> '' AND length(form) <= length(word) + {GROWTH} AND len(tags) <= length(word) + {DENSITY} AND (len(tags) > 0 OR detail <> '') AND (len(tags) = 0 OR tags[-1] = con_tag)
    AND CASE kind WHEN 'rewriterule' THEN form = con WHEN 'onlyfinalrule' THEN len(tags) = 0 WHEN 'neverfinalrule' THEN len(tags) > 0 ELSE true END
    AND NOT (context = 'saspecial' AND ends_with(left(form, length(form) - length(con)), 'さ')) AND left(form, length(form) - length(con)) || dec <> word)"""


@query(f"WITH RECURSIVE {TOKENS_SQL}, vocabulary AS (SELECT DISTINCT lower(token) AS word FROM tok), {FORMS_SQL} SELECT word, form, array_to_string(tags, ' ') AS tags, array_to_string(steps, ' ') AS steps FROM forms")
def deconjugation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms that the endings of the tables' languages make of the documents' words."""
    words = Corpus(spark, sf_dir).tokens().select(F.lower("token").alias("word"))
    found = deconjugated(words, rules_json(SUFFIXES))
    return found.select("word", "form", F.array_join("tags", " ").alias("tags"), F.array_join("steps", " ").alias("steps"))


def _corpus_tokens(words: DataFrame) -> DataFrame:
    """Tokens of words(word): kinds by their endings, every fifth normalized to a spelling of its own."""
    w, n = F.col("word"), F.length("word")
    pos = F.when(w.rlike("(ing|ed|er|ment)$"), "Verb").when(w.rlike("(ly|able)$"), "IAdjective").when(n % 4 == 0, "Adverb").otherwise("Noun")
    section = F.when(w.rlike("(en|ein)$"), "Common Adjectival")
    lemma = F.when(n > 5, F.regexp_replace(w, "(ing|ed|s)$", "")).otherwise(w)
    return words.select(w.alias("text"), pos.alias("pos"), lemma.alias("lemma"), F.when(n % 5 == 0, F.concat(F.lit("="), lemma)).otherwise(lemma).alias("normalized"), section.alias("section"))


#: Uses that make a document's word an entry of the dictionary that deck_word_matching looks up.
ENTRY_USES = 5


def _corpus_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lookups and words: two entries for each frequent word of the documents, of kinds and priorities by how often it is used."""
    used = Corpus(spark, sf_dir).tokens().groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")).where(f"n >= {ENTRY_USES}")
    w, n = F.col("word"), F.col("n")
    number = F.conv(F.substring(F.md5(w), 1, 12), 16, 10).cast("long") * 2
    texts = lambda *x: F.array(*map(F.lit, x))
    tags = lambda k: F.when(k == 0, texts("ichi1")).when(k == 1, texts("news1", "nf15")).when(k == 2, texts("spec1")).otherwise(F.expr("cast(array() as array<string>)"))
    kinds = F.when(n % 3 == 0, texts("Verb")).when(n % 3 == 1, texts("Noun")).otherwise(texts("Noun", "Verb"))
    others = F.when(n % 2 == 0, texts("Noun", "Adverb")).otherwise(texts("Verb", "IAdjective"))
    one = used.select(number.alias("word_id"), F.array(w).alias("readings"), kinds.alias("kinds"), tags(n % 4).alias("priorities"), (n % 5 == 0).alias("usually_kana"), w.alias("lookup_key"))
    two = used.select((number + 1).alias("word_id"), F.array(F.concat(F.lit("="), w), w).alias("readings"), others.alias("kinds"), tags(n % 7).alias("priorities"), F.lit(False).alias("usually_kana"), w.alias("lookup_key"))
    entries = staged(one.union(two), "dictionary")
    return entries.select("lookup_key", "word_id"), entries.drop("lookup_key")


#: Matching as a scan of all candidates, ranked by windows; attempts by hand, as words of these tables shorten only where letters repeat at their end.
MATCH_SQL = f"""{TOKENS_SQL},
w AS (SELECT lower(token) AS word, min(doc_id % 2) AS half FROM tok GROUP BY 1),
t AS (
  SELECT word AS text, CASE WHEN regexp_matches(word, '(ing|ed|er|ment)$') THEN 'Verb' WHEN regexp_matches(word, '(ly|able)$') THEN 'IAdjective' WHEN length(word) % 4 = 0 THEN 'Adverb' ELSE 'Noun' END AS pos,
    CASE WHEN length(word) > 5 THEN regexp_replace(word, '(ing|ed|s)$', '') ELSE word END AS lemma, CASE WHEN regexp_matches(word, '(en|ein)$') THEN 'Common Adjectival' END AS section, half FROM w),
k AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN '=' || lemma ELSE lemma END AS normalized, pos IN ('Verb', 'IAdjective') OR section IS NOT NULL AS inflects FROM t),
tries AS (
  SELECT *, 0 AS attempt, text AS try FROM k
  UNION ALL SELECT * EXCLUDE (attempt, try), attempt + 1, left(try, length(try) - 1) FROM tries WHERE length(try) > 2 AND right(try, 1) = try[-2]),
vocabulary AS (SELECT DISTINCT try AS word FROM tries WHERE inflects),
{FORMS_SQL},
used AS (SELECT lower(token) AS word, count(*) AS n, CAST('0x' || substr(md5(lower(token)), 1, 12) AS BIGINT) * 2 AS id FROM tok GROUP BY 1 HAVING count(*) >= {ENTRY_USES}),
dic AS (
  SELECT word, id, [word] AS readings, CASE n % 3 WHEN 0 THEN ['Verb'] WHEN 1 THEN ['Noun'] ELSE ['Noun', 'Verb'] END AS kinds, CASE n % 4 WHEN 0 THEN 20 WHEN 1 THEN 18 WHEN 2 THEN 15 ELSE 0 END - CASE WHEN n % 5 = 0 AND n % 4 < 3 THEN 10 ELSE 0 END AS score FROM used
  UNION ALL SELECT word, id + 1, ['=' || word, word], CASE n % 2 WHEN 0 THEN ['Noun', 'Adverb'] ELSE ['Verb', 'IAdjective'] END, CASE n % 7 WHEN 0 THEN 20 WHEN 1 THEN 18 WHEN 2 THEN 15 ELSE 0 END FROM used),
cand AS (SELECT tries.*, form, steps, readings, kinds, score, id, list_contains(kinds, pos) AS fits FROM tries JOIN forms ON tries.try = forms.word JOIN dic ON form = dic.word WHERE inflects),
tested AS (SELECT text, attempt FROM cand GROUP BY ALL HAVING NOT bool_or(fits)),
ranked AS (
  SELECT text, attempt, id, list_position(readings, form) - 1 AS r, steps,
    row_number() OVER (PARTITION BY text, attempt ORDER BY CASE WHEN list_contains(readings, normalized) THEN 0 ELSE 1 END, CASE WHEN list_contains(readings, normalized) THEN 0 ELSE -score END, CASE form WHEN try THEN 0 WHEN lemma THEN 1 ELSE 2 END, -length(form), len(steps), id) AS nth
  FROM cand WHERE fits),
plain AS (
  SELECT tries.text, tries.attempt, id, list_position(readings, try) - 1 AS r, CAST([] AS VARCHAR[]) AS steps,
    row_number() OVER (PARTITION BY tries.text, tries.attempt ORDER BY NOT list_contains(kinds, pos), CASE WHEN list_contains(kinds, pos) THEN -score END, id) AS nth
  FROM tries JOIN dic ON try = dic.word LEFT JOIN tested ON tested.text = tries.text AND tested.attempt = tries.attempt WHERE NOT inflects OR tested.text IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY attempt) AS f FROM (SELECT * FROM ranked UNION ALL SELECT * FROM plain) WHERE nth = 1)"""


@query(f"WITH RECURSIVE {MATCH_SQL} SELECT k.text, pos, lemma, normalized, section, attempt, id AS word_id, CAST(r AS INT) AS reading_index, array_to_string(steps, ' ') AS steps FROM best JOIN k USING (text) WHERE f = 1")
def deck_word_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words, readings and conjugation steps of all words of the documents."""
    tokens = _corpus_tokens(Corpus(spark, sf_dir).tokens().select(F.lower("token").alias("word")))
    found = match_tokens(tokens, *_corpus_entries(spark, sf_dir), rules_json(SUFFIXES))
    return found.withColumn("steps", F.array_join("steps", " "))


@query(f"WITH RECURSIVE {MATCH_SQL} SELECT k.text, attempt, id AS word_id, CAST(r AS INT) AS reading_index, CAST(half AS INT) AS load FROM k LEFT JOIN (SELECT * FROM best WHERE f = 1) USING (text)")
def deck_word_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two loads, documents with even and then with odd ids: the second one matches only what the first hadn't met."""
    tokens, (lookups, words) = Corpus(spark, sf_dir).tokens(), _corpus_entries(spark, sf_dir)
    memo = f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}"
    for load in range(2):
        batch = _corpus_tokens(tokens.where(F.col("doc_id") % 2 == load).select(F.lower("token").alias("word")))
        out = match_new(batch, memo, lookups, words, load, rules_json(SUFFIXES))
    return out.select("text", "attempt", "word_id", "reading_index", "load")
