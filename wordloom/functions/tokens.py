"""Merges of neighbouring tokens into words, in passes over a document's token array.

A token is struct<text, pos, lemma, section>; section holds the finer classes, separated by spaces. A pass is a rule on
the token before as merged so far, the original token before, and the next one, and gives what they become together, or
nothing where they stay apart. Passes run in Arrow batches, in time by the number of tokens; no rows are moved. Null
arrays stay null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.documents import text_batches
from ..plans.registry import query

TOKEN = "struct<text:string,pos:string,lemma:string,section:string>"
_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("text", "pos", "lemma", "section")]))


class Token(NamedTuple):
    text: str
    pos: str | None = None
    lemma: str | None = None
    section: str | None = None

    def of(self, section: str) -> bool:
        return section in (self.section or "").split()

    def with_(self, after: Token, pos: str | None = None) -> Token:
        return self._replace(text=self.text + after.text, pos=pos or self.pos)


Rule = Callable[[Token, Token, Token], Token | None]

#: Words that three or two tokens make, with their part of speech.
TRIPLES = {("な", "の", "で"): "Expression", ("で", "は", "ない"): "Expression", ("それ", "で", "も"): "Conjunction", ("なく", "なっ", "た"): "Verb"}
PAIRS = {
    ("じゃ", "ない"): "Expression", ("に", "しろ"): "Expression", ("だ", "けど"): "Conjunction", ("だ", "が"): "Conjunction", ("で", "さえ"): "Expression", ("で", "すら"): "Expression",
    ("と", "いう"): "Expression", ("と", "か"): "Conjunction", ("だ", "から"): "Conjunction", ("これ", "まで"): "Expression", ("それ", "も"): "Conjunction", ("それ", "だけ"): "Noun",
    ("くせ", "に"): "Conjunction", ("の", "で"): "Particle", ("誰", "も"): "Expression", ("誰", "か"): "Expression", ("すぐ", "に"): "Adverb", ("なん", "か"): "Particle",
    ("だっ", "た"): "Expression", ("だっ", "たら"): "Conjunction", ("よう", "に"): "Expression", ("ん", "です"): "Expression", ("ん", "だ"): "Expression", ("です", "か"): "Expression",
}
#: Words that are two tokens.
SPLITS = {"俺の": [Token("俺", "Pronoun", "俺"), Token("の", "Particle", "の")], "泣きながら": [Token("泣き", "Noun", "泣き"), Token("ながら", "Particle", "ながら")]}
#: Particles joined to a verb, dependent verbs, pairs of particles, adverbial endings.
CONJUNCTIVE = ("て", "で", "ながら", "ちゃ", "ば")
DEPENDENT = ("得る", "する", "しまう", "おる", "きる", "こなす", "いく", "貰う", "いる")
PARTICLE_PAIRS = (("に", "は"), ("と", "は"), ("で", "は"), ("の", "に"))
ADVERBIAL = ("だり", "たり")
#: Suffixes that stay apart, by lemma; auxiliaries that do, by text and by lemma; honorifics.
SEPARATE_SUFFIXES = ("っぽい", "にくい", "事", "ふう", "ろう")
SEPARATE_AUXILIARIES = (("な", "に", "なら", "だろう"), ("です", "らしい", "べし", "ようだ"))
HONORIFICS = ("さん", "ちゃん", "くん")

_amount = re.compile("[0-9０-９一二三四五六七八九十百千万]+")


def special(tokens: list[Token]) -> list[Token]:
    """Fixed words of several tokens, and of parts. A split word takes no token after it along."""
    out: list[Token] = []
    at = 0
    while at < len(tokens):
        t, texts = tokens[at], tuple(x.text for x in tokens[at : at + 3])
        request = len(texts) == 3 and t.lemma == "する" and texts[1] == "て" and tokens[at + 2].lemma == "くださる"
        n = 3 if request or texts in TRIPLES else 2 if texts[:2] in PAIRS else 1
        if n > 1:
            pos = t.pos if request else TRIPLES.get(texts) or PAIRS[texts[:2]]
            out.append(t._replace(text="".join(texts[:n]), pos=pos))
        elif t.text == "でしょう":
            out.append(t._replace(pos="Expression", section=None))
        else:
            out += SPLITS.get(t.text, [t])
        at += n
    return out


def continued(tokens: list[Token]) -> list[Token]:
    """Verb, て and いる as one."""
    out: list[Token] = []
    for t in tokens:
        out.append(t)
        if len(out) > 2 and out[-3].pos == "Verb" and out[-2].lemma == "て" and t.lemma == "いる":
            out[-3:] = [out[-3].with_(out[-2]).with_(t)]
    return out


def honorifics_apart(tokens: list[Token]) -> list[Token]:
    """Names and the honorific at their end as two; not among the passes, as the original behaviour leaves names whole."""
    out: list[Token] = []
    for t in tokens:
        end = next((h for h in HONORIFICS if t.text.endswith(h) and len(t.text) > len(h)), None)
        if end and (t.of("PersonName") or t.of("ProperNoun")):
            out += [t._replace(text=t.text.removesuffix(end), lemma=(t.lemma or "").removesuffix(end)), Token(end, "Suffix", end)]
        else:
            out.append(t)
    return out


def by_rule(rule: Rule) -> Callable[[list[Token]], list[Token]]:
    def run(tokens: list[Token]) -> list[Token]:
        out: list[Token] = []
        for k, t in enumerate(tokens):
            both = rule(out[-1], tokens[k - 1], t) if out else None
            if both is None:
                out.append(t)
            else:
                out[-1] = both
        return out

    return run


def _when(holds: Callable[[Token, Token, Token], bool], pos: str | None = None) -> Callable[[list[Token]], list[Token]]:
    """A pass that appends the next token where holds(head, before, next)."""
    return by_rule(lambda head, before, t: head.with_(t, pos) if holds(head, before, t) else None)


def amounts(allowed: frozenset[tuple[str, str]] | None = None) -> Callable[[list[Token]], list[Token]]:
    """Numbers with their counters: allowed pairs of texts, or without such a list any number before any counter."""
    fits = (lambda a, t: (a.text, t.text) in allowed) if allowed else (lambda a, t: _amount.fullmatch(a.text) is not None and t.pos == "Counter")
    return _when(lambda head, before, t: head is before and fits(head, t), "Noun")


def _auxiliary(head: Token, before: Token, t: Token) -> Token | None:
    if t.pos != "Auxiliary":
        return None
    if t.text == "な" and (head.pos == "NaAdjective" or head.of("PossibleNaAdjective")):
        return head.with_(t, "NaAdjective")
    texts, lemmas = SEPARATE_AUXILIARIES
    return head.with_(t) if head.pos in ("Verb", "IAdjective") and t.text not in texts and t.lemma not in lemmas else None


#: The passes in order.
PASSES: dict[str, Callable[[list[Token]], list[Token]]] = {
    "special cases": special,
    "conjunctive particle": _when(lambda head, before, t: head.pos == "Verb" and t.of("ConjunctionParticle") and t.text in CONJUNCTIVE),
    "prefix": by_rule(lambda head, before, t: t._replace(text=head.text + t.text) if head.pos == "Prefix" and head.text != "御" else None),
    "amount and counter": amounts(),
    "small tsu and te": _when(lambda head, before, t: before.text.endswith("っ") and t.text.startswith("て")),
    "auxiliary verb stem": _when(lambda head, before, t: t.of("AuxiliaryVerbStem") and t.text not in ("よう", "ように") and before.pos in ("Verb", "IAdjective")),
    "verb dependant": _when(lambda head, before, t: head.pos == "Verb" and t.of("Dependant")),
    "possible dependant": _when(lambda head, before, t: head.pos == "Verb" and t.of("PossibleDependant") and t.lemma in DEPENDENT),
    "suru noun": _when(lambda head, before, t: head is before and head.of("PossibleSuru") and t.lemma == "する" and t.text not in ("する", "しない"), "Verb"),
    "verb, te and iru": continued,
    "adverbial particle": _when(lambda head, before, t: head.pos == "Verb" and t.of("AdverbialParticle") and t.lemma in ADVERBIAL),
    "suffix": _when(lambda head, before, t: t.pos == "Suffix" and t.lemma not in SEPARATE_SUFFIXES and (t.text != "たち" or before.pos == "Pronoun")),
    "auxiliary": by_rule(_auxiliary),
    "particles": _when(lambda head, before, t: head is before and (head.text, t.text) in PARTICLE_PAIRS),
    "final ba": _when(lambda head, before, t: t.text == "ば" and before.pos == "Verb"),
}


def merged(tokens: Column, allowed_amounts: frozenset[tuple[str, str]] | None = None, honorifics: bool = False) -> Column:
    """All passes over a token array, in order; allowed_amounts is a list of (amount, counter) in place of the rule, honorifics splits names besides."""
    passes = [amounts(allowed_amounts) if name == "amount and counter" and allowed_amounts else run for name, run in PASSES.items()]
    passes += [honorifics_apart] * honorifics

    @F.arrow_udf(f"array<{TOKEN}>")
    def run_all(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            found = None if row is None else [Token(**{k: t.get(k) for k in Token._fields} | {"text": t["text"] or ""}) for t in row if t is not None]
            for run in passes if found else ():
                found = run(found)
            out.append(None if found is None else [t._asdict() for t in found])
        return pa.array(out, _ARROW)

    return run_all(tokens)


#: Pieces of texts that are Python objects at a time, but for the last text's.
PIECES = 1 << 16


def pieces(text: str, words: list[str | None]) -> list[tuple[str, int, bool]]:
    """Words found in turn in a text, each from where the last one ended, with what lies between them; starts from 1."""
    out, at = [], 0
    for word in words:
        found = text.find(word, at) if word else -1
        if found < 0:
            continue
        if found > at:
            out.append((text[at:found], at + 1, False))
        out.append((word, found + 1, True))
        at = found + len(word)
    if at < len(text):
        out.append((text[at:], at + 1, False))
    return out


def with_gaps(text: Column, words: Column) -> Column:
    """array<struct<word, start, known>>: words found in turn in a text, with what lies between them; words that don't follow are left out.

    One scan of the text, however many words. A null text gives null, null words are none: the text is one gap. Of a batch's
    pieces no more than PIECES and one text's are Python objects at a time.
    """

    @F.arrow_udf("array<struct<word:string,start:int,known:boolean>>")
    def aligned(texts: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.concat_arrays(_with_gaps(texts, rows))

    return aligned(text, words)


def _with_gaps(texts: pa.Array, rows: pa.Array) -> list[pa.Array]:
    out, found, ends = [], [], [0]

    def done() -> None:
        offsets = pa.array([e or 0 for e in ends], pa.int32(), mask=np.array([e is None for e in ends]))
        columns = zip(("word", "start", "known"), (pa.string(), pa.int32(), pa.bool_()), strict=True)
        items = pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(columns)], ["word", "start", "known"])
        out.append(pa.ListArray.from_arrays(offsets, items))

    for t, ws in zip(texts, rows, strict=True):
        if t.is_valid:
            found += pieces(t.as_py(), ws.as_py() or [])
        else:  # a null is where the row would begin
            ends[-1] = None
        ends.append(len(found))
        if len(found) >= PIECES:
            done()
            found, ends = [], [0]
    done()
    return out


#: Tokenised by hand: text, part of speech, lemma, section; and the words they make.
CASES = [
    ([("飲ん", "Verb", "飲む", ""), ("で", "Particle", "で", "ConjunctionParticle"), ("笑っ", "Verb", "笑う", ""), ("ちゃえ", "Auxiliary", "ちゃう", ""), ("ば", "Particle", "ば", "ConjunctionParticle")], ["飲んで", "笑っちゃえば"]),
    ([("学校", "Noun", "学校", ""), ("に", "Particle", "に", ""), ("は", "Particle", "は", "")], ["学校", "には"]),
    ([("魚", "Noun", "魚", ""), ("が", "Particle", "が", ""), ("好き", "NaAdjective", "好き", ""), ("じゃ", "Auxiliary", "だ", ""), ("ない", "IAdjective", "ない", "")], ["魚", "が", "好き", "じゃない"]),
    ([("本", "Noun", "本", ""), ("を", "Particle", "を", ""), ("読ん", "Verb", "読む", ""), ("だり", "Particle", "だり", "AdverbialParticle"), ("し", "Verb", "する", ""), ("ます", "Auxiliary", "ます", "")], ["本", "を", "読んだり", "します"]),
    ([("遊び", "Verb", "遊ぶ", ""), ("たい", "Auxiliary", "たい", ""), ("の", "Particle", "の", ""), ("に", "Particle", "に", "")], ["遊びたい", "のに"]),
    ([("勉強", "Noun", "勉強", "PossibleSuru"), ("し", "Verb", "する", ""), ("て", "Particle", "て", "ConjunctionParticle"), ("いる", "Verb", "いる", "PossibleDependant")], ["勉強している"]),
    ([("走っ", "Verb", "走る", ""), ("て", "Particle", "て", "ConjunctionParticle"), ("いる", "Verb", "いる", "PossibleDependant")], ["走っている"]),
    ([("し", "Verb", "する", ""), ("て", "Particle", "て", "ConjunctionParticle"), ("ください", "Verb", "くださる", "")], ["してください"]),
    ([("３", "Numeral", "三", ""), ("人", "Counter", "人", ""), ("静か", "Noun", "静か", "PossibleNaAdjective"), ("な", "Auxiliary", "だ", "")], ["３人", "静かな"]),
    ([("降り", "Verb", "降る", ""), ("そう", "Noun", "そう", "AuxiliaryVerbStem"), ("でしょう", "Auxiliary", "です", "")], ["降りそう", "でしょう"]),
    ([("俺の", "Noun", "俺の", "ProperNoun"), ("御", "Prefix", "御", ""), ("お", "Prefix", "お", ""), ("茶", "Noun", "茶", ""), ("彼", "Pronoun", "彼", ""), ("たち", "Suffix", "たち", "")], ["俺", "の", "御", "お茶", "彼たち"]),
    ([("それ", "Pronoun", "それ", ""), ("で", "Particle", "で", ""), ("も", "Particle", "も", ""), ("飲み", "Verb", "飲む", ""), ("きっ", "Verb", "きる", "PossibleDependant"), ("た", "Auxiliary", "た", "")], ["それでも", "飲みきった"]),
    ([("帰る", "Verb", "帰る", ""), ("で", "Particle", "で", "CaseMarkingParticle"), ("で", "Particle", "で", ""), ("さえ", "Particle", "さえ", "")], ["帰る", "で", "でさえ"]),
    ([("な", "Particle", "な", ""), ("の", "Particle", "の", ""), ("で", "Particle", "で", ""), ("食べ", "Verb", "食べる", ""), ("っ", "Auxiliary", "た", ""), ("て", "Particle", "て", "")], ["なので", "食べって"]),
    ([("見", "Verb", "見る", ""), ("やすい", "Suffix", "やすい", ""), ("事", "Suffix", "事", ""), ("書き", "Verb", "書く", ""), ("始め", "Verb", "始める", "Dependant"), ("れ", "Auxiliary", "れる", ""), ("ば", "Particle", "ば", "")], ["見やすい", "事", "書き始めれば"]),
]
#: What a line of an order stands for: the tokens of a case, or one token.
PHRASES = [tokens for tokens, _ in CASES] + [[t] for t in dict.fromkeys(t for tokens, _ in CASES for t in tokens)]


def sentences_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, tokens: a sentence for each order, of the phrases that its lines stand for."""
    at = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % len(PHRASES)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", at.cast("int").alias("p")))).alias("l"))
    phrases = F.array(*(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(Token._fields, t, strict=True))) for t in p)) for p in PHRASES))
    return lines.select("o", F.flatten(F.transform("l", lambda x: F.get(phrases, x["p"]))).alias("tokens"))


def _passes_sql() -> str:
    """Each pass as a fold over a list: a is what was merged so far, h its last token, x the next one with the original before it."""

    def text(values: tuple[str, ...]) -> str:
        return "(" + ", ".join(f"'{v}'" for v in values) + ")"

    def of(token: str, section: str) -> str:
        return f"list_contains(string_split({token}.s, ' '), '{section}')"

    # Tokens carry the original one before (bt, bp), whether they grew in this pass (m), and, for the fixed words, the texts and the lemma after
    element = "{'t': x[i].t, 'p': x[i].p, 'l': x[i].l, 's': x[i].s, 'bt': x[i - 1].t, 'bp': x[i - 1].p, 'm': false, 'n1': x[i + 1].t, 'n2': x[i + 2].t, 'l2': x[i + 2].l, 'skip': 0}"
    made = "{{'t': {t}, 'p': {p}, 'l': {l}, 's': {s}, 'bt': CAST(NULL AS VARCHAR), 'bp': CAST(NULL AS VARCHAR), 'm': true, 'n1': CAST(NULL AS VARCHAR), 'n2': CAST(NULL AS VARCHAR), 'l2': CAST(NULL AS VARCHAR), 'skip': {skip}}}"
    h, x = "a[-1]", "y[1]"
    joined = made.format(t=f"{h}.t || {x}.t", p=f"{h}.p", l=f"{h}.l", s=f"{h}.s", skip=0)

    def fold(name: str, source: str, body: str) -> str:
        # The first element is a token that no rule touches, taken off again
        none = made.format(t="''", p="''", l="''", s="''", skip=0).replace("true", "false")
        return f"{name} AS (SELECT o, list_reduce(list_concat([[{none}]], list_transform(range(1, len(x) + 1), lambda i: [{element}])), lambda a, y: {body})[2:] AS x FROM {source})"

    def rule(holds: str, becomes: str = joined) -> str:
        return f"CASE WHEN len(a) > 1 AND ({holds}) THEN list_append(a[1:len(a) - 1], {becomes}) ELSE list_concat(a, y) END"

    triples = " ".join(f"WHEN {x}.t = '{a}' AND {x}.n1 = '{b}' AND {x}.n2 = '{c}' THEN '{p}'" for (a, b, c), p in TRIPLES.items())
    pairs = " ".join(f"WHEN {x}.t = '{a}' AND {x}.n1 = '{b}' THEN '{p}'" for (a, b), p in PAIRS.items())
    request = f"coalesce({x}.l = 'する' AND {x}.n1 = 'て' AND {x}.l2 = 'くださる', false)"
    splits = " ".join(f"WHEN {x}.t = '{word}' THEN list_concat(a, [" + ", ".join(made.format(t=f"'{t.text}'", p=f"'{t.pos}'", l=f"'{t.lemma}'", s="CAST(NULL AS VARCHAR)", skip=0) for t in parts) + "])" for word, parts in SPLITS.items())
    skipped = made.format(t=f"{h}.t", p=f"{h}.p", l=f"{h}.l", s=f"{h}.s", skip=f"{h}.skip - 1")
    fixed = lambda texts, pos, skip: f"list_append(a, {made.format(t=texts, p=pos, l=f'{x}.l', s=f'{x}.s', skip=skip)})"
    special_sql = (
        f"CASE WHEN {h}.skip > 0 THEN list_append(a[1:len(a) - 1], {skipped}) WHEN {request} THEN {fixed(f'{x}.t || {x}.n1 || {x}.n2', f'{x}.p', 2)}"
        f" WHEN (CASE {triples} END) IS NOT NULL THEN {fixed(f'{x}.t || {x}.n1 || {x}.n2', f'(CASE {triples} END)', 2)}"
        f" WHEN (CASE {pairs} END) IS NOT NULL THEN {fixed(f'{x}.t || {x}.n1', f'(CASE {pairs} END)', 1)}"
        f" WHEN {x}.t = 'でしょう' THEN list_append(a, {made.format(t=f'{x}.t', p="'Expression'", l=f'{x}.l', s='CAST(NULL AS VARCHAR)', skip=0)}) {splits} ELSE list_concat(a, y) END"
    )
    fresh = f"NOT {h}.m"
    auxiliary = f"CASE WHEN len(a) > 1 AND {x}.p = 'Auxiliary' AND {x}.t = 'な' AND ({h}.p = 'NaAdjective' OR {of(h, 'PossibleNaAdjective')}) THEN list_append(a[1:len(a) - 1], {made.format(t=f'{h}.t || {x}.t', p="'NaAdjective'", l=f'{h}.l', s=f'{h}.s', skip=0)}) WHEN len(a) > 1 AND {x}.p = 'Auxiliary' AND {h}.p IN ('Verb', 'IAdjective') AND {x}.t NOT IN {text(SEPARATE_AUXILIARIES[0])} AND {x}.l NOT IN {text(SEPARATE_AUXILIARIES[1])} THEN list_append(a[1:len(a) - 1], {joined}) ELSE list_concat(a, y) END"
    of_three = made.format(t=f"a[-2].t || {h}.t || {x}.t", p="a[-2].p", l="a[-2].l", s="a[-2].s", skip=0)
    bodies = [
        special_sql,
        rule(f"{h}.p = 'Verb' AND {of(x, 'ConjunctionParticle')} AND {x}.t IN {text(CONJUNCTIVE)}"),
        rule(f"{h}.p = 'Prefix' AND {h}.t <> '御'", made.format(t=f"{h}.t || {x}.t", p=f"{x}.p", l=f"{x}.l", s=f"{x}.s", skip=0)),
        rule(f"{fresh} AND regexp_full_match({x}.bt, '{_amount.pattern}') AND {x}.p = 'Counter'", made.format(t=f"{h}.t || {x}.t", p="'Noun'", l=f"{h}.l", s=f"{h}.s", skip=0)),
        rule(f"right({x}.bt, 1) = 'っ' AND left({x}.t, 1) = 'て'"),
        rule(f"{of(x, 'AuxiliaryVerbStem')} AND {x}.t NOT IN ('よう', 'ように') AND {x}.bp IN ('Verb', 'IAdjective')"),
        rule(f"{h}.p = 'Verb' AND {of(x, 'Dependant')}"),
        rule(f"{h}.p = 'Verb' AND {of(x, 'PossibleDependant')} AND {x}.l IN {text(DEPENDENT)}"),
        rule(f"{fresh} AND {of(h, 'PossibleSuru')} AND {x}.l = 'する' AND {x}.t NOT IN ('する', 'しない')", made.format(t=f"{h}.t || {x}.t", p="'Verb'", l=f"{h}.l", s=f"{h}.s", skip=0)),
        f"CASE WHEN len(a) > 2 AND a[-2].p = 'Verb' AND {h}.l = 'て' AND {x}.l = 'いる' THEN list_append(a[1:len(a) - 2], {of_three}) ELSE list_concat(a, y) END",
        rule(f"{h}.p = 'Verb' AND {of(x, 'AdverbialParticle')} AND {x}.l IN {text(ADVERBIAL)}"),
        rule(f"{x}.p = 'Suffix' AND {x}.l NOT IN {text(SEPARATE_SUFFIXES)} AND ({x}.t <> 'たち' OR {x}.bp = 'Pronoun')"),
        auxiliary,
        rule(f"{fresh} AND ({' OR '.join(f'({h}.t = {a!r} AND {x}.t = {b!r})' for a, b in PARTICLE_PAIRS)})"),
        rule(f"{x}.t = 'ば' AND {x}.bp = 'Verb'"),
    ]
    return ",\n".join(fold(f"p{k + 1}", f"p{k}", body) for k, body in enumerate(bodies)), f"p{len(bodies)}"


_STEPS, _LAST = _passes_sql()
_PHRASES_SQL = ", ".join(f"({i}, {k}, '{t}', '{p}', '{lemma}', '{s}')" for i, phrase in enumerate(PHRASES) for k, (t, p, lemma, s) in enumerate(phrase))


@query(f"""WITH ph AS (SELECT * FROM (VALUES {_PHRASES_SQL}) v(i, k, t, p, l, s)),
p0 AS (
  SELECT l_orderkey AS o, list({{'t': t, 'p': p, 'l': l, 's': s}} ORDER BY l_linenumber, l_partkey, l_suppkey, nth, k) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem) JOIN ph ON (l_partkey * 7 + l_suppkey) % {len(PHRASES)} = i GROUP BY 1),
{_STEPS}
SELECT o AS order_id, array_to_string(list_transform(x, lambda y: y.t || '/' || y.p), '|') AS words FROM {_LAST}""")
def tok_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words, with their parts of speech, that the passes make of each order's sentence."""
    docs = sentences_of_orders(spark, sf_dir)
    return docs.select(F.col("o").alias("order_id"), F.array_join(F.transform(merged(F.col("tokens")), lambda t: F.concat_ws("/", t["text"], t["pos"])), "|").alias("words"))


@query(r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]{4,}') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]{4,}') AS g FROM documents),
p AS (
  SELECT doc_id, i, false AS known, g[i] AS word FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, i, true, w[i] FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d))
SELECT doc_id, word, CAST(start AS INT) AS start, known FROM (SELECT doc_id, word, known, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i, known) - length(word) + 1 AS start FROM p) WHERE word <> ''""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters or more of all documents, at their places, with what lies between them."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.inline(with_gaps(F.col("text"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))))
