"""The tokenizer, the rules' trie, matching and its memo, against brute force and by hand-made cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import deconjugation, tokenizer, tokens
from wordloom.functions.deconjugation import Rule, forms_of, match_new, match_tokens, parse_rules, rules_json

LINKS = {("N", "V"): -400, ("V", "V"): 900, ("", "V"): 50}


def lexicon_rows(seed=5):
    r = random.Random(seed)
    words = {"".join(r.choices("ab3", k=k)) for k in (1, 2, 2, 3, 3, 4) for _ in range(3)}
    return [(w, r.randrange(500, 9000), pos, w, None) for w in sorted(words) for pos in r.sample(["N", "V", "P"], r.choice([1, 2]))]


def brute_cost(run, rows, links):
    """The least cost and number of words over all ways to cut a run."""
    entries = {}
    for text, cost, pos, *_ in rows:
        entries.setdefault(text, []).append((cost, pos))
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
        pieces = [run[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        options = [entries.get(p, []) + ([(tokenizer.UNKNOWN, "")] if len(p) == 1 else []) for p in pieces]
        for chosen in itertools.product(*options):
            kinds = ["", *(k for _, k in chosen)]
            cost = sum(c for c, _ in chosen) + sum(links.get(k, 0) for k in zip(kinds, kinds[1:], strict=False))
            best = min(best or (cost, len(chosen)), (cost, len(chosen)))
    return best


@pytest.mark.parametrize("links", [{}, LINKS])
def test_cheapest_path(links):
    rows = lexicon_rows()
    lexicon = tokenizer.Lexicon(rows)
    costs = {(t, p): c for t, c, p, *_ in sorted(rows, key=lambda x: -x[1])}
    for run in ("".join(x) for x in itertools.product("ab3x", repeat=5)):
        found = tokenizer.cheapest(run, [lexicon.beginning(run, i) for i in range(len(run))], links)
        assert "".join(t[0] for t in found) == run
        words, cost, before = 0, 0, ""
        for text, pos, *_ in found:
            for piece in text if pos == "Unknown" else [text]:
                kind = "" if pos == "Unknown" else pos
                cost += (tokenizer.UNKNOWN if pos == "Unknown" else costs[piece, pos]) + links.get((before, kind), 0)
                words, before = words + 1, kind
        assert (cost, words) == brute_cost(run, rows, links)


def test_both_ways_give_the_same_tokens(spark):
    rows = lexicon_rows(7)
    dictionary = spark.createDataFrame(rows + rows[:3] + [("", 1, "N", "", None), ("zz", 1, None, None, None)], "surface string, cost int, pos string, lemma string, section string")
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("ab3x", k=r.randrange(1, 12))) for _ in range(20)) for _ in range(6)] + ["", None, "x!b a", "x!b a", "ab" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("tokens", F.lit("old"))
    one = tokenizer.tokenized(docs, dictionary, F.col("text"), links=LINKS).orderBy("i").collect()
    two = tokenizer.tokenized(docs, dictionary, F.col("text"), links=LINKS, most=3).orderBy("i").collect()
    assert [(x.i, x.text, x.tokens) for x in one] == [(x.i, x.text, x.tokens) for x in two]
    assert one[6].tokens == [] and one[7].tokens is None and [t.text for t in one[8].tokens if t.pos == "Unknown"] != []
    assert "".join(t.text for t in one[10].tokens) == "ab" * 3000
    assert tokenizer.tokenized(docs.limit(0), dictionary, F.col("text")).collect() == []


def test_tokens_feed_the_passes(spark):
    """Running text, cut by a dictionary made of the cases' tokens, becomes the cases' words."""
    chosen = [0, 1, 2, 4, 5, 6]
    entries = {t: 3000 - 100 * len(t[0]) for i in chosen for t in tokens.CASES[i][0]}
    dictionary = spark.createDataFrame([(t, c, p, lemma, s) for (t, p, lemma, s), c in entries.items()], "surface string, cost int, pos string, lemma string, section string")
    docs = spark.createDataFrame([(i, "".join(t[0] for t in tokens.CASES[i][0])) for i in chosen], "i int, text string")
    links = {("Verb", "Auxiliary"): -50}
    found = tokenizer.tokenized(docs, dictionary, F.col("text"), links=links).select("i", tokens.merged(F.col("tokens"))["text"].alias("w")).orderBy("i")
    assert [r.w for r in found.collect()] == [tokens.CASES[i][1] for i in chosen]


def test_tokens_of_a_large_dictionary_go_to_blocks(spark):
    dictionary = spark.createDataFrame(lexicon_rows(9), "surface string, cost int, pos string, lemma string, section string")
    texts = ["ab3 a ba", "", None, "x", "ab3 ab3"] * 700  # several blocks
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, tokens string").coalesce(2)
    one = tokenizer.tokenized(docs, dictionary, F.col("tokens")).collect()
    joined = tokenizer.tokenized(docs, dictionary, F.col("tokens"), most=0)
    assert joined.columns == ["i", "tokens"] and sorted(joined.collect()) == sorted(one)
    plan = joined._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "posexplode" not in plan  # no row for each place of a text


def test_substrings_by_length():
    texts = ["abab", "x", "ab", "日本ab"]
    found, hashes = [], {}
    for of, start, value, n in tokenizer._cuts(texts, 3):
        for i, s, h in zip(of.tolist(), start.tolist(), value.tolist(), strict=True):
            found.append(texts[i][s : s + n])
            assert hashes.setdefault(found[-1], h) == h and 0 <= h < 1 << tokenizer.BITS
    assert sorted(found) == sorted(t[s : s + n] for t in texts for s in range(len(t)) for n in (1, 2, 3) if s + n <= len(t))
    assert len(set(hashes.values())) == len(hashes)


def test_passes_by_hand(spark):
    docs = spark.createDataFrame([(i, case) for i, (case, _) in enumerate(tokens.CASES)] + [(99, None), (100, [])], f"i int, t array<{tokens.TOKEN}>")
    found = docs.select("i", tokens.merged(F.col("t"))["text"].alias("w")).orderBy("i").collect()
    assert [r.w for r in found] == [wanted for _, wanted in tokens.CASES] + [None, []]
    name = spark.createDataFrame([([("田中さん", "Noun", "田中さん", "PersonName"), ("さん", "Noun", "さん", "PersonName")],)], f"t array<{tokens.TOKEN}>")
    assert name.select(tokens.merged(F.col("t"), honorifics=True)["text"].alias("w")).first().w == ["田中", "さん", "さん"]


def test_gaps_of_odd_texts(spark):
    rows = [(1, "ab cd", ["ab", "cd"]), (2, "ab cd", ["zz", "cd", "ab"]), (3, None, ["a"]), (4, "", ["a"]), (5, "abc", None), (6, "aaa", ["a", None, "", "a"]), (7, "x " * 50_000, ["x"] * 50_000)]
    found = {r.i: r.g for r in spark.createDataFrame(rows, "i int, t string, w array<string>").select("i", tokens.with_gaps(F.col("t"), F.col("w")).alias("g")).collect()}
    plain = {i: None if g is None else [(x.word, x.start, x.known) for x in g] for i, g in found.items()}
    assert plain[1] == [("ab", 1, True), (" ", 3, False), ("cd", 4, True)] and plain[2] == [("ab ", 1, False), ("cd", 4, True)]
    assert plain[3] is None and plain[4] == [] and plain[5] == [("abc", 1, False)] and plain[6] == [("a", 1, True), ("a", 2, True), ("a", 3, False)]
    assert len(plain[7]) == 100_000 and plain[7][-1] == (" ", 100_000, False)


def test_gaps_of_a_batch_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    texts = [None, None, "", *["one two "] * 2, *["one two " * 1000] * 150, None]
    words = [["one"], None, ["one"], ["two"], None, *[["one", "two"] * 1000] * 150, []]
    rows = pa.array(texts), pa.array(words, pa.list_(pa.string()))
    tracemalloc.start()
    found = tokens._with_gaps(*rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and len(found) > 5  # 600,000 pieces
    for t, ws, got in zip(texts, words, pa.concat_arrays(found).to_pylist(), strict=True):
        assert got == (None if t is None else [dict(zip(("word", "start", "known"), p, strict=True)) for p in tokens.pieces(t, ws or [])])


def every_rule(word, rules):
    """Forms by trying every rule on every form."""
    found, fresh = {}, [deconjugation.Form(word, (), ())] if word else []
    while fresh:
        found.update(dict.fromkeys(fresh))
        made = (new for form in fresh for rule in rules if (new := deconjugation._apply(form, rule, word)))
        fresh = [f for f in dict.fromkeys(made) if f not in found]
    return list(found)


def test_the_trie_gives_the_forms_of_all_rules():
    r = random.Random(2)
    ends = ["", "a", "b", "ab", "ba", "aab", "bab"]
    for _ in range(30):
        rules = [Rule(r.choice(["stdrule", "stdrule", "rewriterule", "onlyfinalrule", "neverfinalrule"]), r.choice(["", "", "saspecial", "v1inftrap"]), r.choice(ends[1:4]), r.choice(ends[1:]), f"t{k + r.randrange(4)}", f"t{k}", r.choice(["", "d"])) for k in range(4) for _ in range(3)]
        for word in ("aab", "babab", "", "aaaa"):
            assert forms_of(word, rules) == every_rule(word, rules)
    short = parse_rules(deconjugation._short_set())
    for word in ("終わってしまった", "わからない", "なかった", "飲んだ"):
        assert forms_of(word, short) == every_rule(word, short)


def test_time_does_not_depend_on_rules_that_do_not_fit():
    few = parse_rules(deconjugation._short_set())
    many = deconjugation.Endings(few + [Rule("stdrule", "", "x", f"y{i}", f"u{i}", f"v{i}", "d") for i in range(20_000)])
    met = [len(many.fitting(f)) for f in forms_of("終わってしまった", few)]
    assert max(met) <= len(few)


WORDS = "word_id long, readings array<string>, kinds array<string>, priorities array<string>, usually_kana boolean"


def dictionary_of(spark, rows):
    words = spark.createDataFrame([r[:5] for r in rows], WORDS)
    lookups = spark.createDataFrame([(k, r[0]) for r in rows for k in r[5]], "lookup_key string, word_id long")
    return lookups, words


def matches(spark, rows, given):
    found = match_tokens(spark.createDataFrame(given, "text string, pos string, lemma string, normalized string, section string"), *dictionary_of(spark, rows))
    return {r.text: (r.attempt, r.word_id, r.reading_index, list(r.steps)) for r in found.collect()}


def test_matching_by_hand(spark):
    rows = [
        (1, ["飲む", "のむ"], ["Verb"], ["ichi1"], False, ["飲む", "のむ"]),
        (2, ["見る", "みる"], ["Verb"], ["news1"], False, ["見る", "みる"]),
        (3, ["みる"], ["Noun"], ["ichi1"], False, ["みる"]),
        (4, ["診る", "みる"], ["Verb"], [], False, ["みる"]),  # the normalized form's, against a higher score
        (5, ["らーめん"], ["Noun"], [], False, ["らーめん"]),
        (6, ["すごい"], ["IAdjective"], [], False, ["すごい"]),
        (7, ["ちゃ"], ["Noun"], [], False, ["ちゃ"]),
        (8, ["て"], ["Particle"], [], False, ["て"]),
        (9, ["みて"], ["Verb"], [], False, ["みて"]),  # the surface itself, of a lower score than the form
        (10, ["のうだ"], ["Noun"], [], False, ["のうだ"]),
        (12, ["かう"], ["Verb"], [], False, ["かう"]), (11, ["かつ"], ["Verb"], [], False, ["かつ"]),
    ]
    given = [
        ("飲んだ", "Verb", "飲む", "飲む", None), ("みて", "Verb", "みる", "みる", None), ("ミテ", "Verb", "ミル", "診る", None), ("ラーメン", "Noun", "ラーメン", None, None), ("すごいーっ", "IAdjective", "すごい", "すごい", None),
        ("おちゃ", "Noun", "茶", "茶", None), ("て", "Verb", "て", "て", None), ("みる", "Adverb", None, None, None), (None, "Noun", None, None, None), ("ない物", "Noun", None, None, None), ("のうだ", "Noun", "x", "x", "Common Adjectival"), ("かった", "Verb", "かつ", "かつ", None),
    ]
    assert matches(spark, rows, given) == {
        "飲んだ": (0, 1, 0, ["past"]),
        "みて": (0, 2, 1, ["te form"]),  # the score decides, before the form
        "ミテ": (0, 4, 1, ["te form"]),  # but for the normalized form's own word
        "ラーメン": (0, 5, 0, []),
        "すごいーっ": (2, 6, 0, []),
        "おちゃ": (1, 7, 0, []),
        "て": (0, 8, 0, []),  # its form is in the dictionary, but no verb
        "みる": (0, 2, 1, []),  # of another kind: the lowest id
        "のうだ": (0, 10, 0, []),
        "かった": (0, 11, 0, ["past"]),  # equal scores: the lemma's form
    }


def test_a_second_load_matches_new_keys_only(spark, tmp_path):
    rows = [(1, ["ab"], ["Noun"], [], False, ["ab"]), (2, ["cd"], ["Noun"], [], False, ["cd"])]
    lookups, words = dictionary_of(spark, rows)
    schema = "text string, pos string, lemma string, normalized string, section string"
    batch = lambda *texts: spark.createDataFrame([(t, "Noun", None, None, None) for t in texts], schema)
    memo = str(tmp_path / "memo")
    one = match_new(batch("ab", "zz", "ab", None), memo, lookups, words, 0)
    assert sorted((r.text, r.word_id, r.load) for r in one.collect()) == [("ab", 1, 0), ("zz", None, 0)]
    again = match_new(batch("ab", "cd", "zz"), memo, lookups, words, 1).collect()
    assert sorted((r.text, r.word_id, r.load) for r in again) == [("ab", 1, 0), ("cd", 2, 1), ("zz", None, 0)]
    repeated = match_new(batch("ab", "cd", "zz"), memo, lookups, words, 1)  # as after a load that was broken off
    assert sorted((r.text, r.word_id, r.load) for r in repeated.collect()) == sorted((r.text, r.word_id, r.load) for r in again)
    assert rules_json(deconjugation.SUFFIXES) and parse_rules(rules_json(deconjugation.SUFFIXES)) == deconjugation.SUFFIXES
