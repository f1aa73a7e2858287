"""Places, sums, searches, loads and limits: hot groups, streams, what is read and what is written."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import browsing, difficulty, export, loading, search
from wordloom.operators.ranking import competition_rank
from wordloom.plans.numbering import numbered, summed_before
from wordloom.plans.star import DECK_SPAN, Star
from wordloom.streaming import limits

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_places_and_sums_of_a_hot_group(spark):
    r = random.Random(1)
    rows = [("hot", 5, r.randrange(9)) for _ in range(3000)] + [("hot", r.randrange(100), 1) for _ in range(1000)] + [(None, r.randrange(5), None) for _ in range(50)] + [("x", 1, 2)]
    df = spark.createDataFrame(rows, "g string, k int, v int").withColumn("index", F.lit("old")).repartition(5)
    places = numbered(df, [F.col("k")], ("g",), total="n").collect()
    for group in ("hot", None, "x"):
        mine = sorted((x["index"], x.k, x.n) for x in places if x.g == group)
        assert [i for i, *_ in mine] == list(range(len(mine))) and [k for _, k, _ in mine] == sorted(k for _, k, _ in mine) and {n for *_, n in mine} == {len(mine)}
    sums = sorted(((x["index"], x.v, x.before, x.total) for x in summed_before(numbered(df, [F.col("k")], ("g",)), "v", [F.col("index")], ("g",), total="total").where("g = 'hot'").collect()))
    so_far = 0
    for _, v, before, total in sums:
        assert before == so_far and total == sum(x[1] for x in sums)
        so_far += v
    assert numbered(df.limit(0), [F.col("k")]).collect() == [] and summed_before(df.limit(0), "v", [F.col("k")], ("g",)).collect() == []
    assert [x["index"] for x in numbered(df.where("g is null"), [F.col("k")]).orderBy("index").collect()] == list(range(50))


def test_ranks_have_no_single_task(spark):
    df = spark.createDataFrame([(i, i % 7 * 10 if i % 3 else 0) for i in range(500)], "k int, n int")
    ranked = competition_rank(df, "n", "r")
    values = sorted((x.n for x in df.collect()), reverse=True)
    assert all(x.r == values.index(x.n) + 1 for x in ranked.collect())
    assert "SinglePartition" not in ranked._jdf.queryExecution().toString()


def test_peak_words_of_a_hot_deck(spark, monkeypatch):
    r = random.Random(4)
    rows = [(1, n, 1 + r.randrange(3), r.choice([7, 7, 7, r.randrange(50)])) for n in range(4000)] + [(2, n, 1, n) for n in range(5)] + [(3, 0, 9, 1)]
    given = spark.createDataFrame(rows, "deck_id int, deck_word_id int, occurrences int, reading_rank int").withColumn("used_rank", F.col("reading_rank"))
    monkeypatch.setattr(difficulty, "ranked_words", lambda star: given)
    found = {(x.deck_id, x.deck_word_id) for x in difficulty.marked_words(None).where("peak").collect()}
    wanted = set()
    for deck in (1, 2, 3):
        mine = sorted((-rank, n, occ) for d, n, occ, rank in rows if d == deck)
        target, so_far = int(sum(o for *_, o in mine) * 0.1), 0
        for i, (_, n, occ) in enumerate(mine):
            if i == 0 or so_far < target:
                wanted.add((deck, n))
            so_far += occ
    assert found == wanted


TEXTS = ["the cat sat", "The Cat and the dog", "a dog", "catcat", "", None, "concatenate", "aaaa", "日本語のテキスト", "ca t"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "grams")
    search.build_index(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), path)
    return path


def count_in(text, term):
    return sum((text or "").lower().startswith(term, i) for i in range(len(text or "")))


@pytest.mark.parametrize("term", ["cat", "the cat", "catc", "at", "a", "dog", "aa", "aaa", "本語", "のテキスト", "zz", "cat sat", "t", "enate"])
def test_terms_are_found_at_every_place(spark, index, term):
    found = {r.id: r.n for r in search.occurrences(spark.read.parquet(index), [term]).collect()}
    assert found == {i: n for i, t in enumerate(TEXTS) if (n := count_in(t, term))}


def test_search_syntax(spark, index):
    found = lambda text: {r.id: r.score for r in search.search(spark, index, text).collect()}
    assert found('"the cat" OR dog') == {0: 1, 1: 2, 2: 1}
    assert found("cat -dog") == {0: 1, 3: 2, 6: 1} and found('cat -"the cat" -con') == {3: 2}
    assert found("CAT the") == {0: 2, 1: 3} and found("-cat") == {} and found("or cat") == found("cat")
    assert search.parsed('a OR "b c" d -e') == ([["a", "b c"], ["d"]], ["e"])


def test_searches_read_no_texts_and_only_their_grams(spark, index):
    plan = search.occurrences(spark.read.parquet(index), ["the cat", "at"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(gram" in plan and "StringStartsWith(gram,at)" in plan


def test_index_has_a_row_for_each_gram_of_a_block(spark, tmp_path):
    texts = [*TEXTS, "the cat sat", "\0a\0", "𝒳cat" * 500, "x" * 63 + "cat", "y" * 62, "cat"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "no cats"), (3, TEXTS[3]), (None, "cat")]
    path = str(tmp_path / "grams")
    search.build_index(spark.createDataFrame(rows, "id int, text string").coalesce(1), path)
    index = spark.read.parquet(path)
    grams = {t.lower()[i : i + search.GRAM] for _, t in rows for i in range(len(t or ""))}
    assert index.count() == len(grams) + 1 and {r.gram for r in index.select("gram").collect()} == grams | {""}
    terms = ["cat", "the cat", "at", "catc", "xcat", "\0", "a\0", "ycat", "catcat", "𝒳cat𝒳"]
    found = {(r.term, r.id): r.n for r in search.occurrences(index, terms).collect()}
    want = {(term, i): n for term in terms for i in {i for i, _ in rows} if (n := sum(count_in(t, term.lower()) for j, t in rows if i == j))}
    assert found == want and found["cat", 0] == 2 and found["cat", 3] == 4


def test_blocks_of_an_index(spark):
    r = random.Random(8)
    texts = [t * r.randrange(1, 6) for t in ("ab", "日本語", "x", "a b\0", "ab" * 33, "".join(map(chr, range(0x4E00, 0x5600))))]
    for chosen in (texts, texts[:1], ["".join(map(chr, r.choices(range(0x20000, 0x2A000), k=150_000))), "ab"]):
        grams, places, owner = search._block(chosen)
        want: dict = {}
        for k, t in enumerate(chosen):
            for i in range(len(t)):
                want.setdefault(t[i : i + search.GRAM], []).append((k, i))
        begins = [owner.tolist().index(k) * search.SLOT for k in range(len(chosen))]
        found = {g: [(k := int(owner[p // search.SLOT]), p - begins[k]) for p in ps] for g, ps in zip(grams, places.to_pylist(), strict=True)}
        assert len(grams) == len(want) and found == want


def test_served_tables_are_read_without_a_shuffle(spark, tmp_path):
    from wordloom.operators import serving
    from wordloom.plans.star import Star

    path = str(tmp_path / "served")
    serving.build(Star(spark, "/root/testdata/sf0.001", once=True), path)
    for found, pushed in ((serving.words_of_deck(spark, path, 3), "EqualTo(deck_id,3)"), (serving.decks_with_word(spark, path, 5, 1), "EqualTo(word_id,5)")):
        plan = found._jdf.queryExecution().toString()
        assert found.count() and pushed in plan and "Exchange" not in plan


def test_loads_leave_untouched_parts_alone(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ("k", "g")
    rows = [(i, i % 4, 1, f"v{i}") for i in range(40)] + [(None, 0, 1, "null")]
    df = lambda x: spark.createDataFrame(x, "k int, g int, updated int, payload string")
    loading.create(df(rows + [(1, 1, 0, "older"), (2, 2, 1, "v2")]), path, keys, "updated", F.col("g"))
    files = lambda part: sorted(glob.glob(f"{path}/data/*/part={part}/*.parquet"))
    before = {p: files(p) for p in range(4)}
    read = lambda: {(r.k, r.g): (r.updated, r.payload, r.load) for r in loading.read_table(spark, path).collect()}
    assert read() == {(k, g): (u, p, 0) for k, g, u, p in rows}
    # Part 0 gets a newer and a null key's row, part 1 only ties and older ones, part 9 is new
    assert loading.load(df([(4, 0, 2, "new"), (None, 0, 5, "null2"), (1, 1, 1, "tie"), (5, 1, 0, "old"), (7, 9, 1, "nine"), (7, 9, 3, "ten")]), path, keys, "updated", F.col("g")) == 1
    table = read()
    assert table[4, 0] == (2, "new", 1) and table[None, 0] == (5, "null2", 1) and table[1, 1] == (1, "v1", 0) and table[7, 9] == (3, "ten", 1) and table[8, 0] == (1, "v8", 1)
    assert len(table) == 42
    for p in (1, 2, 3):
        assert files(p) == before[p]
    assert set(before[0]) < set(files(0))  # the old part is still there for readers of the old snapshot
    assert loading.snapshot(spark, path) == {0: 1, 1: 0, 2: 0, 3: 0, 9: 1}
    with pytest.raises(Exception, match="exists"):  # another load that took the same number
        loading._written(df(rows).withColumn("part", F.col("g")), path, 1, keys, {})


def test_a_broken_load_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1, "a")], "k int, updated int, payload string")
    loading.create(df, path, ("k",), "updated", F.lit(0))
    os.makedirs(f"{path}/data/load=1/part=0")  # data without a snapshot
    spark.createDataFrame([(1, 9, "b")], df.schema).write.mode("overwrite").parquet(f"{path}/data/load=1/part=0")
    assert [r.payload for r in loading.read_table(spark, path).collect()] == ["a"]
    assert loading.load(spark.createDataFrame([(1, 2, "c")], df.schema), path, ("k",), "updated", F.lit(0)) == 1
    assert [r.payload for r in loading.read_table(spark, path).collect()] == ["c"]


def test_limits_by_hand():
    assert limits.admitted([0, 0, 0, 1, 9, 10, 11, 11], {}, 2, 10) == [True, True, False, False, False, True, True, False]
    assert limits.admitted([5, None, 3, 6], {}, 2, 1) == [True, False, True, True]


def test_streams_and_tables_are_limited_alike(spark, tmp_path):
    events = spark.read.parquet(EVENTS).orderBy("ts")
    times = [r.event_id for r in events.collect()]
    for n in range(4):  # in order of time, over several batches
        events.where(F.col("event_id").isin(times[n * 250 : n * 250 + 250])).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    schema = events.schema
    want = {r.event_id: r.admitted for r in limits.limited(events, "event_type", 3, 36_000, 10).collect()}
    assert 0 < sum(want.values()) < len(want)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = limits.limited_stream(source, "event_type", 3, 36_000, 10).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert {r.event_id: r.admitted for r in spark.table("limits").collect()} == want


def test_limits_of_odd_events(spark):
    rows = [(1, None, "2024-01-01 00:00:01"), (2, None, "2024-01-01 00:00:02"), (3, "a", None), (4, "a", "2024-01-01 00:00:01"), (5, "a", "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "event_id int, u string, t string").select("event_id", "u", F.to_timestamp("t").alias("ts"))
    found = {r.event_id: r.admitted for r in limits.limited(events, "u", 1, 60, 10).collect()}
    assert found == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert limits.limited(events.limit(0), "u", 1, 60, 10).collect() == []


def test_answers_to_requests(spark):
    decks = spark.createDataFrame([(1,), (2,), (2,), (None,)], "deck_id int")
    requests = [(1, "2-HIGH", "a"), (2, "1-URGENT", "b"), (2, "1-URGENT", "b"), (9, "3-MEDIUM", "c"), (1, "6-NONE", "d"), (9, "6-NONE", "e"), (None, "2-HIGH", "f"), (1, None, "g")]
    found = browsing.answers(spark.createDataFrame(requests, "deck_id int, kind string, at string"), decks)
    assert sorted((r["at"], r.status) for r in found.collect()) == [("a", 200), ("b", 200), ("b", 200), ("c", 404), ("d", 400), ("e", 400), ("f", 404), ("g", 400)]
    assert browsing.choice("desc", ("Asc", "Desc")) == "Desc"
    with pytest.raises(ValueError):
        browsing.choice("upwards", ("Asc", "Desc"))
    assert browsing.found(decks, deck_id=2).count() == 2
    with pytest.raises(LookupError):
        browsing.found(decks, deck_id=7)
    with pytest.raises(LookupError):
        export.export_rows(Star(spark, "/root/testdata/sf0.001"), 10_000_000)


def test_cards_have_all_fields(spark):
    row = export.cards(spark.range(1), {"FreqSort": F.col("id"), "Expression": F.lit("語")}).collect()[0]
    assert tuple(row.__fields__) == export.CARD and len(export.CARD) == 22
    assert {k: v for k, v in row.asDict().items() if v} == {"Expression": "語", "FreqSort": "0"}
    with pytest.raises(ValueError):
        export.cards(spark.range(1), {"Sound": F.lit("")})


def test_a_deck_of_more_than_a_million_words(spark):
    groups = spark.range(1_000_050).select(F.lit(2_000_000_000).alias("deck_id"), F.col("id").alias("word_id"), F.lit(0).alias("reading_index"), F.lit(1).alias("occurrences"), F.col("id").alias("fo"))
    ids = Star.numbered(groups).agg(F.min("deck_word_id").alias("low"), F.max("deck_word_id").alias("high"), F.countDistinct("deck_word_id").alias("n")).collect()[0]
    assert (ids.low, ids.high, ids.n) == (2_000_000_000 * DECK_SPAN + 1, 2_000_000_000 * DECK_SPAN + 1_000_050, 1_000_050)
