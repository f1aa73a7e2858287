"""Operators against brute force and libraries on small inputs, and what they do with odd tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.compare import check
from wordloom.llm import decontaminate, language, licences, lines, personal, quality, sentencepiece_codec, simhash, token_counts, toxicity
from wordloom.llm.components import components
from wordloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, n_removed string, score string, key string"
WORDS = "the cat sat on a mat and then it ran off to find some food near the old red barn where dogs sleep all day long".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, repeated ids, and columns named like results."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (None, "the cat sat on the mat and ran", None, None, 5), (3, long, "en", None, 7), (4, "x" * 200_000, "en", "b", 1), (5, "123 !!! 456", None, "b", 1),
        (6, "the cat sat on the mat and ran", "en", "b", 1), (6, "the cat sat on the mat and ran", "en", "b", 1), (7, "le chat est sur la table et il dort", "fr", "c", 1), (8, "日本語 テキスト\n\n \t", None, "c", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, "h", "n", "s", "k") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(QUERIES[name], ORACLES[name], spark, SF)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert "pipeline" in __spark_entry__.queries()


# 1


def test_blocks_of_the_benchmark_give_the_same_hits(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.contamination(docs, items).orderBy("doc_id").collect()
    many = decontaminate.contamination(docs, items, block_words=500).orderBy("doc_id").collect()
    assert [r.hits for r in one] == [r.hits for r in many]
    assert any(r.hits["items"] for r in one)


def test_blocks_are_bounded_for_repeated_items(spark):
    items = spark.createDataFrame([(1, "one two three four")] * 50 + [(i, f"item {i} has five words") for i in range(2, 40)] + [(50, "w " * 300), (51, None)], "item_id long, text string")
    blocks = [b for _, b in decontaminate._blocks(items, 100)]
    words = lambda b: sum(len(t.split()) for _, t in b)
    assert sorted(i for b in blocks for i, _ in b) == sorted(str(i) for i in [*range(1, 40), 50, 51])
    assert all(words(b) - max(len(t.split()) for _, t in b) <= 100 for b in blocks) and len(blocks) > 1


def test_offsets_are_those_of_the_original(spark):
    text = "Ünü — " + " ".join(WORDS[:20]).upper() + "!"
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(WORDS[2:17])), (8, "a, b"), (9, ""), (10, None)], "item_id long, text string")
    one, two = decontaminate.contamination(docs, items).orderBy("doc_id").collect()
    assert [text[s.start : s.end] for s in one.hits.spans] == [" ".join(WORDS[2:17]).upper()]
    assert (one.hits["items"], two.hits["items"], two.hits.n_words) == (["7"], ["8"], 2)


# 2


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language.op2_language(spark, "/root/testdata/sf0.1").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, rejected, score = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int")), F.avg("score")).first()
    assert right / n > 0.98 and rejected <= n * 0.01
    assert abs(score - right / n) < 0.02  # calibrated
    model = language.learn(docs.select("doc_id", "text", "lang"))
    rng = random.Random(8)
    strange = ["".join(rng.choices("bcdfghjklmnpqrstvwxz ", k=400)) for _ in range(20)] + ["пример текста на русском языке " * 10, "これは日本語の文章です。" * 20, "ez egy magyar nyelvű szöveg a kutyákról " * 8]
    assert all(r.rejected for r in language.identified(spark.createDataFrame([(t,) for t in strange], "text string"), model).collect())


def brute_language(rows, texts):
    """Cross-entropies of texts by language from rows (lang, text): interpolated Kneser-Ney over four letters by its definition."""
    units = lambda s: "".join(chr(u) for u in np.frombuffer(s.encode("utf-16-le"), "<u2"))
    stream = lambda t: units("\1\1\1" + "".join(c.lower() if c.isalpha() else " " for c in t))
    out = []
    for lang in sorted({x for x, _ in rows}):
        count = [{}, {}, {}, {}]
        for x, t in rows:
            if x == lang:
                s = re.sub(" +", " ", stream(t))
                for i in range(3, len(s)):
                    count[3][s[i - 3 : i + 1]] = count[3].get(s[i - 3 : i + 1], 0) + 1
        for o in (2, 1, 0):
            for longer in count[o + 1]:
                count[o][longer[1:]] = count[o].get(longer[1:], 0) + 1

        def p(s, count=count):
            if not s:
                return 1 / (len(count[0]) + 1)
            c = count[len(s) - 1]
            ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            same = {k: v for k, v in c.items() if k[:-1] == s[:-1]}
            total = sum(same.values())
            return (max(c.get(s, 0) - d, 0) / total if total and s in c else 0) + (d * len(same) / total if total else 1) * p(s[1:])

        own = []
        for t in texts:
            s = re.sub(" +", " ", stream(t))
            own.append(-sum(np.log2(p(s[i - 3 : i + 1])) for i in range(3, len(s))) / max(len(s) - 3, 1))
        out.append(own)
    return np.array(out).T


@pytest.mark.parametrize("broadcast", [1 << 28, 0])
def test_language_is_kneser_ney_by_its_definition(spark, broadcast):
    rows = [("en", "the cat sat on the mat and a cat ran"), ("en", "that is that and this is this"), ("fr", "le chat est sur la table et il dort"), ("fr", "une table est une table"), ("xx", "𐐀𐐁𐐂 𐐀𐐁 𝒜 𐐃𐐀𐐁")] * 6
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in zip(ids, rows)], "doc_id long, text string, lang string")
    model = language.learn(docs, broadcast=broadcast)
    assert (model["arrays"] is None) == (broadcast == 0)
    kept = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).collect()}
    texts = ["the mat", "la chatte est là", "𐐂𐐀", "thesis unexampled", "cat!! cat"]
    brute = brute_language([(x, t) for i, (x, t) in zip(ids, rows) if i not in kept], texts)
    found = language.with_bits(spark.createDataFrame(list(enumerate([*texts, "", "12", None])), "i long, text string"), model).orderBy("i").collect()
    assert np.allclose([r[language._BITS] for r in found[:5]], brute, atol=1e-4)
    assert [r[language._N] for r in found[5:]] == [0, 0, 0]
    named = language.identified(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model).orderBy("i").collect()
    assert [r.lang_pred for r in named] == [model["langs"][k] for k in brute.argmin(axis=1)] and named[2].lang_pred == "xx"
    excess = (brute - brute.min(axis=1)[:, None]) * np.array([r[language._N] for r in found[:5]])[:, None]
    assert np.allclose([r.score for r in named], 1 / np.exp2(-excess / model["temperature"]).sum(axis=1), atol=1e-3)


def test_kneser_ney_is_a_distribution(spark):
    docs = spark.createDataFrame([("en", "the cat sat on the mat"), ("en", "a cat ran")], "lang string, text string")
    parts, weights, letters = language.tables(language.string_counts(docs))
    model = language.arrays(parts.toPandas(), weights.toPandas(), letters)
    uniques = np.unique(language.streams(["the cat sat on the mat", "a cat ran"])[0])
    units = sorted({int(k) & 0xFFFF for k in uniques})
    for context in (int(uniques[0]) >> 16, int(uniques[7]) >> 16, 0x7A007A007A):
        grams = np.array([((context << 16) | c) & ((1 << 64) - 1) for c in [*units, 0x3042]], np.uint64)
        assert abs(np.exp2(language.log_probabilities(model, grams)[:, 0].astype(float)).sum() - 1) < 1e-4


def test_a_hot_language_leaves_the_strings_of_others(spark):
    rng = np.random.default_rng(6)
    hot = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 20_000))) for _ in range(11)]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]  # not held out
    rows = list(zip(ids, [*hot * 3, *["quick brown fox jumps"] * 3], ["hot"] * 33 + ["small"] * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model["langs"] == ["hot", "small"] and model["parts"].count() > 400_000
    assert {r.lang_pred for r in language.identified(docs.where("lang = 'small'"), model).collect()} == {"small"}


def test_language_is_calibrated_by_all_documents_that_are_not_counted(spark, monkeypatch):
    seen, calibrated = [], language.calibrated
    monkeypatch.setattr(language, "calibrated", lambda langs, judged: seen.append(judged.count()) or calibrated(langs, judged))
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat sat on "), "id").alias("text"), F.lit("en").alias("lang"))
    language.learn(docs)
    assert seen == [language.learning(docs).where(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).count()] and seen[0] > 3000


def test_calibration_against_numpy(spark):
    rng, langs = np.random.default_rng(4), ["de", "en", "xx"]
    rows = [(langs[i % 2], (rng.normal(3, 0.3, 3) + 0.4 * (np.arange(3) != i % 2)).tolist(), int(rng.integers(5, 400))) for i in range(2001)]
    found = language.calibrated(langs, spark.createDataFrame([*rows, ("none", [1.0, 1.0, 1.0], 9), ("en", [0.0, 0.0, 0.0], 0)], "lang string, bits array<double>, n long").repartition(3))
    own, bits, n = np.array([langs.index(r[0]) for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    excess, z = (bits - bits[np.arange(len(rows)), own][:, None]) * n[:, None], []
    assert found["temperature"] == min(np.geomspace(1, 1e5, 201), key=lambda t: np.logaddexp2.reduce(-excess / t, axis=1).mean())
    median = lambda x: np.quantile(x, 0.5, method="inverted_cdf")
    for k in (0, 1):
        mine = (own == k) & (bits.argmin(axis=1) == k)
        b, m = bits[mine, k], n[mine]
        off = b - median(b[m >= median(m)])
        far, near = 1.4826 * median(np.abs(off[m >= median(m)])), 1.4826 * median((np.abs(off) * np.sqrt(m))[m <= median(m)])
        assert np.allclose([found["mean"][k], found["far"][k], found["near"][k]], [b[0] - off[0], far, near])
        z += (off / np.sqrt(far**2 + near**2 / m)).tolist()
    assert found["limit"] == pytest.approx(max(language.LEAST_LIMIT, language.MARGIN * np.quantile(z, 1 - language.REJECTED, method="inverted_cdf")))
    assert (found["mean"][2], found["far"][2], found["near"][2]) == (8.0, 0.02, 0.5)


# 3


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                group[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, texts):
    found = {r.doc_id: r for r in simhash.op3_simhash(spark, SF).collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    assert [int(found[i].fingerprint, 16) for i in ids] == prints
    assert [found[i].component_id for i in ids] == [ids[g] for g in brute_components(prints)]


def test_large_groups_of_near_copies_lose_no_link(spark):
    rng = random.Random(5)
    prints = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(500):
            v = centre
            for _ in range(rng.choice((0, 1, 2, 3, 3, 4, 6))):
                v ^= 1 << rng.randrange(64)
            prints.add(v)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    for bucket in (256, 20):  # the smaller one splits most buckets, down to the last bits
        stars = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(simhash.near_edges(frame, bucket)).collect()}
        own = {}
        for p in prints:
            own.setdefault(stars.get(p, p), set()).add(p)
        brute = {}
        for p, g in zip(prints, brute_components(prints), strict=True):
            brute.setdefault(g, set()).add(p)
        assert sorted(map(sorted, own.values())) == sorted(map(sorted, brute.values()))


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from wordloom.plans.staging import shared_dir

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    assert shared_dir(unset("local[4]")).endswith("/wordloom-a")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(unset(master))


def test_any_five_bytes_hold_a_set():
    import itertools

    sets = [sum(1 << i for i in range(8) if m >> i & 1) for m in simhash.quadruples([1 << i for i in range(8)])]
    assert len(sets) == 14
    assert all(any(s & five == s for s in sets) for five in (sum(1 << i for i in c) for c in itertools.combinations(range(8), 5)))


# 4 and 9


def strange_texts():
    rng = random.Random(3)
    return ["", " ", "  a", "▁▁x", "\n\n a\n", "ΣΑΣ Σ", "İI", "<|endoftext|>a", "😀😀 x", "a'sS 'll's", "日本語 １２", "a" * 3000, " x　y\u0085z", "ab" * 100 + " é"] + ["".join(rng.choice(" \n\t▁aebt'sΣßéǅ１23日😀.-<|>²") for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_codec_is_the_library(spark):
    import sentencepiece

    path = sentencepiece_codec.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = strange_texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("ids", sentencepiece_codec.encode(F.col("text"), spark, path))
    docs = docs.withColumn("back", sentencepiece_codec.decode(F.col("ids"), spark, path)).withColumn("r", sentencepiece_codec.round_trip(F.col("text"), spark, path))
    for r in docs.collect():
        ids = library.encode(r.text)
        assert r.ids == ids and r.back == library.decode(ids) == r.r.decoded
        assert (r.r.n_tokens, r.r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))


def test_both_agendas_agree():
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.model_path(), "rb").read())
    for text in strange_texts():
        if text:
            assert list(codec.merged_few(text)) == list(codec.merged_many(text))


def test_codec_keeps_the_chunks_in_use(monkeypatch):
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.model_path(), "rb").read())
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 300)
    merged, merge = [], codec.merge
    monkeypatch.setattr(codec, "merge", lambda chunk: merged.append(chunk) or merge(chunk))
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 50)
    texts = [f"the cat sat on the mat w{i}x and ran" for i in range(2000)]
    assert list(codec.encode(texts)) == codec.library.encode(texts)
    assert merged.count("▁cat") == 1 and len(codec.known) + len(codec.older) < 700


def test_token_counts_are_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = strange_texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.token_report(docs, path).collect()}
    assert [found[i] for i in range(len(rows))] == [len(library.encode(t, add_special_tokens=False).ids) for t in rows]
    assert len(token_counts.whole_tokens(open(path, encoding="utf-8").read())) > 30_000


# 5


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0]), s[2]))


def test_base_spans():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("a@.1 2-+()9x%é0@.") for _ in range(rng.randint(1, 60)))
        assert personal.base_spans(text) == brute_spans(text)
    assert personal.base_spans("0" * 6000 + ".1.1.1") == [("ip", 0, 6006)]


def test_personal_data(spark, texts):
    for r in personal.op5_personal_data(spark, SF).collect():
        base = ["%s:%d:%d" % s for s in brute_spans(texts[r.doc_id])]
        assert r.base_sha256 == sha(",".join(base))
        assert set(base) <= set(r.spans.split(","))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_trees_add_loose_spans_and_keep_base_ones(spark):
    rows = [("phone", "call me at ", "+1 (212) 555-01%02d" % i, " now", True) for i in range(60)] + [("email", "write to ", f"joe{i}@mail{i}.example.com", " now", True) for i in range(60)]
    rows += [("phone", 'token = "a', "%012d" % (i * 7919), 'ef" x', False) for i in range(200)]
    model = personal.train(rows)
    text = "write to jane.roe at example dot com or +1 (212) 555-0199"
    base, found = personal.find([text], model)[0]
    assert base == [("phone", 40, 57)] and ("email", 9, 36) in found and set(base) <= set(found)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("s", personal.spans(F.col("text"), spark, model))
    assert docs.select(personal.redacted(F.col("text"), F.col("s.found"))).first()[0] == "write to [email] or [phone]"


def test_trees_find_what_formats_miss(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = personal.learn(docs)
    rng, cases = random.Random(7), []
    for i in range(300):
        filler = " ".join(rng.choices(WORDS, k=12))
        digits = "".join(rng.choices("0123456789", k=15))
        card = next(digits + c for c in "0123456789" if personal.luhn(digits + c))
        broken = digits + str((int(card[-1]) + 5) % 10)
        secret = "%040x" % rng.getrandbits(160)
        kind, span, sure = [("secret", secret, True), ("card", f"{card} {card}", True), ("card", broken, False), ("email", f"jo{i} at mail{i} dot example dot com", True), (None, "-" * 40, False)][i % 5]
        cases.append((kind, f'{filler} {"token = " if kind == "secret" else ""}"{span}" {filler}', sure))
    found = personal.find([t for _, t, _ in cases], model)
    hit = [(sure, kind in {k for k, *_ in spans}) for (kind, _, sure), (_, spans) in zip(cases, found, strict=True)]
    recall, clean = np.mean([h for sure, h in hit if sure]), np.mean([not h for sure, h in hit if not sure])
    assert recall > 0.9 and clean > 0.97, (recall, clean)
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(3000).collect()]
    planted = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t)) for t in texts)
    assert sum(k == "secret" for _, spans in personal.find(texts, model) for k, *_ in spans) >= planted > 20


@pytest.mark.parametrize("collected", [personal.COLLECTED, 0])
def test_trees_learn_from_the_candidates_of_all_documents(spark, monkeypatch, collected):
    monkeypatch.setattr(personal, "TREES", 6)
    places = spark.range(9000).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1).limit(400)  # of 8000 documents or more, those in the other half were left out
    rows = [(r.id, f"call me at +1 (212) 555-{i:04d} now, order {10**11 + i * 7919}ef" + (f" from 10.0.{i % 200}.7" if i % 3 else f" or joe{i}@mail.example.com")) for i, r in enumerate(places.orderBy("id").collect())]
    docs = spark.range(9000).withColumnRenamed("id", "doc_id").join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "left")
    model = personal.learn(docs, collected)
    seen = []
    for _, text in rows:
        base = personal.base_spans(text)
        seen += [(k, *personal.around(text, a, b), own) for own, of in ((True, base), (False, personal.candidates(text, base))) for k, a, b in of]
    brute = personal.train(seen)  # the same in memory
    assert model["start"] == pytest.approx(brute["start"]) and model["least"] == pytest.approx(brute["least"])
    x = np.array([v for c in seen for v, _, _ in personal.examples(*c)])
    assert len(x) > 2000 and np.allclose(personal.probability(model, x), personal.probability(brute, x))


def test_many_spans_take_linear_time():
    import time

    text = " ".join(f"+1 212 555 {i:04d} or 10.0.{i % 256}.7" for i in range(20_000))
    began = time.perf_counter()
    base = personal.base_spans(text)
    personal.candidates(text, base)
    assert time.perf_counter() - began < 10 and len(base) > 20_000


# 6


def test_later_passages_go_and_first_ones_stay(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"own start here\n{passage}\nown end"), (1, f"{passage}\nfirst one"), (3, "quite\nanother\ntext"), (4, passage), (5, "x y\n quite \n\nanother\ntext"), (6, None), (7, " \n ")]
    found = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].text == rows[1][1] and found[3].text == rows[2][1] and found[6].text is None and found[7].text == " \n "
    own = [w for w in found[2].text.split() if w[0] != "w"]
    assert own == "own start here own end".split() and len(found[2].text.split()) - 5 == 60 - found[2].n_removed <= 2 * (lines.SPREAD - 1)
    assert found[4].n_removed >= 60 - 2 * (lines.SPREAD - 1)
    assert (found[5].text, found[5].n_removed) == ("x y", 3)
    named = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(named).collect()} == {f"d{i}": r.n_removed for i, r in found.items()}


def test_passages_are_found_at_any_offset(spark):
    passage = [f"w{i}" for i in range(51)]
    ends = " ".join(passage[:20]) + "\n" + " ".join(passage[20:])
    rows = [(0, "first " + " ".join(passage) + " end", 0), (1, "begun " + ends + " done", 0)]
    rows += [(10 + k, " ".join([*(f"a{k}x{i}" for i in range(k)), *passage, *(f"b{k}x{i}" for i in range(40))]), 0) for k in range(26)]
    near = passage[:]
    near.insert(3, "inserted")
    rows += [(50, " ".join(near + [f"w{i}" for i in range(51, 60)]), 0), (60, "own\nlines " + " ".join(f"u{i}" for i in range(80)), 0)]
    found = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    known = {i: t for i, t, _ in rows}
    assert found[0] == known[0] and found[60] == known[60]
    for i in (1, *range(10, 36), 50):
        left = [w for w in found[i].split() if w[0] == "w"]
        assert len(left) <= 2 * (lines.SPREAD - 1), i
        assert [w for w in found[i].split() if w[0] != "w"] == [w for w in known[i].split() if w[0] != "w"], i


def test_recall_on_planted_passages(spark):
    """Passages of 51 to 90 words of the tables' own texts, planted mid-line at any place of other texts."""
    rng = random.Random(9)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 800 and 5000").orderBy("doc_id").limit(200).collect()]
    rows, planted = [], {}
    for i, text in docs:
        words = text.split()
        n = rng.randint(51, 90)
        if len(words) > n:
            at, host = rng.randrange(len(words) - n), [f"h{i}x{k}" for k in range(100)]
            cut = rng.randrange(100)
            rows += [(i, text), (100_000 + i, " ".join(host[:cut] + words[at : at + n] + host[cut:]))]
            planted[100_000 + i] = n
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100000").select("doc_id", "n_removed", "text").collect()
    assert len(planted) > 100 and all(r.n_removed > 0 for r in found)
    assert sum(min(r.n_removed, planted[r.doc_id]) for r in found) > 0.65 * sum(planted.values())
    assert all(sum(w[0] == "h" and "x" in w for w in r.text.split()) == 100 for r in found)


def test_windows_are_rows_of_generated_code(spark):
    """Their places against brute force; ranks are the only pass over words by a lambda."""
    rng = random.Random(5)
    texts = [rng.choice(["", " ", "\n\t"]) + "".join(rng.choice(["a", "e", "be", "eb", "é", "seen", "word", "z" * 70]) + rng.choice([" ", " ", "  ", "\n", "\t\r\n", "\x0b", "\x0c "]) for _ in range(n)) for n in [*range(60), 200, 700]]
    rows = [*enumerate(texts), (100, None), (101, " ".join(["same"] * 90)), (102, "a\nb"), (103, "a\n \nb\nc")]
    found = lines.windows_of(spark.createDataFrame(rows, "n int, text string")).drop("doc_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" not in plan and sum(line.count("transform(") for line in plan.splitlines() if "octet_length" in line) == 1
    expected, by_hash = set(), {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        ranks = [(w.find("e") + 1 - 64 * len(w.encode()), k) for k, w in enumerate(words)]
        starts = {min(ranks[k : k + lines.SPREAD])[1] for k in range(len(words))}
        expected |= {(i, k + (1 << 30), tuple(words[k : k + 30])) for k in starts if k + 30 <= len(words)}
        own = [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in (text or "").split("\n")) if x]
        expected |= {(i, k, ("lines", *own[k : k + 3])) for k in range(len(own) - 2)}
    known = {(i, at): window for i, at, window in expected}
    got = found.collect()
    assert len(got) == len(expected) > 300 and {(r[0], r[1]) for r in got} == set(known)
    for r in got:
        by_hash.setdefault((r[2], r[3]), set()).add(known[r[0], r[1]])
    assert all(len(w) == 1 for w in by_hash.values()) and len(by_hash) == len(set(known.values()))


# 7


def test_notices(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "released under the MIT License, and the mit license", "GNU General Public License, version 3", "cc xx by", None, "cc by"]
    found = licences.places(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    labels = [sorted({p.label for p in r.places}) for r in found]
    assert labels == [["cc-by", "cc-by-nc"], ["mit"], ["gpl", "gpl-3.0"], [], [], ["cc-by"]]
    assert [len([p for p in r.places if p.base]) for r in found] == [1, 2, 1, 0, 0, 1]


def test_whole_licence_texts_and_many_licence_words(spark):
    import time

    mit = next(x for x in licences.templates() if x["label"] == "mit-text")["words"]
    worn = [w if i % 8 or "hereby" in mit[i - 3 : i + 5] else "xyz" for i, w in enumerate(mit)]
    rows = [" ".join(mit).upper(), " ".join(["start", *worn, "end"]), " ".join(mit[: len(mit) // 2]), "mit license " * 32_000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(1)
    licences.places(docs.where("doc_id < 3")).collect()
    began = time.perf_counter()
    found = licences.places(docs).orderBy("doc_id").collect()
    took = time.perf_counter() - began
    labels = [{p.label for p in r.places} for r in found]
    assert {"mit", "mit-text"} <= labels[0] and "mit-text" in labels[1] and "mit-text" not in labels[2] and labels[3] == {"mit"}
    assert 0.8 <= next(p.share for p in found[1].places if p.label == "mit-text") < 0.95 and found[1].places[-1].at == 1
    assert len(found[3].places) == 32_000 and took < 10, took


# 8


def test_hosts_decide(spark):
    good = " ".join(f"w{i}" for i in range(80))
    symbols = " ".join(f"w{i} #" for i in range(80))
    rows = [(i, good, "good") for i in range(400)] + [(400, symbols, "good")]  # trusted: its odd document stays
    rows += [(1000 + i, symbols if i % 4 == 0 else good, "ordinary") for i in range(400)]
    rows += [(2000 + i, "short" if i % 10 else good, "bad") for i in range(500)] + [(3000, good, None), (3001, symbols, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality.judged(docs)
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert kept == {*range(401), *(1000 + i for i in range(400) if i % 4), 3000}
    assert found.columns[:3] == docs.columns
    alone = {r.doc_id for r in quality.judged(docs.drop("source")).where("kept").collect()}
    assert 2010 in alone and 400 not in alone


def test_strict_and_lenient_hosts(spark):
    """Alike documents between the limits go in hosts that fail often, and stay in others."""
    good, some = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" + " #" * (i % 12 == 0) for i in range(80))  # 7 symbols
    more, much = " ".join(f"w{i}" + " #" * (i % 4 == 0) for i in range(80)), " ".join(f"w{i} #" for i in range(80))  # 20, 80
    rows = []
    for host, share in (("often", 5), ("usual", 9), ("usual2", 9), ("rarely", 14)):
        rows += [(len(rows) + i, much if i % share == 0 else good, host) for i in range(600)]
        rows += [(10_000 * len(host), some, host), (10_000 * len(host) + 1, more, host)] if host != "usual2" else []
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {(r.source, r.doc_id % 10_000): r.kept for r in found.where("doc_id >= 10000").collect()}
    assert kept == {("often", 0): False, ("often", 1): False, ("usual", 0): True, ("usual", 1): False, ("rarely", 0): True, ("rarely", 1): True}
    assert found.where(f"text = '{good}' and not kept").count() == 0 and found.where(f"text = '{much}' and kept").count() == 0


def test_hosts_change_rows_of_the_tables(spark):
    found = quality.op8_quality(spark, "/root/testdata/sf0.1")
    n, dropped = found.agg(F.count("*"), F.sum((~F.col("base_failed") & ~F.col("kept")).cast("int"))).first()
    assert 0.01 * n < dropped < 0.1 * n
    # With one verdict for all hosts no document would be judged otherwise than by the usual limits. These hosts hardly
    # differ, and few documents lie between the limits: some are kept by lenient hosts, and clean ones aren't dropped by strict ones
    usual = "not base_failed and 100 * n_symbols <= 10 * n_words and 100 * n_dup_lines <= 50 * n_lines"
    assert found.where(f"not ({usual}) and kept").count() >= 1
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    assert found.where("not base_failed and not kept").join(labels, "doc_id").agg(F.avg("quality")).first()[0] < 0.05


# 10


def brute_kernel(a, b):
    def phi(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel():
    words = sorted(["^idiot", "^idxiot", "^banana", "^worthless", "^abab", "^idiooooooot", "^soooooooooooo", "^日本語", "^日本話"])
    values = toxicity.kernels(words, toxicity.Phrases([(w,) for w in words], words))
    assert np.allclose(values, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)
    assert toxicity.parts("abcdefghijklmnop") == ["^abcdefghijklmno", "ijklmnop"] and toxicity.parts("ab") == ["^ab"]


def insults():
    rng = random.Random(4)
    clean = [tuple("^" + "".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "ba"]) for _ in range(3)) for _ in range(2)) for _ in range(600)]
    bad = ["^idiot", "^moron", "^worthless", "^stupid"]
    return [(rng.choice(clean)[0], rng.choice(bad)) for _ in range(60)] + clean[400:], clean[:400]


def test_machine_tolerates_gaps():
    scorer = toxicity.Scorer(toxicity.fitted(*insults()))
    bad = [scorer.worst(x)[0] for x in ("you idiot!", "i.d.i.o.t", "i d i o t", "st-upid", "worthlesss", "m0ron", "stupidd", "ka idxiot")]
    assert min(bad) > max(scorer.worst(x)[0] for x in ("kalomi tensurba", "bamiten", "")) + 0.3


def test_scores_are_those_of_the_kernel(spark):
    model = toxicity.fitted(*insults()) | {"curve": [1.5, 0.5, 0.25, -1.0]}
    rows = ["you idiot. kalomi tensurba, worthless bamiten", "kalomi tensurba. kalomi tensurba!", "", None, "st-upid\n" * 3, "x " * 50]
    found = toxicity.toxicity(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).orderBy("doc_id").collect()

    def decision(phrase):
        return model["bias"] + sum(a * sum(brute_kernel(w, u) for w in phrase for u in mark if len(w) > 2 and len(u) > 2) for a, mark in zip(model["alpha"], model["marks"], strict=True))

    for r, text in zip(found, rows, strict=True):
        values = sorted((decision(p) for p in set(toxicity.phrases(text or ""))), reverse=True)[:3]
        values = [min(max(x, -2), 3) for x in values + [-2] * (3 - len(values))]
        assert abs(r.score - 1 / (1 + np.exp(1.0 - np.dot(model["curve"][:3], values)))) < 1e-3, text
        assert r.predicted == int(r.score >= 0.5)


def test_fits_alike_under_any_hash_seed():
    import subprocess
    import sys

    code = "import tests.llm.test_operators as t, hashlib; m = t.toxicity.fitted(*t.insults()); print(hashlib.sha256(m['weights'].round(4).tobytes()).hexdigest(), m['marks'])"
    runs = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONHASHSEED": seed}).stdout for seed in ("1", "2", "3")}
    assert len(runs) == 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity(docs, toxicity.learn(docs, labels)).where(toxicity.held_out()).join(labels, "doc_id").select("lang", "toxic", "predicted").toPandas()
    for lang in ("en", "fr", "es", "de"):
        own = found[found.lang == lang]
        assert own[own.toxic == 1].predicted.mean() > 0.8, lang
        assert own[own.toxic == 0].predicted.mean() < 0.05, lang


# odd tables


def cases(spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (None, "il dort"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(3, 0, 1), (6, 0, 0), (7, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    import public_tokenizers

    return {
        "decontaminate": lambda d: decontaminate.contamination(d, items), "decontaminate_stage": lambda d: decontaminate.decontaminate(d, items), "language": lambda d: language.identified(d, language.learn(d)), "language_stage": language.in_a_language, "simhash": simhash.near_duplicates, "simhash_stage": simhash.one_of_each,
        "codec": lambda d: d.withColumn("r", sentencepiece_codec.round_trip(F.col("text"), spark, sentencepiece_codec.model_path())), "personal": lambda d: d.withColumn("s", personal.spans(F.col("text"), spark, personal.learn(d))), "lines": lines.dedup_lines, "lines_stage": lines.without_repeats, "licences": licences.places,
        "quality": quality.judged, "tokens": lambda d: token_counts.token_report(d, public_tokenizers.path("word_bpe_49k.json")), "toxicity": lambda d: toxicity.toxicity(d, toxicity.learn(d, labels)),
    }


@pytest.mark.parametrize("name", ["decontaminate", "decontaminate_stage", "language", "language_stage", "simhash", "simhash_stage", "codec", "personal", "lines", "lines_stage", "licences", "quality", "tokens", "toxicity"])
def test_odd_tables(spark, odd, name):
    operator = cases(spark)[name]
    rows = operator(odd).collect()
    if name.endswith("_stage"):
        assert set(rows[0].__fields__) == set(odd.columns) and all(r.hits == "h" and r.score == "s" for r in rows)
    else:
        assert len(rows) == 11
    assert operator(odd.limit(0)).collect() == []


def test_stages_on_odd_tables(spark, odd):
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.collect())
    assert ids(simhash.one_of_each(odd)) == [1, 3, 4, 5, 6, 7, 8]
    assert ids(lines.without_repeats(odd))[-1] == 8
    same_id = spark.createDataFrame([(1, "one text of its own", "en"), (1, "quite another thing that it says", "en"), (None, "one text of its own", "en"), (None, "a third text without an id", "en"), (2, "quite another thing that it says", "fr")] * 2, "doc_id long, text string, lang string")
    assert sorted((r.doc_id or -1, r.text[:3]) for r in simhash.one_of_each(same_id).collect()) == [(-1, "a t"), (1, "one"), (1, "qui")]


# the pipeline


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    seen = [len(known)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] > 0.97 * seen[0]
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {r.doc_id: sha(r.text) for r in docs.collect()} == {i: r.decoded_sha256 for i, r in last.items()}
    assert {i: r.ids_sha256 for i, r in last.items()} == {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
