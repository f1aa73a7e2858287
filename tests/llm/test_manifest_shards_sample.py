"""Merkle manifest, sharding and resampling against brute force, with hot groups, nulls and odd tables."""

import hashlib
import math
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from wordloom.llm import merkle, resampling, sharding

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, shard string, rank string, weight string, size string, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a", "en", 3, "One TWO"), (2, "a", None, None, None), (None, "a", "en", 1, "three"), (2, "a", None, None, None), (5, None, "en", 0, ""), (6, None, "de", 4, "Ünder Ätzend"),
        (7, "b", "en", 9, "lone word"), (8, "ä", "en", 9, "one two three"), (9, "Z", None, 2, "word " * 30_000), (-3, "a", "en", 1, "x"),
    ]
    return spark.createDataFrame([(*r, "l", "s", "r", "w", "z", "t") for r in rows], COLUMNS)


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, from lists."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        """The root, and the siblings before and after each node up to it."""
        paths, places = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(places):
                first = at // 16 * 16
                paths[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            places = [p // 16 for p in places]
        return nodes[0], paths

    ordered = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(ordered, key=lambda r: r[1])]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), upper in zip(groups, trees, above, strict=True):
        for r, path in zip(group, paths, strict=True):
            proof = path + upper
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            node = leaf(changed)
            for before, after in proof:
                node = sha(before + node + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in proof)), node, node == root))
    return out


def manifest_rows(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_manifest_of_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_rows(merkle.manifest(odd, merkle.lower_cased_fifth)) == sorted(map(repr, brute_manifest(rows)))


@pytest.mark.parametrize("depth", [1, 2])
def test_superblocks_of_several_rounds(spark, depth):
    """A large source, and more sources than a superblock holds, at depths that need several rounds."""
    rows = [(i, "big" if i % 3 else f"s{i % 40}", "en", i, f"Text {i % 7}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(merkle.manifest(docs, merkle.lower_cased_fifth, depth=depth)) == sorted(map(repr, brute_manifest(rows)))


def test_proofs_and_an_empty_table(spark, odd):
    for r in merkle.manifest(odd, with_proofs=True).collect():
        assert r.verified and merkle.folded(r.leaf, [(p.before, p.after) for p in r.proof]) == r.root
        assert merkle.proof_digest([(p.before, p.after) for p in r.proof]) == r.proof_sha256
    assert merkle.manifest(odd.limit(0)).collect() == []
    alone = merkle.manifest(odd.where("doc_id = 7")).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == sha("")
    assert merkle.manifest(odd.drop("lang")).count() == odd.count()


def brute_shards(rows, shards=sharding.SHARDS):
    """{(doc_id, text): sorted (shard, slot)} from a sort of all rows."""
    keyed = sorted((int(sha(t or "")[:15], 16), -(2**63) if d is None else d, t) for d, t in rows)
    sizes = [len((t or "").encode()) + 8 for *_, t in keyed]
    total, start, starts = sum(sizes), 0, []
    for s in sizes:
        starts.append(start)
        start += s
    group = {k: (starts[i], 0) for i, (k, *_) in reversed(list(enumerate(keyed)))}
    for (k, *_), s in zip(keyed, sizes, strict=True):
        group[k] = (group[k][0], group[k][1] + s)
    out, slots = {}, {}
    for (k, d, t), a, s in zip(keyed, starts, sizes, strict=True):
        first, whole = group[k]
        twice = 2 * first + whole if whole * sharding.WHOLE * shards <= total else 2 * a + s
        shard = twice * shards // (2 * total)
        out.setdefault((d, t or ""), []).append((shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    return {k: sorted(v) for k, v in out.items()}


def found_shards(docs, **options):
    out = {}
    for r in sharding.sharded(docs, columns=("doc_id", "text"), **options).collect():
        assert (r["size"], r.text_crc32) == (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
        out.setdefault((-(2**63) if r.doc_id is None else r.doc_id, r.text or ""), []).append((r.shard, r.slot))
    return {k: sorted(v) for k, v in out.items()}


def test_shards_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_shards(odd) == brute_shards(rows)
    assert found_shards(odd, shards=2) == brute_shards(rows, 2)
    assert sharding.sharded(odd.limit(0)).collect() == []


def test_a_third_of_all_rows_alike(spark):
    """Copies of one text, very many null texts, and one row repeated: ranges are cut within them, and shards stay near equal."""
    rows = [(i, f"text {i} " + "w " * (i % 50)) for i in range(3000)] + [(10_000 + i, "the same text again and again") for i in range(3000)] + [(20_000 + i, None) for i in range(2500)] + [(7, "one row")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found_shards(docs) == brute_shards(rows)
    sizes = [r["s"] for r in sharding.sharded(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * sum(sizes) / 24 / 100 + 2 * 120


def test_overfull_ranges_are_cut_within_a_text(spark):
    rows = [(i, "same") for i in range(4000)] + [(10_000 + i, f"other {i}" * 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = (F.octet_length("text") + 8).cast("long").alias("size")
    key = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    keyed = docs.select(size, key.alias(sharding._KEY), F.col("doc_id").alias(sharding._ID), F.monotonically_increasing_id().alias(sharding._TIE))
    splitters, counts = sharding.cut(keyed, 24)
    assert sum(n for _, n in counts.values()) == 4400 and max(n for _, n in counts.values()) <= 4400 // 24
    assert any(i != sharding._LEAST for _, i, _ in splitters)


def test_written_shards_are_read_back(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "s"), 4)
    read = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, read.select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))


def brute_resampled(docs, target, percent=25, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, n in ((docs, s), (target, t)):
        for *_, text in texts:
            for f in features(text)[0]:
                n[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for d, text in docs:
        found, words = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(sha(f"7:{'' if d is None else d}")[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(repr((*r[:4], ranks.get(id(r)))) for r in rows)


def test_resampling_of_odd_rows(spark, odd):
    target = [(1, "one two three one"), (2, None), (3, "word word"), (4, "ünder")]
    docs = odd.select("doc_id", "text", "rank", "weight").union(spark.createDataFrame([(100 + i, f"one two {i} three word " * 8, "r", "w") for i in range(40)] + [(None, "two " * 25, "r", "w")] * 2, "doc_id long, text string, rank string, weight string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = resampling.resampled(docs, spark.createDataFrame(target, "item_id long, text string"))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_resampled(rows, target)


def test_resampling_without_rows(spark, odd):
    empty = odd.select("doc_id", "text").limit(0)
    assert resampling.resampled(empty, empty).collect() == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(repr(tuple(r)) for r in resampling.resampled(odd, empty).collect()) == brute_resampled(rows, [])


def test_longer_runs(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "")], "doc_id long, text string")
    rows = resampling.features(docs, orders=3).orderBy("doc_id", "_wordloom_row").collect()
    one = sorted((r.b1, r.b2, r.b3) for r in rows if r.doc_id == 1 and r.b3 is not None)
    assert one == sorted((zlib.crc32(a) % 10000, zlib.crc32(b) % 10000, zlib.crc32(c) % 10000) for a, b, c in ((b"a", b"a b", b"a b c"), (b"b", b"b c", b"b c d")))
    assert [(r.b1, r.b2, r.b3) for r in rows if r.doc_id == 2] == [(None, None, None)]

