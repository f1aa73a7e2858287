"""What the stages leave in an executor's memory: workers, and what these remember."""

from __future__ import annotations

import random
import tracemalloc

import pytest

pytest.importorskip("pyarrow")

from wordloom.llm import common, language, sentencepiece_codec, simhash

SF = "/root/testdata/sf0.001"


def codec():
    with open(sentencepiece_codec.model_path(), "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def test_calibration_judges_each_text_once(spark, monkeypatch):
    plans = {}

    def planned(df, name, staged=language.staged):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(language, "staged", planned)
    language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    assert plans["calibration"].count("ArrowEvalPython") == 1


def test_calibration_leaves_out_texts_without_letters(spark):
    judged = spark.createDataFrame([("en", [1.0, 2.0], 10), ("fr", [2.5, 1.5], 12), ("en", [0.0, 0.0], 0), ("xx", [1.0, 1.0], 5)], "lang string, bits array<double>, n long")
    assert language.calibrated(["en", "fr"], judged) == language.calibrated(["en", "fr"], judged.where("n > 0 and lang <> 'xx'"))


def test_near_edges_start_no_workers_of_another_kind(spark):
    rows = [(0, 1), (-1, -(1 << 63))]
    pairs = simhash._pairs(spark, rows)
    assert sorted(map(tuple, pairs.collect())) == sorted(rows) and pairs.dtypes == [("mask", "bigint"), ("finer", "bigint")]
    assert "PythonRDD" not in pairs._jdf.rdd().toDebugString()


def test_remembered_chunks_are_small():
    rng, own = random.Random(5), codec()
    texts = [" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(8)) for _ in range(200)) for _ in range(100)]
    tracemalloc.start()
    try:
        for _ in own.parts(texts):
            pass
        took, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(own.known) > 19_000 and took < 230 * len(own.known)


def test_long_chunks_are_forgotten_by_their_characters(monkeypatch):
    own = codec()
    monkeypatch.setattr(sentencepiece_codec, "CHARACTERS", 20_000)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 500)
    texts = [f"{i}" + "日本語" * 100 for i in range(200)]
    assert list(own.encode(texts)) == own.library.encode(texts)
    assert sum(len(c) for c in (*own.known, *own.older)) < 40_000


def test_decodings_that_differ_are_kept_as_long_as_their_chunks(monkeypatch):
    own, text_of = codec(), sentencepiece_codec.Codec.text_of
    # As if the library showed one piece in another way: decodings aren't chunks put together again
    monkeypatch.setattr(own, "text_of", lambda ids: text_of(own, ids).replace("cat", "CAT"))
    decode = own.library.decode

    class Library:
        encode = staticmethod(own.library.encode)

        @staticmethod
        def decode(ids, **options):
            return [x.replace("cat", "CAT") for x in decode(ids, **options)]

    own.library = Library
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 20)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 50)
    texts = [f"the cat w{i} sat" if i < 40 or i > 400 else f"the dog w{i} ran" for i in range(500)]
    assert [shown for _, shown in own.parts(texts)] == [" " + t.replace("cat", "CAT") for t in texts]
    assert own.differs.keys() <= own.known.keys() | own.older.keys()


def test_released_memory_goes_back(monkeypatch):
    freed = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    monkeypatch.setattr(common, "_resident", {"model": object()})
    common.release()
    common.release()
    assert freed == [1] and not common._resident
