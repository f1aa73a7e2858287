"""Toxicity (10): a subsequence string-kernel support vector machine with Nystroem landmarks.

Texts are cut into sentences, and these into phrases of PHRASE words; each phrase of a labelled document is a training
sentence with its document's label. Words are lower-cased, digits and marks that imitate letters are read as these, what
is no letter is dropped ("i.d-i0t" is "idiot"), and single letters in a row are one word. The kernel of two words sums,
over all subsequences of three letters, the product of their decayed occurrences, normalised; gaps and inserted letters
only decay an occurrence, up to a span of SPAN letters. The kernel of two phrases is the sum over their pairs of words.
Kernel values with landmark phrases, whitened, are the features (Nystroem), and as these are linear in subsequences, the
machine folds into one table of weights, looked up by a hash of three letters.

Most phrases of a toxic document are harmless. So the machine is fitted in ROUNDS: each keeps of the toxic documents'
phrases those that it places above nearly all clean ones (CUTS), adds variants of them with a letter inserted, and meets
the clean phrases that came closest. A text is judged by its WORST distinct phrases: a logistic curve over their
decision values, fitted on labelled documents that the machine hasn't seen, is the score; there a missed toxic document
weighs as much as TOXIC_WEIGHT false alarms.

Machine and curve are fitted on a bounded sample of labelled documents that aren't held out (LABELLED, PHRASES, TRAINED);
the same rows give the same model on any run. Every document is scored. Null or wordless texts score like harmless ones.
Without labels of both kinds all scores are 0. Rows of labels with the same doc_id count once, as toxic if one is.
Repeated documents are each scored; phrases that are equally bad are the same to the score. Columns of the input named
like results give way to them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import besides, release, resident, staged, table, text_batches, text_rows

#: Clean and toxic documents to learn from at most, by a hash of their ids.
LABELLED = (6000, 1500)
#: Of their distinct phrases, clean and toxic ones that are looked at, and that one round trains on, at most.
PHRASES, TRAINED = (80_000, 40_000), (8000, 4000)
#: One labelled document in so many fits the curve and is kept from the machine.
CURVE = 4
LANDMARKS = 700
#: Weight of the phrases of either kind against the machine's norm.
COST = 4_000.0
#: For each round the share of clean phrases that a toxic document's phrase must exceed to be kept.
CUTS = (0.98, 0.99, 0.99, 0.995, 0.995)
TOXIC_WEIGHT = 3.0
DECAY = 0.6
SPAN = 5
#: Letters of a word that count at once; longer words are cut into overlapping parts of this length.
LENGTH = 16
#: Words in a phrase.
PHRASE = 2
#: Cells of the table of weights. Three letters are looked up by a hash: all letters of all scripts differ.
CELLS = 1 << 20
#: Phrases that a text is judged by, and the value of a missing one; values are clipped to this and CEILING.
WORST, HARMLESS, CEILING = 3, -2.0, 3.0
#: Distinct words that a worker remembers before it starts afresh.
REMEMBERED = 400_000

#: Marks and digits that imitate letters.
LOOKS = str.maketrans("013457@$!", "oleastasi")
_marks = re.compile(r"[\W\d_]+")
_ENDS = frozenset(".!?。！？…")


def letters(token: str) -> str:
    bare = token.strip(".,;:!?\"'()[]|#*$%&<>")
    if bare.isalpha() or not any(c.isalpha() for c in bare):
        return bare if bare.isalpha() else ""
    return _marks.sub("", bare.translate(LOOKS))


def parts(word: str) -> list[str]:
    """A word with a sign for its beginning, or the overlapping parts of a long one, the last of which reach its end."""
    if len(word) < LENGTH:
        return ["^" + word]
    half = LENGTH // 2
    return ["^" * (i == 0) + word[i : i + LENGTH - 1] for i in range(0, len(word) - LENGTH + 1 + half, half)]


def phrases_of(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and where its phrases begin among them."""
    words: list[str] = []
    starts: list[int] = []
    single: list[str] = []
    begun = 0
    for line in text.lower().split("\n"):
        for token in [*line.split(), ""]:
            word = token if token.isalpha() else letters(token)
            if len(word) == 1:
                single.append(word)
                continue
            if single:
                if len(single) > 1:
                    words += parts("".join(single))
                single.clear()
            if word:
                words += parts(word)
            if len(words) > begun and (len(words) - begun >= PHRASE or not token or token[-1] in _ENDS):
                starts.append(begun)
                begun = len(words)
    return words, starts


def phrases(text: str) -> list[tuple[str, ...]]:
    words, starts = phrases_of(text)
    return [tuple(words[a:b]) for a, b in zip(starts, [*starts, len(words)][1:], strict=True)]


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its occurrences of three letters: cells of the weight table (0: none), and their normalised decays."""
    padded = "".join(w.ljust(LENGTH, "\0") for w in words)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, LENGTH).astype(np.uint64)
    cells, decays = [], []
    for j in range(1, SPAN - 1):
        for k in range(j + 1, SPAN):
            a, b, c = codes[:, : LENGTH - k], codes[:, j : LENGTH - k + j], codes[:, k:]
            mixed = (((a << np.uint64(42)) | (b << np.uint64(21)) | c) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
            cells.append(np.where(c > 0, (mixed % np.uint64(CELLS - 1)).astype(np.int64) + 1, 0))
            decays.append(np.full(LENGTH - k, DECAY ** (k + 1)))
    cells, decays = np.concatenate(cells, axis=1), np.concatenate(decays)
    return cells, np.where(cells > 0, decays, 0.0) / np.sqrt(own_kernel(cells, decays))[:, None]


def own_kernel(cells: np.ndarray, decays: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself: occurrences of the same three letters are summed before they are squared."""
    by = np.argsort(cells, axis=1, kind="stable")
    ordered = np.take_along_axis(cells, by, axis=1)
    weight = np.where(ordered > 0, decays[by], 0.0).ravel()
    keys = (ordered + np.arange(len(cells))[:, None] * CELLS).ravel()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
    return np.maximum(np.bincount(first // max(cells.shape[1], 1), sums**2, minlength=len(cells)), 1e-9)


def word_values(words: list[str], weights: np.ndarray, step: int = 4096) -> np.ndarray:
    out = [np.zeros(0)]
    for at in range(0, len(words), step):
        cells, decays = occurrences(words[at : at + step])
        out.append((weights[cells] * decays).sum(axis=1))
    return np.concatenate(out)


class Phrases:
    """Phrases as indexes of their distinct words."""

    def __init__(self, items: list[tuple[str, ...]], words: list[str] | None = None):
        self.words = words if words is not None else sorted({w for p in items for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        self.index = np.array([number[w] for p in items for w in p], np.int64)
        self.starts = np.cumsum([0, *(len(p) for p in items[:-1])]) if items else np.zeros(0, np.int64)

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_words[self.index], self.starts, axis=0) if len(self.starts) else of_words[:0]


def kernels(words: list[str], marks: Phrases) -> np.ndarray:
    """Kernel values of words with landmark phrases, whose words are among them."""
    cells, decays = occurrences(words)
    used, cells_of = np.unique(cells, return_inverse=True)
    cells_of, decays = cells_of.reshape(cells.shape), decays.astype(np.float32)
    out = np.empty((len(words), len(marks.starts)), np.float32)
    for j, own in enumerate(np.split(marks.index, marks.starts[1:])):
        dense = np.zeros(len(used), np.float32)
        np.add.at(dense, cells_of[own], decays[own])
        if used[0] == 0:
            dense[0] = 0
        out[:, j] = np.einsum("ij,ij->i", dense[cells_of], decays)
    return out


def machine(toxic: list[tuple[str, ...]], clean: list[tuple[str, ...]], marks: list[tuple[str, ...]]) -> dict:
    """The machine of toxic and clean phrases: landmarks and their weights, folded into a table, and a bias."""
    words = sorted({w for p in (*toxic, *clean, *marks) for w in p})
    landmarks = Phrases(marks, words)
    k = kernels(words, landmarks)
    inner = landmarks.sums(k).astype(float)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2 + 1e-6 * np.eye(len(marks)))
    white = vectors / np.sqrt(np.maximum(values, 1e-6))
    k = k @ white.astype(np.float32)
    x = np.hstack([Phrases([*toxic, *clean], words).sums(k), np.ones((len(toxic) + len(clean), 1), np.float32)])
    del k
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    w = squared_hinge(x, y, np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean)) * COST)
    alpha = white @ w[:-1]
    weights = np.zeros(CELLS)
    cells, decays = occurrences([words[i] for i in landmarks.index])
    shares = np.repeat(alpha, np.diff(np.append(landmarks.starts, len(landmarks.index))))
    np.add.at(weights, cells, decays * shares[:, None])
    weights[0] = 0
    return {"weights": weights.astype(np.float32), "bias": float(w[-1]), "marks": marks, "alpha": alpha}


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The weights of least norm and squared hinge loss, by Newton steps; the last column is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w) < 1)
        h, g = ridge.copy(), ridge @ w
        for at in range(0, len(active), 2048):
            rows = active[at : at + 2048]
            part, c = x[rows].astype(float), 2 * cost[rows]
            h += (part * c[:, None]).T @ part
            g -= part.T @ (c * (y[rows] - part @ w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def spread(items: list, n: int) -> list:
    return [items[i] for i in np.unique(np.linspace(0, len(items) - 1, min(n, len(items))).astype(int))]


def stretched(toxic: list[tuple[str, ...]], weights: np.ndarray) -> list[tuple[str, ...]]:
    """Phrases with a letter inserted in their most toxic word, so that the machine learns to tolerate it."""
    words = sorted({w for p in toxic for w in p})
    value = dict(zip(words, word_values(words, weights).tolist(), strict=True))
    out = []
    for n, p in enumerate(toxic):
        i = max(range(len(p)), key=lambda i: (value[p[i]], -i))
        w = p[i]
        if len(w) > 5:
            at = (3, len(w) // 2 + 1, len(w) - 1)[n % 3]
            out.append((*p[:i], (w[:at] + "xeo"[n % 3] + w[at:])[:LENGTH], *p[i + 1 :]))
    return out


def fitted(toxic: list[tuple[str, ...]], clean: list[tuple[str, ...]]) -> dict:
    """The machine, of phrases of toxic and of clean documents in random order."""
    most_clean, most_toxic = TRAINED
    half, known = LANDMARKS // 2, (Phrases(toxic), Phrases(clean))
    chosen, met = toxic[:most_toxic], clean[:most_clean]
    marks, more, model = [*spread(chosen, half), *spread(met, half)], [], {}
    for cut in CUTS:
        model = machine([*chosen, *more], met, list(dict.fromkeys(marks)))
        of_toxic, of_clean = (x.sums(word_values(x.words, model["weights"])) for x in known)
        by_toxic, by_clean = (np.argsort(-f, kind="stable") for f in (of_toxic, of_clean))
        least = np.quantile(of_clean, cut)
        chosen = spread([toxic[i] for i in by_toxic if of_toxic[i] > least], most_toxic) or chosen
        hard = [clean[i] for i in by_clean[: most_clean // 3]]
        met = list(dict.fromkeys([*clean[: most_clean * 2 // 3], *hard]))
        marks = [*spread(chosen, half), *hard[: half // 2], *spread(clean[:most_clean], half // 2)]
        more = stretched(chosen, model["weights"])
    return model


class Scorer:
    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["bias"]
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> list[float]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = [w for w in dict.fromkeys(words) if w not in self.known]
            self.known.update(zip(new, word_values(new, self.weights).tolist(), strict=True))
            found = list(map(self.known.__getitem__, words))
        return found

    def worst(self, text: str) -> list[float]:
        """The decision values of the text's worst phrases, clipped."""
        words, starts = phrases_of(text)
        out: dict[tuple[str, ...], float] = {}
        if words:
            decided = np.add.reduceat(np.array(self.values(words)), starts) + self.bias
            ends = [*starts[1:], len(words)]
            for i in np.argsort(-decided, kind="stable").tolist():
                out.setdefault(tuple(words[starts[i] : ends[i]]), float(decided[i]))
                if len(out) == WORST:
                    break
        return [min(max(x, HARMLESS), CEILING) for x in [*out.values(), *[HARMLESS] * (WORST - len(out))]]


def worst_phrases(text: Column, spark: SparkSession, model: dict) -> Column:
    """array<double>: the decision values of each text's worst phrases."""
    text_batches(spark)
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast({k: model[k] for k in ("weights", "bias")})  # one table of fixed size

    @F.arrow_udf("array<double>")
    def scored(texts: pa.Array) -> pa.Array:
        scorer = resident(key, lambda: Scorer(shared.value))
        return pa.array([scorer.worst(t or "") for t in text_rows(texts)], pa.list_(pa.float64()))

    return scored(text)


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, phrase: the distinct phrases of each document."""
    release()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), text_rows(batch.column(1)), strict=True):
            found = list(dict.fromkeys(" ".join(p) for p in phrases(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], names=["label", "phrase"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The machine with its curve, of docs(doc_id, text) and labels(doc_id, toxic); None without labels of both kinds."""
    spark = docs.sparkSession
    text_batches(spark)
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    few = [marks.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in enumerate(LABELLED)]
    # A broadcast of LABELLED rows at most, so that texts stay where they are
    known = docs.select("doc_id", "text").join(F.broadcast(few[0].union(few[1])), "doc_id")
    known = staged(known.withColumn("kept", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CURVE)) == 0), "labelled")
    counted = known.where("not kept").select("label", "text").mapInArrow(_phrase_rows, "label int, phrase string").groupBy("phrase").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    counted = staged(counted, "phrases")
    some = lambda rule, most: [tuple(r.phrase.split(" ")) for r in counted.where(rule).orderBy(F.xxhash64("phrase"), "phrase").limit(most).collect()]
    clean, toxic = some("clean > toxic", PHRASES[0]), some("toxic >= clean", PHRASES[1])
    if not clean or not toxic:
        return None
    model = fitted(toxic, clean)
    rows = known.where("kept").select("label", worst_phrases(F.col("text"), spark, model).alias("f")).collect()
    rows = rows if len({r.label for r in rows}) == 2 else known.select("label", worst_phrases(F.col("text"), spark, model).alias("f")).collect()
    return model | {"curve": curve(np.array([r.f for r in rows]), np.array([r.label for r in rows], float))}


def curve(f: np.ndarray, label: np.ndarray) -> list[float]:
    """Weights of the worst phrases and an offset: logistic regression, where toxic documents weigh TOXIC_WEIGHT each."""
    x = np.hstack([f, np.ones((len(f), 1))])
    weight, w = np.where(label > 0, TOXIC_WEIGHT, 1.0), np.zeros(x.shape[1])
    ridge = np.diag([0.1] * f.shape[1] + [1e-6])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weight * (p - label)) + ridge @ w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with score and predicted; columns of docs that have these names give way."""
    docs = besides(docs, "score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    *weights, offset = model["curve"]
    worst = worst_phrases(F.col("text"), docs.sparkSession, model)
    total = F.aggregate(F.zip_with(worst, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(float(offset)), lambda acc, x: acc + x)
    return docs.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
