"""PII (5): candidate spans from high-recall generators, judged by gradient-boosted trees with calibrated thresholds.

Base spans (emails, IP addresses, card and phone numbers in plain formats) always stay. Generators propose more, looser
spans that may overlap: written-out emails; of any run of digits with separators each part between separators, as each
kind it might be; and secrets (keys, tokens, passwords), a kind of the method's own. Features of a span's format and of
the text around it go through boosted trees, trained on the candidates of all documents, by sums that Spark makes. There are
no labelled spans, so formats label some: base spans, assigned keys, and reformatted variants of both are positive;
candidates that their own kind's check refutes (checked()), and variants with the checks broken, are negative; what no
check can settle isn't trained on. Per kind the threshold is the lowest at which candidates kept from training reach
PRECISION. Of overlapping spans the most probable is selected (of equal ones the first proposed), none that overlaps a
base span.

Null text is treated as empty: no spans. Offsets are code points, end exclusive, of the whole text. Repeated rows are
each searched; other columns pass through, and the query's results are selected by name. An empty table trains no trees
and adds no spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_batches, text_rows

#: The kinds of base spans, and the method's own one.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PRECISION = 0.99
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Quantiles that features are binned at.
PLACES = np.linspace(0, 1, BINS)[1:-1].tolist()
#: Gradients are summed as whole numbers of so many parts, and thresholds are told by so many levels of log-odds to one.
SCALE, LEVELS = 1 << 24, 256
#: Different binned examples, of some 40 bytes, up to which their counts are summed in the driver.
COLLECTED = 50_000
CONTEXT = 24

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starts within a run of digits are ruled out: they match only if the run's start does, and would be tried one by one.
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_written = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{2,63}){1,3}")
_at = re.compile(r" at |\(at\)|\[at\]", re.I)
_numbers = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9])+")
_group = re.compile(r"\+?\(?[0-9]+\)?")
_key = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_named = re.compile(r"\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access)[ _-]?key)\b[\"']?\s{0,3}(?:[:=]|is\b)\s{0,3}[\"']?([^\s\"']{6,64})(?![^\s\"'])", re.I)
_assigned = re.compile(r"(?:pass|pwd|secret|token|key|bearer)\w*[\"']?\s*[:=]\s*[\"']?$", re.I)
_cue = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|debit|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|ruf|tél", re.I),
    "secret": re.compile(r"pass|pwd|secret|token|key|bearer", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: what comes before it is one run of characters."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _card.finditer(text):
            if 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _phone.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy(span: str) -> float:
    """Bits per character."""
    n = np.array([span.count(c) for c in dict.fromkeys(span)], float)
    return float(-(n / len(span) * np.log2(n / len(span))).sum())


class Taken:
    """Disjoint ranges of a text in order, that tell whether another one touches them."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, b - 1)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_right(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans that overlap no base span, of each kind that they might be."""
    out: dict[tuple[str, int, int], None] = {}
    for at in _at.finditer(text):
        start = end = at.start() - (text[at.start() - 1 : at.start()] == " ")
        while start > 0 and end - start < 64 and text[start - 1] in _local:
            start -= 1
        whole = start == 0 or text[start - 1] not in _local  # a longer local part is no candidate, rather than cut
        if whole and start < end and (m := _written.match(text, at.end())):
            out["email", start, m.end()] = None
    if _digit.search(text):
        for m in _numbers.finditer(text):
            out.update(dict.fromkeys(parts_of_run(text, *m.span())))
        for m in _key.finditer(text):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                out["secret", m.start(), m.end()] = None
    for m in _named.finditer(text):
        out["secret", m.start(1), m.end(1)] = None
    known = Taken(taken)
    return [c for c in out if not known.holds(*c[1:])]


def parts_of_run(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Of a run of digits with separators all parts that begin and end with its groups of digits, as each kind they might be."""
    groups = [(m.start(), m.end(), len(only_digits(m[0]))) for m in _group.finditer(text, a, b)]
    out = []
    for i, (start, _, _) in enumerate(groups):
        n = 0
        for k in range(i, len(groups)):
            n += groups[k][2]
            if n > 19:
                break
            end = groups[k][1]
            out += [("ip", start, end)] * (k - i == 3 and n <= 12 and text.count(".", start, end) == 3)
            out += [("card", start, end)] * (n >= 13) + [("phone", start, end)] * (9 <= n <= 15)
    return out


def checked(kind: str, left: str, span: str, right: str) -> bool | None:
    """What a candidate's own format says: True or False, or None where it settles nothing."""
    digits, touched = only_digits(span), left[-1:].isalnum() or right[:1].isalnum()
    if kind == "secret":
        plain = len(set(span)) < 6 or entropy(span) < 2.5 or (span.isalpha() and not _assigned.search(left))
        return False if plain or touched else True if len(span) >= 20 and _assigned.search(left) and digits else None
    if kind == "email":
        return None if re.search(r"[A-Za-z]{2,}$", span) else False
    if touched:
        return False
    if kind == "ip":
        return all(_octet(p) for p in span.split(".")) and None
    if kind == "card":
        return None if luhn(digits) else False
    return False if re.search(r"^(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ]", span) or len(set(digits)) < 3 else None


def features(kind: str, left: str, span: str, right: str) -> list[float]:
    """Format of the span, and context: what touches it, cues, and how the text around it looks."""
    digits, groups = only_digits(span), re.findall(r"[0-9]+", span)
    octets = [int(g) for g in groups if len(g) < 4]
    near = left[-8:] + right[:8]
    return [
        float(ALL_KINDS.index(kind)), entropy(span), float(sum(c.isalpha() for c in span)), float(bool(_assigned.search(left))), float(len(digits)), float(len(span)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(span.startswith("+")), float("(" in span), float(span.count(" ")), float(span.count(".")), float(span.count("-")), float(span.count("/")),
        float(bool(digits) and luhn(digits)), float(max(octets, default=999) if len(octets) == len(groups) else 999), float(len(set(digits))), float("@" in span or bool(re.search(r"\bat\b", span, re.I))), float(bool(re.search(r"\bdot\b", span, re.I))), float(bool(re.search(r"(?:com|org|net|edu|[a-z]{2})$", span, re.I))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left[-1:] in "\"'=/#_."), float(right[:1] in "\"'=/#_%"), float(bool(_cue[kind].search(left))), sum(c.isdigit() for c in near) / 16, sum(c.isalpha() for c in near) / 16, float("=" in left[-6:]), float(bool(groups) and groups[0][0] == "0"),
    ]


def variants(kind: str, left: str, span: str, right: str) -> list[tuple[tuple[str, str, str, str], int]]:
    """Labelled relatives of a base span: other formats (1), and broken ones (0)."""
    digits = only_digits(span)
    if kind == "email":
        name, host = span.split("@", 1)
        return [((kind, left, f"{name} at {host.replace('.', ' dot ')}", right), 1), ((kind, left, f"{name}(at){host}", right), 1), ((kind, left, f"{host.split('.')[0]} at {name.split('.')[0]}.", right), 0)]
    if kind == "ip":
        return [((kind, left, span, right), 1), ((kind, left[:-1] + "v", span, right), 0), ((kind, left, ".".join(str(int(p) + 256) for p in span.split(".")), right), 0)]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        return [((kind, left, f"{digits[:4]}.{digits[4:8]}.{digits[8:12]}.{digits[12:]}", right), 1), ((kind, left, wrong, right), 0), ((kind, left[:-1] + "a", digits, "f" + right[1:]), 0)]
    if kind == "secret":
        turned = span[::-1]
        return [((kind, 'api_key: "', turned, '"' + right[1:]), 1), ((kind, "password=", turned[:20], " " + right[1:]), 1), ((kind, left[:-1] + "a", span, "z" + right[1:]), 0), ((kind, "see ", "a-" * 12 + "1", " " + right[1:]), 0), ((kind, "the ", re.sub("[0-9]", "a", span[:18]), " of"), 0)]
    local = digits[-10:]
    return [
        ((kind, left, f"({local[:3]}) {local[3:6]}-{local[6:]}", right), 1), ((kind, left, f"{local[:3]}-{local[3:6]}-{local[6:]}", right), 1), ((kind, left, f"00{digits}", right), int(len(digits) > 9)),
        ((kind, left, local, right), 0), ((kind, left[:-1] + "e", digits, "b" + right[1:]), 0), ((kind, left, f"20{local[:2]}-0{local[3]}-1{local[4]} 1{local[5]}", right), 0), ((kind, left, f"{local[:6]}.{local[6:]}", right), 0),
    ]


def boost(edges: list[np.ndarray], start: float, histograms: Callable) -> dict:
    """Boosted trees for log-odds: second-order gains over binned features, grown level by level from sums over all examples.

    histograms(trees, tree) sums gradients, curvatures and numbers of examples by leaf of the growing tree, feature and
    bin. They are whole numbers (SCALE), so trees don't depend on how examples are dealt.
    """
    trees: list = []
    for _ in range(TREES):
        tree: tuple | float | int = 0
        for depth in range(DEPTH + 1):
            if not _open(tree):
                break
            tree = _split(tree, histograms(trees, tree), edges, depth == DEPTH)
        trees.append(tree)
    return {"start": start, "trees": [_by_value(t, edges) for t in trees]}


def _open(tree) -> list[int]:
    """Leaves of a growing tree, which are whole numbers until their values are settled."""
    return [tree] if isinstance(tree, int) else [] if isinstance(tree, float) else [*_open(tree[2]), *_open(tree[3])]


def _split(tree, sums: np.ndarray, edges: list, last: bool):
    """The tree with each open leaf split where that gains most, or closed."""
    fresh = iter(range(2 ** (DEPTH + 1)))

    def grown(node):
        if isinstance(node, float):
            return node
        if isinstance(node, tuple):
            return (*node[:2], grown(node[2]), grown(node[3]))
        own = sums[node]
        total_g, total_h, n = own[0].sum(axis=0)
        if last or n < 8:
            return float(-RATE * total_g / (total_h + 1))
        best, where = 1e-3, None
        for j, e in enumerate(edges):
            gl, hl, _ = np.cumsum(own[j], axis=0)[: len(e)].T
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            if len(gain) and gain.max() > best:
                best, where = gain.max(), (j, int(gain.argmax()))
        return float(-RATE * total_g / (total_h + 1)) if where is None else (*where, next(fresh), next(fresh))

    return grown(tree)


def _by_value(tree, edges: list):
    return tree if isinstance(tree, float) else (tree[0], float(edges[tree[0]][tree[1]]), _by_value(tree[2], edges), _by_value(tree[3], edges))


def _tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _tree(low, x), _tree(high, x))


def _margin(start: float, trees: list, x: np.ndarray) -> np.ndarray:
    return start + sum((_tree(t, x) for t in trees), np.zeros(len(x)))


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-_margin(model["start"], model["trees"], x)))


def histogram(start: float, trees: list, tree, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of binned examples x with labels y, each n times: sums by leaf, feature, bin, and of what (gradient, curvature, number), as whole numbers."""
    p = 1 / (1 + np.exp(-_margin(start, trees, x)))
    leaf, nodes = _tree(_leaves(tree), x), len(_open(tree))
    parts = [np.round(SCALE * v) * n for v in (p - y, np.maximum(p * (1 - p), 1e-6))] + [n * float(SCALE)]
    held = leaf >= 0
    cells = leaf[held] * BINS
    out = np.zeros((nodes, x.shape[1], BINS, 3))
    for j in range(x.shape[1]):
        for k, v in enumerate(parts):
            out[:, j, :, k] = np.bincount(cells + x[held, j], v[held], minlength=nodes * BINS).reshape(nodes, BINS)
    return out


def _leaves(tree):
    """The growing tree with -1 for leaves whose value is settled."""
    return -1 if isinstance(tree, float) else tree if isinstance(tree, int) else (*tree[:2], _leaves(tree[2]), _leaves(tree[3]))


def binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def examples(kind: str, left: str, span: str, right: str, base: bool) -> list[tuple[list[float], int, bool]]:
    """What a candidate teaches: features, label and side. Variants are on their source's side: either fitted on, or calibrated by (True)."""
    c, out = (kind, left, span, right), []
    sure = True if base else checked(*c)
    if sure is not None and not (base and kind == "email"):
        out.append((c, int(sure)))
    if sure:
        out += variants(*c)
    side = int(hashlib.md5("\0".join(c).encode()).hexdigest(), 16) % 4 == 0 if out else False
    return [(features(*v), y, side) for v, y in out]


def _start(mean: float) -> float:
    return float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))


def train(rows: list[tuple[str, str, str, str, bool]]) -> dict | None:
    """Trees and thresholds of candidates (kind, left, span, right, base) in memory; learn() does the same over a table."""
    data = [e for r in rows for e in examples(*r)]
    x, y, check = np.array([v for v, _, _ in data]), np.array([v for _, v, _ in data], float), np.array([v for _, _, v in data], bool)
    if len(set(y[~check])) < 2 or not check.any():
        return None
    edges = [np.unique(np.quantile(v, PLACES, method="inverted_cdf")) for v in x[~check].T]
    fit, start = (binned(edges, x[~check]), y[~check], np.ones((~check).sum())), _start(y[~check].mean())
    model = boost(edges, start, lambda trees, tree: histogram(start, trees, tree, *fit) / SCALE)
    level, kind = _level(_margin(start, model["trees"], x[check])), x[check][:, 0]
    return model | {"least": [_threshold(*_by_level(level[kind == k], y[check][kind == k])) for k in range(len(ALL_KINDS))]}


def _level(margin: np.ndarray) -> np.ndarray:
    return np.round(margin * LEVELS).astype(int)


def _by_level(level: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, of = np.unique(level, return_inverse=True)
    return at, np.bincount(of, y, minlength=len(at)), np.bincount(of, minlength=len(at))


def _threshold(level: np.ndarray, right: np.ndarray, n: np.ndarray) -> float:
    """Of ascending levels the probability halfway from the lowest one down to which enough are right to the next one; over 1 if there is none."""
    good = np.flatnonzero(np.cumsum(right[::-1]) / np.cumsum(n[::-1]) >= PRECISION) if len(level) else []
    if not len(good):
        return 1.1
    p = np.append(0.0, 1 / (1 + np.exp(-level / LEVELS)))
    k = len(level) - good[-1]
    return float(p[k] + p[k - 1]) / 2


def around(text: str, a: int, b: int) -> tuple[str, str, str]:
    return text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]


def find(texts: list[str], model: dict | None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Of each text its base spans and all spans, each by start, then kind as listed."""
    base = [base_spans(t) for t in texts]
    loose = [(i, *c) for i, t in enumerate(texts) for c in candidates(t, base[i])] if model else []
    found = [list(b) for b in base]
    if loose:
        taken = [Taken(b) for b in base]
        p = probability(model, np.array([features(k, *around(texts[i], a, b)) for i, k, a, b in loose]))
        for n in np.argsort(-p, kind="stable"):
            i, kind, a, b = loose[n]
            if p[n] >= model["least"][ALL_KINDS.index(kind)] and not taken[i].holds(a, b):
                found[i].append((kind, a, b))
                taken[i].add(a, b)
    return [(b, sorted(f, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))) for b, f in zip(base, found, strict=True)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "array<struct<kind:string,start:int,end:int>>"


def _rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def spans(text: Column, spark: SparkSession, model: dict | None) -> Column:
    """struct<base, found>: base spans and all spans of each text."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # trees of a fixed number and depth

    @F.arrow_udf(f"struct<base:{_SPANS_SQL},found:{_SPANS_SQL}>")
    def searched(texts: pa.Array) -> pa.Array:
        both = [x for at in range(0, len(texts), 512) for x in find([t or "" for t in texts.slice(at, 512).to_pylist()], shared.value)]
        return pa.StructArray.from_arrays([pa.array([_rows(x[i]) for x in both], _SPANS) for i in (0, 1)], names=["base", "found"])

    return searched(text)


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of all candidates in whole texts."""
    for batch in batches:
        out = []
        for text in text_rows(batch.column(0)):
            base = base_spans(text or "")
            for own, is_base in ((base, True), (candidates(text or "", base), False)):
                out += [e for k, a, b in own for e in examples(k, *around(text, a, b), is_base)]
        x, y, check = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(check, pa.bool_())], names=["x", "y", "check"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """Binned examples of a task in blocks of about so many: bins, labels, numbers, and the rows."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        rows = pa.Table.from_batches(held)
        x = np.frombuffer(b"".join(rows["bins"].to_pylist()), np.uint8).reshape(len(rows), -1).astype(int)
        return x, rows["y"].to_numpy(), rows["n"].to_numpy(), rows

    for batch in batches:
        held += [batch] * (batch.num_rows > 0)
        if sum(b.num_rows for b in held) >= size:
            yield block()
            held.clear()
    if held:
        yield block()


def learn(docs: DataFrame, collected: int = COLLECTED) -> dict | None:
    """The trees, from the candidates of all whole texts of docs(text).

    Examples are binned by quantiles over all of them and counted by their bins. Up to so many different ones the driver
    gets their counts, and grows the trees from these. Of more each level of a tree is one aggregate over the counts, of
    which it gets a row for each leaf, feature and bin. Both give the same. Thresholds come from counts by kind and level
    of log-odds.
    """
    text_batches(docs.sparkSession)
    all_examples = staged(docs.select("text").mapInArrow(_taught, "x array<double>, y int, check boolean"), "examples")
    fitted = all_examples.where("not check")
    sides = {r["check"]: r for r in all_examples.groupBy("check").agg(F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.max(F.size("x")).alias("n")).collect()}
    if len(sides) < 2 or sides[False].low == sides[False].high:
        return None
    width, start = sides[False].n, _start(sides[False]["mean"])
    edges = [np.unique(e) for e in fitted.agg(*(F.percentile_approx(F.get("x", F.lit(j)), PLACES, 10_000).alias(f"e{j}") for j in range(width))).first()]

    def as_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, width)
            bins = [row.tobytes() for row in binned(edges, x).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), pa.array(x[:, 0].astype(np.int32)), batch.column(1), batch.column(2)], names=["bins", "kind", "y", "check"])

    counted = all_examples.mapInArrow(as_bins, "bins binary, kind int, y int, check boolean").groupBy("bins", "kind", "y", "check").agg(F.count("*").alias("n"))
    counted = staged(counted, "binned-examples")
    fit, calibrating = counted.where("not check").select("bins", "y", "n"), counted.where("check").select("bins", "kind", "y", "n")

    def histograms(trees: list, tree) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts := [histogram(start, trees, tree, *block[:3]) for block in _blocks(batches)]:
                sums = sum(parts).reshape(-1, 3)
                cells = np.flatnonzero(sums[:, 2])
                yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(v.astype(np.int64)) for v in sums[cells].T)], names=["cell", "g", "h", "n"])

        out = np.zeros((len(_open(tree)) * width * BINS, 3))
        for cell, *v in fit.mapInArrow(summed, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
            out[cell] = v
        return out.reshape(-1, width, BINS, 3) / SCALE

    if fit.count() <= collected:
        held = next((block[:3] for block in _blocks(iter(fit.toArrow().combine_chunks().to_batches()), collected + 1)))
        histograms = lambda trees, tree: histogram(start, trees, tree, *held) / SCALE
    model = boost(edges, start, histograms)
    in_bins = [_by_bin(t, edges) for t in model["trees"]]

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, n, rows in _blocks(batches):
            yield pa.RecordBatch.from_arrays([rows["kind"].combine_chunks(), pa.array(_level(_margin(start, in_bins, x))), pa.array(y * n), pa.array(n)], names=["kind", "level", "good", "n"])

    by_level = calibrating.mapInArrow(levels, "kind int, level long, good long, n long").groupBy("kind", "level").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).orderBy("kind", "level").collect()
    of = lambda k: np.array([r[1:] for r in by_level if r.kind == k], float).reshape(-1, 3).T
    return model | {"least": [_threshold(*of(k)) for k in range(len(ALL_KINDS))]}


def _by_bin(tree, edges: list):
    return tree if isinstance(tree, float) else (tree[0], int(np.searchsorted(edges[tree[0]], tree[1])), _by_bin(tree[2], edges), _by_bin(tree[3], edges))


def redacted(text: Column, found: Column) -> Column:
    """The text with each of its spans (array of struct<kind, start, end>, by start) replaced by its kind in brackets."""
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    return F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", spans(F.col("text"), spark, learn(docs)).alias("s"))
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("s.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in KINDS]
    n_secret = F.size(F.filter("s.found", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    n_added = (F.size("s.found") - F.size("s.base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined("s.base"), 256).alias("base_sha256"), joined("s.found").alias("spans"), n_secret, n_added, (F.size("s.found") > 0).alias("personal"))
