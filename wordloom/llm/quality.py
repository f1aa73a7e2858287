"""Quality rules (8): rule failures by host, shrunk by an empirical beta prior, and joined back to the documents.

Words are runs without ASCII white space, lines are those with a word. A document fails the base rules if it has under 50
words or if over half of its words stand in three-word windows that the text has twice or more. Beyond that its host (the
source column) has a say. For each rule the share of the host's documents that fail is shrunk towards the mean of all
hosts by a beta prior fitted to the hosts' own rates (method of moments, less what sampling adds to their variance), and
the host is, by that rule,

- bad if it fails more often than not, surely: two posterior standard deviations over HOST_LIMIT. All its documents go.
- trusted if its rate is under TRUST of the mean of all hosts. Its odd documents are taken as odd, not as junk.
- else strict, usual or lenient: APART standard deviations of all hosts' shrunk rates above their mean, between, or below.

What is borderline in a document is so decided by its host: a soft rule drops it beyond the limit for such hosts (SOFT, in
percent), which is lower where failures are frequent. All that hosts are measured by are sums over them.

Null texts have no words and fail. Null is a host of its own; without the host's column all documents have that. Repeated
rows each count, and rows with equal rates are treated alike. Other columns stay; those named like results give way. An
empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, besides, byte_rows, staged, struct, table, text_batches

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Failures a host is judged by, as SQL over the metrics.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}
#: Soft rules: a measure, what it is a part of, and the percentage of it that is allowed in strict, usual and lenient hosts.
SOFT = {"symbols": ("n_symbols", "n_words", (5, 10, 40)), "dup_lines": ("n_dup_lines", "n_lines", (40, 50, 60))}
HOST_LIMIT = 0.5
TRUST = 0.5
APART = 0.67
_TINY = 1e-9  # between rates that are equal but for rounding
#: Bounds of the prior's weight in documents.
PRIOR = (2.0, 1000.0)

_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if (first := seen.setdefault(w, i)) != i:
            hit[i : i + 3] = hit[first : first + 3] = b"\1\1\1"
    return sum(hit)


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode(errors="replace"))
    return len(words), chars, sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def metrics(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines> of a text."""

    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = [measures(t or b"") for t in byte_rows(texts)]
        return struct(**{name: ([r[i] for r in rows], pa.int64()) for i, name in enumerate(_METRICS)})

    return measured(text)


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: n, each rule's shrunk rate, bad, and the limit of each soft rule, null where the host is trusted. measured has the metrics and the host column."""
    fails = measured.groupBy(host).agg(F.count("*").alias("n"), *(F.sum(F.expr(f"cast({rule} as int)")).alias(name) for name, rule in RULES.items()))
    rate = {name: F.col(name) / F.col("n") for name in RULES}
    moments = fails.agg(F.avg(1 / F.col("n")).alias("share"), *(f(rate[name]).alias(f"{name}_{k}") for name in RULES for k, f in (("m", F.avg), ("v", F.var_pop)))).first()
    bad = []
    for name in RULES:
        m = moments[f"{name}_m"] or 0.0
        v = (moments[f"{name}_v"] or 0.0) - m * (1 - m) * (moments["share"] or 0.0)
        weight = min(max(m * (1 - m) / v - 1, PRIOR[0]), PRIOR[1]) if v > 0 else PRIOR[1]
        shrunk = (F.col(name) + m * weight) / (F.col("n") + weight)
        fails = fails.withColumn(f"{name}_rate", shrunk).withColumn(f"{name}_trusted", shrunk < TRUST * m)
        bad.append(shrunk - 2 * F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + weight + 1)))
    fails = staged(fails.withColumn("bad", F.greatest(*bad) > HOST_LIMIT), "hosts")
    spread = fails.agg(*(f(f"{name}_rate").alias(f"{name}_{k}") for name in SOFT for k, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    for name, (_, _, (strict, usual, lenient)) in SOFT.items():
        rate, m, apart = F.col(f"{name}_rate"), spread[f"{name}_m"] or 0.0, APART * (spread[f"{name}_d"] or 0.0) + _TINY
        limit = F.when(F.col(f"{name}_trusted"), None).when(rate > m + apart, strict).when(rate < m - apart, lenient).otherwise(usual)
        fails = fails.withColumn(f"{name}_limit", limit.cast("int"))
    return fails


def judged(docs: DataFrame, host: str = "source", with_text: bool = True) -> DataFrame:
    """docs with the metrics, base_failed and kept; without their texts unless these are asked for."""
    text_batches(docs.sparkSession)
    docs = besides(docs, *_METRICS, "base_failed", "kept")
    own = [F.col(f"`{c}`") for c in docs.columns if with_text or c.lower() != "text"]
    known = host.lower() in {c.lower() for c in docs.columns}
    rows = docs.select(*own, (F.col(f"`{host}`") if known else F.lit(None).cast("string")).alias(f"{OWN}host"), metrics(F.col("text")).alias(f"{OWN}m"))
    rows = rows.select("*", f"{OWN}m.*").drop(f"{OWN}m")
    rows = staged(rows.withColumn("base_failed", F.expr(f"({RULES['short']}) or ({RULES['repeats']})")), "quality")
    hosts = host_verdicts(rows, f"{OWN}host")
    hosts = hosts.select(F.col(f"{OWN}host").alias(f"{OWN}of"), F.col("bad").alias(f"{OWN}bad"), *(F.col(f"{name}_limit").alias(f"{OWN}{name}") for name in SOFT))
    fails = F.lit(False)
    for name, (part, whole, _) in SOFT.items():
        fails = fails | F.coalesce(100 * F.col(part) > F.col(f"{OWN}{name}") * F.col(whole), F.lit(False))
    out = rows.join(hosts, F.col(f"{OWN}host").eqNullSafe(F.col(f"{OWN}of")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col(f"{OWN}bad") & ~fails).select(*rows.drop(f"{OWN}host").columns, "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), with_text=False).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM grams JOIN (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
r AS (
  SELECT source, rule, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule,
      unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 2 * n_dup_lines > n_lines]) AS failed
    FROM m) GROUP BY ALL),
p AS (SELECT rule, avg(k / n) AS mu, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS v FROM r GROUP BY rule),
w AS (SELECT rule, mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 2), 1000) ELSE 1000 END AS weight FROM p),
s AS (SELECT source, rule, mu, n + weight AS many, (k + mu * weight) / (n + weight) AS rate FROM r JOIN w USING (rule)),
z AS (SELECT rule, avg(rate) AS m, 0.67 * stddev_pop(rate) + 1e-9 AS apart FROM s GROUP BY rule),
c AS (SELECT *, CASE WHEN rate < 0.5 * mu THEN NULL WHEN rate > m + apart THEN 1 WHEN rate < m - apart THEN 3 ELSE 2 END AS class FROM s JOIN z USING (rule)),
h AS (
  SELECT source, max(rate - 2 * sqrt(rate * (1 - rate) / (many + 1))) > 0.5 AS bad,
    [5, 10, 40][max(class) FILTER (rule = 'symbols')] AS symbols, [40, 50, 60][max(class) FILTER (rule = 'dup_lines')] AS dups
  FROM c GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT bad
    AND NOT coalesce(100 * n_symbols > symbols * n_words, false) AND NOT coalesce(100 * n_dup_lines > dups * n_lines, false) AS kept
FROM m LEFT JOIN h ON m.source IS NOT DISTINCT FROM h.source
"""
