"""Line dedup (6), in DataFrame operations only: overlapping windows of three lines, later occurrences removed.

Lines come in two kinds. Those that a text has are met three at a time, as they follow each other. And as a passage may
begin anywhere in a line, lines of LINE words are also laid out from places that the content chooses: of each SPREAD
words in a row the one with the least rank (the first of such) begins three of them. So any passage of
3 * LINE + SPREAD - 1 = 51 words or more holds three whole lines that begin alike wherever it stands, line ends or not;
at most SPREAD - 1 words at either end of a passage may stay.

Lines are hashed without the white space around them, three consecutive ones make a window of two 64-bit hashes, and
windows are met across all documents. The first occurrence, by doc_id (null last), then text hash, then place, stays; the
words that any later occurrence covers are removed together. Windows are computed once and staged; the firsts of
repeated windows are hash-aggregated with partial minima and staged too, so that the join with all windows has its own exchange, which
adaptive execution splits where one window is very frequent. Bit tables of a fixed size keep windows that aren't repeated,
and texts that nothing is removed from, out of the shuffles.

A text without a later occurrence stays as it is; from others the white space at the end goes too. Texts with neither
three lines nor 3 * LINE words have no window. Rows with the same doc_id and the same text are one document: each gets
its result. doc_id may be of any type that can be ordered. A null text stays null, with nothing removed. An empty table
gives an empty result. Extra columns pass through; a column named like a result gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, besides, staged, table

LINES = 3
#: Words in a line that begins by content, and words of which one at least begins a window.
LINE, SPREAD = 10, 22
WINDOW = LINES * LINE
#: A window by words is told by a hash of its first words and one of the others: false meetings need a true half.
HALF = (WINDOW + 1) // 2
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
#: Java's possessive quantifiers keep long words from backtracking.
_ONE = rf"{_SPACE}*+{_WORD}++"
_RARE = "\t\x0b\x0c\r"
_BLANKS = f" \n{_RARE}"
#: Added to the places of windows that begin by content, which are words; other windows' places are lines.
_BY_WORD = 1 << 30
_LOW = (1 << 31) - 1
#: What a document's order keeps of its hash.
_KEY_RANGE = 1 << 24
#: Size of the bit tables that keep rows without partners out of shuffles: 2^25 bits are half a million rows of 64.
BITS = 25


def rank(word: Column, place: Column) -> Column:
    """A number that is less for longer words, among those of like length by where they have an e, then by place, which its last 31 bits are."""
    number = lambda c: c.cast("bigint")
    return F.shiftleft(number(F.instr(word, "e")), 31).bitwiseOR(number(place)) - F.shiftleft(number(F.octet_length(word)), 37)


def _words(text: Column) -> Column:
    """The words of a text: white space made one kind, then cut at it. One search tells whether there are kinds that texts rarely have."""
    spaced = text
    for blank in _RARE:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    spaced = F.when(text.rlike(f"[{_RARE}]"), spaced).otherwise(text)
    return F.array_remove(F.split(F.replace(spaced, F.lit("\n"), F.lit(" ")), " "), "")


def _each(docs: DataFrame, array: str, at: str) -> DataFrame:
    """A row for each value of an array, with its place.

    An array without values leaves a row whose place is null, which conditions on places drop: for the inner form Spark infers
    a filter on the array, and evaluates what the array is made from once more for it.
    """
    return docs.select("*", F.posexplode_outer(array).alias(at, f"{OWN}value")).drop(f"{OWN}value")


def _run(array: str, start: Column, length: int) -> Column:
    return F.slice(array, start + 1, length)


def _by_content(docs: DataFrame, own: list[str]) -> DataFrame:
    """The windows that begin by content, with the columns named own.

    A word's rank and its place share a long, so that the least of SPREAD words tells its place. Only ranks are made by a
    lambda, which is interpreted for each word; the rest is generated code on a row for each SPREAD words in a row. That row
    counts where its least isn't that of the row before: where the word left behind or the one added is less than all that both
    have. At a text's end rows have fewer words, and too few follow for a window.
    """
    words, ranks, at, start = f"{OWN}words", f"{OWN}ranks", f"{OWN}at", f"{OWN}start"
    cut = docs.select(*own, _words(F.col("text")).alias(words))
    cut = cut.withColumn(ranks, F.transform(words, rank))
    shared = F.array_min(_run(ranks, F.col(at), SPREAD - 1))
    before, added = F.get(ranks, F.col(at) - 1), F.get(ranks, F.col(at) + (SPREAD - 1))
    found = _each(cut, ranks, at).where((F.col(at) == 0) | (F.least(before, added) < shared))
    found = found.select(*own, words, F.least(shared, added).bitwiseAND(F.lit(_LOW)).cast("int").alias(start)).where(F.col(start) + WINDOW <= F.size(words))
    halves = [_run(words, F.col(start), HALF), _run(words, F.col(start) + HALF, WINDOW - HALF)]
    return found.select(*own, (F.col(start) + _BY_WORD).alias(f"{OWN}pos"), *(F.xxhash64(h).alias(f"{OWN}h{k}") for k, h in enumerate(halves, 1)))


def _by_line(docs: DataFrame, own: list[str]) -> DataFrame:
    """The windows of a text's own lines, with the columns named own; the second hash has another seed."""
    lines, at = f"{OWN}lines", f"{OWN}pos"
    own_lines = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x: F.trim(x, F.lit(_BLANKS))), lambda x: x != "")
    found = _each(docs.select(*own, F.transform(own_lines, lambda x: F.xxhash64(x)).alias(lines)), lines, at).where(F.col(at) + LINES <= F.size(lines))
    window = _run(lines, F.col(at), LINES)
    return found.select(*own, at, F.xxhash64(window).alias(f"{OWN}h1"), F.xxhash64(F.lit("second"), window).alias(f"{OWN}h2"))


def windows_of(docs: DataFrame) -> DataFrame:
    """A row for each window of both kinds: docs' columns but the text, the window's place and two hashes, of parts of it or by different seeds."""
    own = [c for c in docs.columns if c != "text"]
    return _by_content(docs, own).union(_by_line(docs, own))


def _keyed(docs: DataFrame) -> DataFrame:
    """With a hash that, beside doc_id, tells documents apart, and a document's order: by doc_id (null last), then hash.

    For whole numbers that is one number; for other ids it is a struct. It keeps _KEY_RANGE values of the hash, which order
    the texts of one doc_id.
    """
    keyed = docs.withColumn(f"{OWN}key", F.xxhash64("doc_id", "text"))
    return keyed.withColumn(f"{OWN}order", _order(keyed, F.lit(0), 0))


def _order(keyed: DataFrame, place: Column, bits: int) -> Column:
    """What orders documents, then places in their texts, which have so many bits.

    For whole numbers it is one number, of which hash aggregates can keep the least. It is made from doc_id and hash where it
    is needed: wide numbers cost more to stage and to read than to make.
    """
    key = F.col(f"{OWN}key")
    if dict(keyed.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        number = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
        low = F.shiftleft(key.bitwiseAND(F.lit(_KEY_RANGE - 1)), bits) + place
        return (number * F.lit(_KEY_RANGE << bits).cast("decimal(17,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.struct(F.col("doc_id").isNull(), "doc_id", key, place)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """For each document with later occurrences its order and key, and where these begin; places of windows by content have _BY_WORD added."""
    own, same, first = ["doc_id", f"{OWN}key"], [f"{OWN}h1", f"{OWN}h2"], f"{OWN}first"
    windows = staged(windows_of(_keyed(docs.select("doc_id", "text")).drop(f"{OWN}order")), "windows")
    place = _order(windows, F.col(f"{OWN}pos"), 31)
    firsts = windows.groupBy(*same).agg(F.count("*").alias(f"{OWN}n"), F.min(place).alias(first)).where(f"{OWN}n > 1").drop(f"{OWN}n")
    firsts = staged(firsts, "firsts")
    repeated = _perhaps(windows, f"{OWN}h1", firsts).where(f"{OWN}perhaps").drop(f"{OWN}perhaps")
    later = repeated.join(firsts, same).where(place > F.col(first))
    starts = later.groupBy(*own).agg(F.collect_set(f"{OWN}pos").alias(f"{OWN}starts"))
    return staged(starts.select(_order(starts, F.lit(0), 0).alias(f"{OWN}order"), f"{OWN}key", f"{OWN}starts"), "starts")


def _perhaps(df: DataFrame, column: str, of: DataFrame) -> DataFrame:
    """df with perhaps: false only where the hash in a column is none of those in the same column of another table.

    They are told by a table of 2^BITS bits, which is broadcast, so that rows without a partner stay out of a shuffle. The
    fuller it is the fewer it keeps out, but joins come after it in any case.
    """
    slot, bits, low = f"{OWN}slot", f"{OWN}bits", F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    place = F.shiftright(low, 6).alias(slot)
    bit = low.bitwiseAND(F.lit(63)).cast("int")
    marks = of.select(place, bit.alias("b")).groupBy(slot).agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias(bits))
    joined = df.withColumn(slot, place).join(F.broadcast(marks), slot, "left")  # 2^BITS / 64 rows at most
    return joined.withColumn(f"{OWN}perhaps", F.coalesce(F.getbit(bits, bit) == 1, F.lit(False))).drop(slot, bits)


def _with_kept(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that nothing is removed from, as they are; and others with their words, each with the white space before it, and the places of those kept, both null if these are whole too."""
    words, first = f"{OWN}words", f"{OWN}line_starts"
    starts = repeated_starts(docs)
    keyed = _perhaps(_keyed(docs), f"{OWN}key", starts)
    rest = keyed.where(~F.col(f"{OWN}perhaps")).select(*_own(docs))
    found = keyed.where(f"{OWN}perhaps").join(starts, [f"{OWN}order", f"{OWN}key"], "left")
    found = found.withColumn(words, F.when(F.col(f"{OWN}starts").isNotNull(), F.regexp_extract_all(F.col("text"), F.lit(_ONE), F.lit(0))))
    every = F.sequence(F.lit(0), F.size(words) - 1)
    found = found.withColumn(first, F.when(F.array_min(f"{OWN}starts") < _BY_WORD, F.filter(every, lambda i: (i == 0) | F.get(words, i).contains("\n"))))
    by_word = lambda s: F.sequence(s - _BY_WORD, s - _BY_WORD + (WINDOW - 1))
    by_line = lambda s: F.sequence(F.get(first, s), F.coalesce(F.get(first, s + LINES), F.size(words)) - 1)
    covered = F.array_distinct(F.flatten(F.transform(f"{OWN}starts", lambda s: F.when(s >= _BY_WORD, by_word(s)).otherwise(by_line(s)))))
    return rest, found.withColumn(f"{OWN}kept", F.array_except(every, covered))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _cleaned() -> Column:
    return F.array_join(F.transform(f"{OWN}kept", lambda i: F.get(f"{OWN}words", i)), "")


def dedup_lines(docs: DataFrame, into: str = "n_removed") -> DataFrame:
    """docs with text cleaned and, as another column, the number of words removed; a column of docs that has its name gives way."""
    docs = besides(docs, into)
    rest, found = _with_kept(docs)
    whole = F.col(f"{OWN}starts").isNull()
    removed = F.when(whole, 0).otherwise(F.size(f"{OWN}words") - F.size(f"{OWN}kept")).cast("long")
    found = found.withColumn(into, removed).withColumn("text", F.when(whole, F.col("text")).otherwise(_cleaned()))
    return rest.withColumn(into, F.lit(0).cast("long")).union(found.select(*_own(docs), into))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with text cleaned, and n_chars, if they have it, counted anew; documents of which no word is left go.

    They go by what a generator leaves: any other filter on kept words would be pushed below the columns that these are
    made from, whose expressions would then be evaluated for each word.
    """
    whole, stays = F.col(f"{OWN}starts").isNull(), f"{OWN}stays"
    rest, found = _with_kept(docs)
    found = found.select("*", F.explode_outer(F.when(whole | (F.size(f"{OWN}kept") > 0), F.array(F.lit(True)))).alias(stays)).where(f"{stays} is not null")
    found = found.withColumn("text", F.when(whole, F.col("text")).otherwise(_cleaned()))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rest.union(found.select(*_own(docs)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


#: Windows are met by their lines' and words' texts, and the least of 22 words by a frame of rows.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS t FROM documents),
u AS (SELECT doc_id, t, list_transform(t, lambda x: trim(x, e' \t\n\x0b\x0c\r')) AS w FROM d),
n AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS p FROM u),
k AS (SELECT doc_id, n, p, (instr(x, 'e') - (strlen(x)::BIGINT << 6)) * 2147483648 + p AS k FROM n),
a AS (SELECT DISTINCT doc_id, n, (min(k) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 21 FOLLOWING)) & 2147483647 AS p FROM k),
by_word AS (SELECT a.doc_id, a.p AS p, 30 AS n, w[a.p + 1:a.p + 30] AS win, 'word' AS kind FROM a JOIN u USING (doc_id) WHERE a.p + 30 <= a.n),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, trim(line, e' \t\n\x0b\x0c\r') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
o AS (
  SELECT doc_id, line, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
    list(line) OVER f AS win, sum(n) OVER f AS n
  FROM c WHERE n > 0 WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
by_line AS (SELECT doc_id, p, n, win, 'line' AS kind FROM o WHERE len(win) = 3),
w AS (SELECT * FROM by_word UNION ALL SELECT * FROM by_line),
later AS (SELECT doc_id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY kind, win ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(p::BIGINT, (p + n)::BIGINT)) AS p FROM later),
pieces AS (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS p FROM u WHERE doc_id IN (SELECT doc_id FROM covered)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS t FROM pieces ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed IS NULL THEN text ELSE coalesce(kept.t, '') END AS t
  FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id))
SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM r
"""
