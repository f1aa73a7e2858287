"""Loading works and keeping their hierarchy: rollups, merges, deletions, titles of children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.staging import staged
from ..plans.star import STAR_SQL, Star

_W = f"WITH {STAR_SQL}"


@query(f"{_W} SELECT deck_id, CAST(sum(occ) AS BIGINT) AS word_count, count(*) AS unique_word_count, CAST(sum(once) AS BIGINT) AS unique_word_used_once_count FROM perword GROUP BY ALL")
def parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck with children has their sums and nothing of its own."""
    return Star(spark, sf_dir).stats().select("deck_id", "word_count", "unique_word_count", "unique_word_used_once_count")


@query("SELECT deck_id, CASE WHEN media_type IN (1, 2, 3, 9) THEN 0 ELSE n END AS sentence_count FROM (SELECT s_suppkey + 1 AS deck_id, s_nationkey % 9 + 1 AS media_type, count(DISTINCT l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)")
def sentence_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences aren't counted in anime, drama, movies and manga."""
    decks = Star(spark, sf_dir).decks()
    return decks.select("deck_id", F.when(F.col("media_type").isin(1, 2, 3, 9), 0).otherwise(F.col("sentence_count")).alias("sentence_count"))


@query("SELECT l_orderkey AS deck_id, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS deck_order FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def child_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children numbered within their parent, nested ones from 1 again."""
    rows = Star(spark, sf_dir).read("lineitem").select(F.col("l_orderkey").alias("deck_id"), "l_partkey", "l_suppkey").distinct()
    return rows.withColumn("deck_order", F.row_number().over(Window.partitionBy("deck_id").orderBy("l_partkey", "l_suppkey")))


@query("""SELECT o_custkey AS parent_id, o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'Volume ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS title FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)""")
def child_titles(spark: SparkSession, sf_dir: str, prefix: str = "Volume") -> DataFrame:
    """Titles of the files of a work: numbered if there are several; a single file is the work itself, without a title."""
    files = Star(spark, sf_dir).read("orders").select(F.col("o_custkey").alias("parent_id"), "o_orderkey").distinct()
    own = Window.partitionBy("parent_id")
    title = F.concat(F.lit(f"{prefix} "), F.row_number().over(own.orderBy("o_orderkey")).cast("string"))
    return files.select("parent_id", "o_orderkey", F.when(F.count("*").over(own) > 1, title).alias("title"))


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing and incoming (title, media_type, updated, payload) after the load: the later update wins, ties stay, with the action taken."""
    old = existing.select("title", "media_type", F.col("updated").alias("old_updated"), F.col("payload").alias("old_payload"))
    both = old.join(incoming, ["title", "media_type"], "full")
    newer = F.col("updated") > F.col("old_updated")
    action = F.when(F.col("old_updated").isNull(), "insert").when(F.coalesce(newer, F.lit(False)), "update").otherwise("keep")
    return both.select("title", "media_type", F.when(action == "keep", F.col("old_updated")).otherwise(F.col("updated")).alias("updated"), F.when(action == "keep", F.col("old_payload")).otherwise(F.col("payload")).alias("payload"), action.alias("action"))


@query("""WITH old AS (SELECT s_name AS title, s_nationkey % 9 + 1 AS media_type, s_suppkey % 7 AS updated, s_acctbal AS payload FROM supplier WHERE s_suppkey % 3 <> 0),
new AS (SELECT s_name AS title, s_nationkey % 9 + 1 AS media_type, s_suppkey % 5 AS updated, s_acctbal + 1 AS payload FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT coalesce(o.title, n.title) AS title, coalesce(o.media_type, n.media_type) AS media_type,
  CASE WHEN o.title IS NULL OR n.updated > o.updated THEN n.updated ELSE o.updated END AS updated, CASE WHEN o.title IS NULL OR n.updated > o.updated THEN n.payload ELSE o.payload END AS payload,
  CASE WHEN o.title IS NULL THEN 'insert' WHEN n.updated > o.updated THEN 'update' ELSE 'keep' END AS action
FROM old o FULL JOIN new n ON o.title = n.title AND o.media_type = n.media_type""")
def deck_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Star(spark, sf_dir).read("supplier").withColumn("media_type", F.col("s_nationkey") % 9 + 1)
    cut = lambda every, by, plus: rows.where(F.col("s_suppkey") % every != 0).select(F.col("s_name").alias("title"), "media_type", (F.col("s_suppkey") % by).alias("updated"), (F.col("s_acctbal") + plus).alias("payload"))
    return merged(cut(3, 7, 0), cut(4, 5, 1))


def child_actions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What happens to each child title of each parent: update, insert or delete."""
    both = existing.withColumn("old", F.lit(True)).join(incoming.withColumn("new", F.lit(True)), ["parent_id", "title"], "full")
    return both.select("parent_id", "title", F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update").alias("action"))


def _order_children(star: Star) -> tuple[DataFrame, DataFrame]:
    lines = star.read("lineitem").select((F.col("l_suppkey") + 1).alias("parent_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), "l_linestatus")
    return lines.where("l_linestatus = 'F'").drop("l_linestatus").distinct(), lines.where("l_linestatus = 'O'").drop("l_linestatus").distinct()


_CHILDREN = "WITH a AS (SELECT DISTINCT l_suppkey + 1 AS parent_id, 'part ' || l_partkey AS title FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_suppkey + 1 AS parent_id, 'part ' || l_partkey AS title FROM lineitem WHERE l_linestatus = 'O')"


@query(f"{_CHILDREN} SELECT coalesce(a.parent_id, b.parent_id) AS parent_id, coalesce(a.title, b.title) AS title, CASE WHEN a.title IS NULL THEN 'insert' WHEN b.title IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL JOIN b ON a.parent_id = b.parent_id AND a.title = b.title")
def child_merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_actions(*_order_children(Star(spark, sf_dir)))


@query(f"{_CHILDREN} SELECT * FROM a ANTI JOIN b USING (parent_id, title)")
def children_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = _order_children(Star(spark, sf_dir))
    return existing.join(incoming, ["parent_id", "title"], "left_anti")


def unique_titles(children: DataFrame) -> DataFrame:
    """children, or an error if a parent has the same title twice: a merge could not tell these apart."""
    twice = children.groupBy("parent_id", "title").count().where("count > 1").first()
    if twice:
        raise ValueError(f"parent {twice.parent_id} has {twice['count']} children titled {twice.title!r}")
    return children


@query("SELECT p_partkey AS word_id, p_name AS word FROM part UNION ALL SELECT -1 - r_regionkey, lower(r_name) FROM region")
def union_custom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary with custom words added."""
    star = Star(spark, sf_dir)
    custom = star.read("region").select((-1 - F.col("r_regionkey")).cast("long").alias("word_id"), F.lower("r_name").alias("word"))
    return star.read("part").select(F.col("p_partkey").alias("word_id"), F.col("p_name").alias("word")).unionByName(custom)


def rolled_up(parents: DataFrame, values: DataFrame) -> DataFrame:
    """node, total: sums of values(node, value) over each node and all nodes below it, by parents(node, parent) of any depth.

    Pairs of nodes and ancestors grow to twice their reach in each round, so that a tree of depth d takes log2(d) rounds.
    A node that is its own ancestor raises.
    """
    pairs = staged(parents.where("parent is not null").select("node", F.col("parent").alias("above")).distinct(), "ancestors")
    n, before = pairs.count(), -1
    while n != before:
        further = pairs.join(pairs.toDF("above", "further"), "above").select("node", F.col("further").alias("above"))
        pairs = staged(pairs.union(further).distinct(), "ancestors")
        n, before = pairs.count(), n
        if not pairs.where("node = above").isEmpty():
            raise ValueError("a node is its own ancestor")
    every = pairs.union(parents.select("node", "node")).union(parents.where("parent is not null").select("parent", "parent")).distinct()
    own = values.groupBy("node").agg(F.sum("value").alias("value"))  # partial sums first: many values may be of one node
    return every.join(own, "node").groupBy(F.col("above").alias("node")).agg(F.sum("value").alias("total"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT c_custkey, c_nationkey, n FROM customer JOIN o ON o_custkey = c_custkey),
x AS (SELECT c.*, n_regionkey FROM c JOIN nation ON n_nationkey = c_nationkey)
SELECT 'c' || c_custkey AS node, n AS total FROM c UNION ALL SELECT 'n' || c_nationkey, CAST(sum(n) AS BIGINT) FROM c GROUP BY ALL
UNION ALL SELECT 'r' || n_regionkey, CAST(sum(n) AS BIGINT) FROM x GROUP BY n_regionkey UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM x""")
def deep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, nation, region and in all: a rollup over four levels."""
    star = Star(spark, sf_dir)
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    parents = star.read("customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"))
    parents = parents.union(star.read("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(star.read("region").select(name("r", "r_regionkey"), F.lit("all")))
    return rolled_up(parents, star.read("orders").select(name("c", "o_custkey").alias("node"), F.lit(1).alias("value")))


@query(f"""{_W} SELECT d.deck_id, to_json({{deck_id: d.deck_id, media_type: d.media_type, title: d.original_title, children: list({{'order': c.deck_order, 'title': c.original_title}} ORDER BY c.deck_order)}})::VARCHAR AS json
FROM titles d JOIN children c ON c.parent_deck_id = d.deck_id GROUP BY d.deck_id, d.media_type, d.original_title""")
def deck_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work with children as a JSON document; children stand inside their work, which needs no references to parents."""
    star = Star(spark, sf_dir)
    child = F.struct(F.col("deck_order").alias("order"), F.col("original_title").alias("title"))
    children = star.children().groupBy(F.col("parent_deck_id").alias("deck_id")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    rows = star.titles().join(children, "deck_id").select("deck_id", "media_type", F.col("original_title").alias("title"), "children")
    return rows.select("deck_id", F.to_json(F.struct("deck_id", "media_type", "title", "children")).alias("json"))
