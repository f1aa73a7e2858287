"""Merkle manifest of a dataset (11): a leaf for each document, a tree for each source, and a tree over the sources.

Leaves are hashed where the texts are read; nothing but digests moves on. Their places within a source come from ranges of
(source, doc_id), so that a large source spreads over tasks. A tree is reduced in superblocks: nodes are put into buckets
by place div FANOUT^DEPTH, each bucket is collapsed by DEPTH levels in one call, and the buckets' roots are the nodes of
the next round; the subroots of all sources are reduced in the same way. Proofs go down again by the same buckets: each
node's siblings within its bucket (the lower proof) are followed by those of the bucket's root (the upper one). A bucket
holds FANOUT^DEPTH rows at most, whatever the source's size; only the root and counts of nodes reach the driver.

A null is a leaf's `-`, also in a column that the documents don't have; a null text stays null when it is tampered with.
Null sources are a tree of their own, the first. Null doc_ids come first within a source; rows of the same doc_id are
ordered by their leaves, and repeated rows are leaves each. A lone leaf is its source's subroot, and a lone subroot the
root; its proof is empty. Whole texts are hashed. An empty table gives an empty result. Of the documents' columns only
doc_id is returned, so none can clash with results.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .common import digest, release, staged, table

FANOUT = 16
#: Levels of a superblock: 4096 nodes at most.
DEPTH = 3
#: Columns that a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row: `-` for each null, else byte count, colon and value."""
    texts = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lower_cased_fifth(values: dict[str, Column]) -> dict[str, Column]:
    """Tampering: where 5 divides the CRC-32 of the doc_id the text's A-Z are lower-cased."""
    chosen = F.coalesce(F.crc32(values["doc_id"].cast("string")) % 5 == 0, F.lit(False))
    return values | {"text": F.when(chosen, F.translate(values["text"], UPPER, LOWER)).otherwise(values["text"])}


def leaves(docs: DataFrame, tampered: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """tree, doc_id, digest, offered (the digest of the row as tampered with), index within the tree, n of it."""
    names = {c.lower(): c for c in docs.columns}
    values = {c: F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string") for c in FIELDS}
    # Ordered as wanted: null sources first, then by bytes
    tree = F.coalesce(F.concat(F.lit("1"), values["source"].cast("string")), F.lit("0"))
    own = leaf(values)
    rows = docs.select(tree.alias("tree"), values["doc_id"].alias("doc_id"), own.alias("digest"), (leaf(tampered(values)) if tampered else own).alias("offered"))
    # Staged, as ranges are sampled first: texts are read and hashed once
    return numbered(staged(rows, "leaves"), [F.col("doc_id"), F.col("digest")], ("tree",), total="n")


def height(n: int) -> int:
    """Levels until n nodes are one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def levels_of(digests: list[str], depth: int) -> list[list[str]]:
    """The nodes of each level, from the lowest."""
    out = [digests]
    for _ in range(depth):
        out.append([digest("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def path(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """What stands before and after a node in its run, level by level below the top."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % FANOUT
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + FANOUT])))
        place //= FANOUT
    return out


def folded(node: str, proof: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, after in proof:
        node = digest(before + node + after)
    return node


def proof_digest(proof: list[tuple[str, str]]) -> str:
    return digest("".join(before + after for before, after in proof))


_NODE = "tree string, index long, n long, digest string"


def _block(nodes: pd.DataFrame, depth: int) -> list[list[str]]:
    """The levels of a bucket, whose nodes are given in order."""
    return levels_of(nodes["digest"].tolist(), min(depth, height(int(nodes["n"].iloc[0]))))


def _collapsed(nodes: pd.DataFrame, depth: int) -> pd.DataFrame:
    release()
    nodes, span = nodes.sort_values("index"), FANOUT**depth
    n = int(nodes["n"].iloc[0])
    return pd.DataFrame({"tree": [nodes["tree"].iloc[0]], "index": [int(nodes["index"].iloc[0]) // span], "n": [-(-n // span)], "digest": [_block(nodes, depth)[-1][0]]})


def reduced(nodes: DataFrame, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round of superblocks, and the roots of all trees."""
    rounds = [nodes]
    while True:
        blocks = rounds[-1].groupBy("tree", F.expr(f"index div {FANOUT**depth}").alias("bucket")).applyInPandas(lambda rows: _collapsed(rows, depth), _NODE)
        blocks = staged(blocks, "superblocks")
        if (blocks.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, blocks
        rounds.append(blocks)


_PROOF = "tree string, index long, name string, subroot string, before array<string>, after array<string>"


def _proved(nodes: pd.DataFrame, upper: pd.DataFrame, depth: int) -> list[list[tuple[str, str]]]:
    """The whole proof of each node of a bucket, given in order: the lower one, then that of the bucket's root."""
    levels = _block(nodes, depth)
    above = list(zip(upper["before"].iloc[0], upper["after"].iloc[0], strict=True))
    return [path(levels, place) + above for place in range(len(nodes))]


def _node_proofs(nodes: pd.DataFrame, upper: pd.DataFrame, depth: int) -> pd.DataFrame:
    release()
    nodes = nodes.sort_values("index")
    proofs = _proved(nodes, upper, depth)
    names = nodes["name"].tolist() if "name" in nodes else [None] * len(nodes)
    subroots = nodes["digest"].tolist() if "name" in nodes else [upper["subroot"].iloc[0]] * len(nodes)
    return pd.DataFrame({"tree": nodes["tree"], "index": nodes["index"], "name": names, "subroot": subroots, "before": [[b for b, _ in p] for p in proofs], "after": [[a for _, a in p] for p in proofs]})


def _beside(nodes: DataFrame, upper: DataFrame, depth: int):
    """Each bucket of nodes with the proof of its root."""
    above = upper.select("tree", F.col("index").alias("bucket"), "subroot", "before", "after")
    return nodes.withColumn("bucket", F.expr(f"index div {FANOUT**depth}")).groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket"))


def _downwards(rounds: list[DataFrame], upper: DataFrame, depth: int) -> DataFrame:
    """Proofs of the buckets of the first round, given those of the last."""
    for nodes in reversed(rounds):
        upper = staged(_beside(nodes, upper, depth).applyInPandas(lambda rows, above: _node_proofs(rows, above, depth), _PROOF), "proofs")
    return upper


def manifest(docs: DataFrame, tampered: Callable[[dict[str, Column]], dict[str, Column]] | None = None, with_proofs: bool = False, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with_proofs adds proof, the siblings before and after by level.

    Without tampering the folded root is that of the leaf itself.
    """
    spark = docs.sparkSession
    rounds, subroots = reduced(leaves(docs, tampered), depth)
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), [F.col("name")], ("tree",), total="n")
    source_rounds, top = reduced(sources, depth)
    root = (top.first() or {"digest": None})["digest"]
    whole = spark.createDataFrame([("", 0, None, root, [], [])] if root else [], _PROOF)
    of_sources = _downwards(source_rounds, whole, depth)
    upper = of_sources.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), F.col("name"), "subroot", "before", "after")
    upper = _downwards(rounds[1:], upper, depth)

    def results(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        release()
        rows = rows.sort_values("index")
        proofs = _proved(rows, above, depth)
        roots = [folded(x, p) for x, p in zip(rows["offered"], proofs, strict=True)]
        out = {"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": [proof_digest(p) for p in proofs], "folded_root": roots, "verified": [r == root for r in roots]}
        return pd.DataFrame(out | ({"proof": [[{"before": b, "after": a} for b, a in p] for p in proofs]} if with_proofs else {}))

    kind = dict(rounds[0].dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<before:string,after:string>>" * with_proofs
    return _beside(rounds[0], upper, depth).applyInPandas(results, schema)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), lower_cased_fifth)


def oracle(levels: int = 5) -> str:
    """SQL for trees of up to 16^levels leaves: levels one by one, siblings by windows, CRC-32 from its polynomial."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    def tree(name: str) -> str:
        out = []
        for k in range(levels):
            out.append(
                f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, max((n + 15) // 16) AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY tree, i // 16),\n"
                f"{name}{k}s AS (SELECT tree, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,"
                f" coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})"
            )
        return ",\n".join(out)

    def fold(name: str, start: str) -> tuple[str, str]:
        """Joins to each level's siblings, and the steps of the fold."""
        joins = "\n".join(f"JOIN {name}{k}s {name}x{k} ON {name}x{k}.tree = {start}.{'tree' if name == 'l' else 'top'} AND {name}x{k}.i = {start}.{'i' if name == 'l' else 'ti'} // {16**k}" for k in range(levels))
        siblings = " || ".join(f"CASE WHEN {name}x{k}.n > 1 THEN {name}x{k}.b || {name}x{k}.a ELSE '' END" for k in range(levels))
        return joins, siblings

    steps, last = [], "offered"
    for x in [f"lx{k}" for k in range(levels)] + [f"tx{k}" for k in range(levels)]:
        steps.append(f"f_{x} AS (SELECT *, CASE WHEN {x}_n > 1 THEN sha256({x}_b || {last} || {x}_a) ELSE {last} END AS d_{x} FROM {'f_' + prior if steps else 'joined'})")
        prior, last = x, f"d_{x}"
    (leaf_joins, lower), (top_joins, upper) = fold("l", "c"), fold("t", "c")
    columns = ", ".join(f"{x}.n AS {x}_n, {x}.b AS {x}_b, {x}.a AS {x}_a" for x in [f"lx{k}" for k in range(levels)] + [f"tx{k}" for k in range(levels)])
    return f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS crc
  FROM documents, tab),
d AS (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM crc),
h AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {row("text")} AS h, {row("changed")} AS offered FROM d),
l0 AS (SELECT tree, doc_id, h, offered, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM h),
{tree("l")},
subroots AS (SELECT tree AS name, h FROM l{levels}),
t0 AS (SELECT '' AS tree, name, h, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n FROM subroots),
{tree("t")},
c AS (SELECT l0.doc_id, l0.tree, l0.i, l0.h AS leaf, l0.offered, t0.h AS subroot, '' AS top, t0.i AS ti FROM l0 JOIN t0 ON l0.tree = t0.name),
joined AS (
  SELECT c.*, {lower} || {upper} AS proof, {columns}
  FROM c {leaf_joins}
  {top_joins}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, {last} AS folded_root, {last} = r.h AS verified FROM f_{prior}, (SELECT h FROM t{levels}) r
"""
