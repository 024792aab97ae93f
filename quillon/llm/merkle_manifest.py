"""A Merkle manifest of a corpus that is checked by resuming SHA-256 in the middle.

Leaves are digests of rows. Every source has a tree over its rows in the order of ids, and one tree stands over the roots
of the sources. While more than one node remains, each run of three neighbours becomes the digest of its digests. A parent
keeps a copy of its running hash from before each child slot, so that a replaced child costs its own digest and those of
its right siblings: the left ones are in the copied state.

Trees grow in blocks of 3**height nodes, whose roots are the nodes of the next round, so a task sees one block and the
number of rounds is the logarithm of the largest source. On the way down, every block gets its path: for each level
above it the digests left and right of it. Only numbers of rounds reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import fold, stored, table

RUN = 3
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, place long, n long, digest string"
PATH = "tree long, place long, lefts array<string>, rights array<string>, top string"


def field_text(value: Column) -> Column:
    """A field as it goes into a leaf: `-` for null, else the bytes of its text, a colon and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


# --- one block ---------------------------------------------------------------------------------------------------


def height_of(n: int) -> int:
    """Levels over n nodes until one remains."""
    levels = 0
    while n > 1:
        n = -(-n // RUN)
        levels += 1
    return levels


class Level(NamedTuple):
    """The nodes of one level of a block, and for each of their parents the hash states before its child slots."""

    nodes: list[bytes]
    states: list[list]

    def left(self, place: int) -> list[bytes]:
        return self.nodes[place - place % RUN : place]

    def right(self, place: int) -> list[bytes]:
        return self.nodes[place + 1 : place - place % RUN + RUN]


def grow(nodes: list[bytes], levels: int) -> tuple[list[Level], list[bytes]]:
    """The levels over nodes (digests as hex text), lowest first, and what they end in."""
    grown = []
    for _ in range(levels):
        parents, states = [], []
        for at in range(0, len(nodes), RUN):
            state, kept = hashlib.sha256(), []
            for child in nodes[at : at + RUN]:
                kept.append(state.copy())
                state.update(child)
            parents.append(state.hexdigest().encode())
            states.append(kept)
        grown.append(Level(nodes, states))
        nodes = parents
    return grown, nodes


def resume(state, digest: bytes, right: bytes) -> bytes:
    """The digest of a parent one of whose children is replaced; state is its hash before that child."""
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def _block(nodes: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[Level], list[bytes]]:
    nodes = nodes.sort_values("place")
    levels = min(height, height_of(int(nodes["n"].iloc[0])))
    return nodes, *grow([d.encode() for d in nodes["digest"]], levels)


def _block_root(nodes: pd.DataFrame, height: int) -> pd.DataFrame:
    nodes, _, (root,) = _block(nodes, height)
    first, size = nodes.iloc[0], RUN**height
    return pd.DataFrame({"tree": [first["tree"]], "place": [first["place"] // size], "n": [-(-first["n"] // size)], "digest": [root.decode()]})


def _block_paths(nodes: pd.DataFrame, above: pd.DataFrame, height: int) -> pd.DataFrame:
    nodes, levels, _ = _block(nodes, height)
    path = above.iloc[0]
    lefts, rights = [], []
    for k in range(len(nodes)):
        lefts.append([b"".join(level.left(k // RUN**h)).decode() for h, level in enumerate(levels)] + list(path["lefts"]))
        rights.append([b"".join(level.right(k // RUN**h)).decode() for h, level in enumerate(levels)] + list(path["rights"]))
    return pd.DataFrame({"tree": nodes["tree"], "place": nodes["place"], "lefts": lefts, "rights": rights, "top": path["top"]})


# --- trees over tables -------------------------------------------------------------------------------------------


def placed(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(df stored with _part, by ranges of group and order; for each part and group the rows before it and the group's n).

    A part is a range of rows, so a place is the rows of earlier parts and the rank inside one part, and no task sees a
    whole group.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "n": F.sum("_rows").over(whole)})


def _place(order: list[str], group: list[str]) -> Column:
    ranks = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return F.col("_before") + F.row_number().over(ranks) - 1


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {RUN**height}"))


def tree_rounds(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """nodes(tree, place, n, digest) and the block roots of each round; the last has one node for each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = _in_blocks(rounds[-1].select("tree", "place", "n", "digest"), height)
        rounds.append(stored(blocks.groupBy("tree", "block").applyInPandas(lambda n: _block_root(n, height), NODE), "merkle-round"))
    return rounds


def paths_down(rounds: list[DataFrame], paths: DataFrame, until: int, height: int = HEIGHT) -> DataFrame:
    """Paths of the nodes of rounds[until], from those of the trees' roots."""
    for nodes in reversed(rounds[until:-1]):
        blocks = _in_blocks(nodes.select("tree", "place", "n", "digest"), height)
        both = blocks.groupBy("tree", "block").cogroup(paths.withColumnRenamed("place", "block").groupBy("tree", "block"))
        paths = stored(both.applyInPandas(lambda n, p: _block_paths(n, p, height), PATH), "merkle-paths")
    return paths


class Manifest(NamedTuple):
    """What a corpus' manifest consists of: rows with their tree and place, block roots by round, subroots, and for each
    lowest block its path to the root."""

    rows: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    paths: DataFrame
    root: str | None
    height: int


def build_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", changed: Column | None = None, height: int = HEIGHT
) -> Manifest:
    """The manifest of docs; `changed` is a leaf digest that a row is to be checked with, null for its own."""
    spark = docs.sparkSession
    leaves = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf_digest([F.col(c) for c in fields]).alias("digest"), (F.lit(None) if changed is None else changed).cast("string").alias("changed")
    )
    # stored first: a dealing by ranges reads its rows twice, and these are without texts
    leaves = stored(leaves, "merkle-digests")
    order = ["id", "digest", "changed"]
    dealt, counts = placed(leaves, ["source"], order, "merkle-leaves")
    sources, parts = placed(counts.select("source", "n").distinct(), [], ["source"], "merkle-sources")
    numbered = sources.drop("n").join(parts.drop("n", "_rows"), "_part").withColumn("tree", _place(["source"], [])).select("source", "tree")
    numbered = stored(numbered, "merkle-trees")
    at = counts.alias("c").join(numbered.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "_part", "_before", "n", "tree")
    same = (F.col("d._part") == F.col("a._part")) & F.col("d.source").eqNullSafe(F.col("a.source"))
    rows = dealt.alias("d").join(at.alias("a"), same).select("d.*", "_before", "n", "tree").withColumn("place", _place(order, ["tree"]))
    rows = stored(rows.select("tree", "place", "n", "id", "source", "digest", "changed"), "merkle-rows")

    rounds = tree_rounds(rows, height)
    subroots = rounds[-1].select("tree", "digest")
    trees = numbered.count()
    over = tree_rounds(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest"), height)
    last = over[-1].select("digest").first()
    root = last[0] if last else None
    none = F.array().cast("array<string>")
    paths = over[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("top"))
    paths = paths_down(over, paths, 0, height)
    # the path of a source's root begins a path of its own tree
    paths = paths.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", "top")
    return Manifest(rows, rounds, subroots, paths_down(rounds, paths, 1, height), root, height)


def _folded(nodes: pd.DataFrame, above: pd.DataFrame, height: int, siblings: bool) -> pd.DataFrame:
    nodes, levels, _ = _block(nodes, height)
    path = above.iloc[0]
    higher = [(left.encode(), right.encode()) for left, right in zip(path["lefts"], path["rights"])]
    states = [(hashlib.sha256(left), right) for left, right in higher]  # what the parents above keep for this block
    tail = b"".join(left + right for left, right in higher)
    proofs, roots, lists = [], [], []
    for k, (own, other) in enumerate(zip(nodes["digest"], nodes["changed"])):
        digest = (own if pd.isna(other) else other).encode()
        beside, at = [], k
        for level in levels:
            right = level.right(at)
            digest = resume(level.states[at // RUN][at % RUN], digest, b"".join(right))
            beside += [*level.left(at), *right]
            at //= RUN
        for state, right in states:
            digest = resume(state, digest, right)
        beside = b"".join(beside) + tail
        proofs.append(hashlib.sha256(beside).hexdigest())
        roots.append(digest.decode())
        if siblings:
            lists.append([beside[i : i + 64].decode() for i in range(0, len(beside), 64)])
    out = nodes[["id", "tree", "digest"]].assign(proof_sha256=proofs, folded_root=roots, root=path["top"])
    return out.assign(siblings=lists) if siblings else out


def fold_manifest(manifest: Manifest, siblings: bool = False) -> DataFrame:
    """(id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: the root that its leaf, or the
    digest it is to be checked with, folds to. With siblings also the digests of the proof, lowest level first."""
    kind = manifest.rows.schema["id"].dataType.simpleString()
    schema = "id string, tree long, digest string, proof_sha256 string, folded_root string, root string"
    leaves = _in_blocks(manifest.rows.select("tree", "place", "n", F.col("id").cast("string").alias("id"), "digest", "changed"), manifest.height)
    paths = manifest.paths.withColumnRenamed("place", "block")
    both = leaves.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
    height = manifest.height
    folded = both.applyInPandas(lambda n, p: _folded(n, p, height, siblings), schema + (", siblings array<string>" if siblings else ""))
    trees = manifest.subroots.select("tree", F.col("digest").alias("subroot"))
    out = folded.withColumnsRenamed({"digest": "leaf"}).withColumn("id", F.col("id").cast(kind)).join(trees, "tree").drop("tree")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", changed: Column | None = None, siblings: bool = False, height: int = HEIGHT) -> DataFrame:
    """The manifest of docs with a check of every row: id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Leaves of a source, null being one, ascend by id (null first), then by digest; rows that repeat everything have equal
    leaves at places of their own. Sources follow by bytes, null first. `changed` replaces a row's leaf in the check
    alone. Null and empty fields differ. A source of one row has its leaf for a subroot, and a single source its subroot
    for a root; empty tables give no rows. Columns other than the fields don't matter, whatever their names.
    """
    return fold_manifest(build_manifest(docs, fields, id_col, source_col, changed, height), siblings).withColumnRenamed("id", id_col)


def without_breaks() -> Column:
    """The leaf of a row whose text has lost its line breaks, for every second row by the checksum of its id; else null."""
    cut = leaf_digest([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    return F.when((fold(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n")), cut)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    return merkle_manifest(docs, changed=without_breaks()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_field(value: str) -> str:
    return f"COALESCE(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


#: The lowest bit of the CRC-32 of an id as text: the polynomial's rule, bit by bit.
_SQL_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + strlen(COALESCE(doc_id::VARCHAR, ''))), lambda i: ascii(substr(COALESCE(doc_id::VARCHAR, ''), i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) & 1)"""

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN {_SQL_CRC} = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
low AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (ANY_VALUE(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 3),
sub AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub) AS n, digest FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, (ANY_VALUE(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3),
top AS (SELECT digest FROM high WHERE n = 1),
node AS (SELECT tree, lvl, pos, digest, n FROM low WHERE n > 1 UNION ALL SELECT -1, lvl, pos, digest, n FROM high WHERE n > 1),
side AS (
  SELECT tree, lvl, pos,
         COALESCE(string_agg(digest, '') OVER (PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         COALESCE(string_agg(digest, '') OVER (PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM node),
up AS (
  SELECT rid, tree, 0 AS lvl, pos, n, COALESCE(changed, leaf) AS digest, '' AS beside FROM p
  UNION ALL
  SELECT up.rid, up.tree, up.lvl + 1, up.pos // 3, (up.n + 2) // 3, sha256(s.l || up.digest || s.r), up.beside || s.l || s.r
  FROM up JOIN side s ON s.tree = up.tree AND s.lvl = up.lvl AND s.pos = up.pos WHERE up.n > 1),
over AS (
  SELECT rid, 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub) AS n, digest, beside FROM up WHERE n = 1
  UNION ALL
  SELECT o.rid, o.lvl + 1, o.pos // 3, (o.n + 2) // 3, sha256(s.l || o.digest || s.r), o.beside || s.l || s.r
  FROM over o JOIN side s ON s.tree = -1 AND s.lvl = o.lvl AND s.pos = o.pos WHERE o.n > 1)
SELECT p.doc_id, p.leaf, sub.digest AS subroot, top.digest AS root, sha256(over.beside) AS proof_sha256, over.digest AS folded_root, over.digest = top.digest AS verified
FROM p JOIN sub ON sub.tree = p.tree JOIN over ON over.rid = p.rid AND over.n = 1 CROSS JOIN top
"""
