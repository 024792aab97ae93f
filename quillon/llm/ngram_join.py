"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is (number of distinct texts that have it, shingle), rarest first, from one pass over all
texts. Shingles that MANY texts of one slice share have no exact count and go last, by their hash alone; any order that is
the same for all texts finds the same links, and this one keeps the texts of frequent shingles from meeting in one place.
The rarest stretch of a text's shingles names its candidates; the order is cut into fragments,
overlaps are counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import lean, stored, table
from quillon.llm.components import components
from quillon.llm.shingles import bucket_of, dealt, shingle_set

#: Bytes of text for each bucket of the count; a bucket is what one task holds at once.
BUCKET_BYTES = 8 << 20
#: Characters of text that a task works on at once.
SLICE = 4 << 20
#: A shingle that so many texts of a slice have is frequent: it goes last in the global order, and its texts are not sent
#: to where it is counted, only word of it. FREQUENT stands for its count.
MANY, FREQUENT = 8, (1 << 32) - 1
FRAGMENTS = 4
STARS = 2


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def text_sets(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Packed rows of one pass over the texts.

    kind 0: key is a bucket of shingles, a the shingles, b the place of each one's text in c, c the nodes; a shingle of
    node 0 is a frequent one.
    kind 1: key is a bucket of nodes, a the nodes, b their numbers of shingles.
    kind 3: key is a bucket of nodes, a the nodes, b frequent shingles of theirs, c FREQUENT.
    kind 2: id, node and size of a document; key only spreads them.
    A node is the 64-bit digest of a shingle set, so copies are one node from the start.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = 0
        for batch in batches:
            lo = 0
            while lo < len(batch):  # about SLICE characters at a time
                hi, size = lo, 0
                while hi < len(batch) and (size < SLICE or hi == lo):
                    size += len(batch["_text"].iat[hi] or "")
                    hi += 1
                some = batch.iloc[lo:hi]
                lo = hi
                turn += 1
                sets: dict[int, np.ndarray] = {}
                nodes, sizes = [], []
                for text in some["_text"]:
                    found = shingle_set(text)
                    node = xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0
                    nodes.append(node)
                    sizes.append(len(found))
                    if len(found):
                        sets.setdefault(node, found)
                ids = np.array(nodes, np.uint64)
                key = (turn * 31 + np.arange(len(ids))) % buckets
                yield pd.DataFrame({"kind": 2, "key": key, "a": None, "b": None, "c": None, "id": some["_id"].to_numpy(), "node": _signed(ids), "n": sizes})
                if not sets:
                    continue
                known = np.fromiter(sets, np.uint64, len(sets))
                counts = np.fromiter(map(len, sets.values()), np.int64, len(sets))
                owner = np.repeat(np.arange(len(known), dtype=np.int32), counts)
                shingles = np.concatenate(list(sets.values()))
                del sets
                order = np.argsort(shingles, kind="stable")
                shingles, owner = shingles[order], owner[order]
                start = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
                size = np.diff(np.append(start, len(shingles)))
                many = np.repeat(size >= MANY, size)
                rows = []
                nodes_of, common = known[owner[many]], shingles[many]
                order = np.argsort(nodes_of, kind="stable")
                nodes_of, common = nodes_of[order], common[order]
                for k, part in dealt(bucket_of(nodes_of, buckets)):
                    rows.append((3, k, nodes_of[part].tobytes(), common[part].tobytes(), np.full(len(common[part]), FREQUENT, np.uint32).tobytes()))
                for k, part in dealt(bucket_of(told := shingles[start[size >= MANY]], buckets)):
                    rows.append((0, k, told[part].tobytes(), np.zeros(len(told[part]), np.uint16).tobytes(), np.zeros(1, np.uint64).tobytes()))
                shingles, owner = shingles[~many], owner[~many]
                for k, part in dealt(bucket_of(shingles, buckets)):
                    mine, place = np.unique(owner[part], return_inverse=True)
                    rows.append((0, k, shingles[part].tobytes(), place.astype(np.int32 if len(mine) > 65535 else np.uint16).tobytes(), known[mine].tobytes()))
                order = np.argsort(known)
                known, counts = known[order], counts[order]
                for k, part in dealt(bucket_of(known, buckets)):
                    rows.append((1, k, known[part].tobytes(), counts[part].tobytes(), None))
                out = pd.DataFrame(rows, columns=["kind", "key", "a", "b", "c"])
                yield out.assign(id=None, node=0, n=0)

    schema = packed_schema(docs, id_col)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInPandas(lean(pack), schema)


def packed_schema(docs: DataFrame, id_col: str) -> str:
    return f"kind int, key int, a binary, b binary, c binary, id {docs.schema[id_col].dataType.simpleString()}, node long, n int"


def _shared_of_bucket(buckets: int):
    """Of the shingles of one bucket, those that several nodes have, dealt by node with their counts; sizes and frequent
    shingles pass unchanged."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        if group["kind"].iloc[0]:
            return group
        shingles, nodes = [], []
        for a, b, c in zip(group["a"], group["b"], group["c"], strict=True):
            some = np.frombuffer(a, np.uint64)
            shingles.append(some)
            nodes.append(np.frombuffer(c, np.uint64)[np.frombuffer(b, np.uint16 if len(b) == 2 * len(some) else np.int32)])
        one, two = np.concatenate(shingles), np.concatenate(nodes)
        order = np.argsort(one)
        one, two = one[order], two[order]
        same = np.concatenate([[False], one[1:] == one[:-1]])
        keep = same | np.concatenate([same[1:], [False]])  # most shingles occur once and go at this point
        one, two = one[keep], two[keep]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        fresh = np.ones(len(one), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])  # a node that several tasks met counts once
        one, two = one[fresh], two[fresh]
        if not len(one):
            return pd.DataFrame(columns=["kind", "key", "a", "b", "c", "id", "node", "n"])
        first, place, counts = np.unique(one, return_index=True, return_inverse=True, return_counts=True)[1:]
        freq = np.where(two[first] == 0, FREQUENT, counts)[place]
        keep = (freq > 1) & (two != 0)
        one, two, freq = one[keep], two[keep], freq[keep]
        rows = []
        order = np.argsort(two, kind="stable")
        one, two, freq = one[order], two[order], freq[order]
        for k, part in dealt(bucket_of(two, buckets)):
            rows.append((0, k, two[part].tobytes(), one[part].tobytes(), freq[part].astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["kind", "key", "a", "b", "c"]).assign(id=None, node=0, n=0)

    return count


def _sets_of_nodes(percent: int):
    """Nodes of one bucket whose prefix holds a shared shingle: size, lone shingles, shared ones in global order."""

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        size: dict[int, int] = {}
        for a, b in group.loc[group["kind"] == 1, ["a", "b"]].itertuples(index=False):
            size.update(zip(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.int64).tolist(), strict=True))
        some = group[group["kind"] != 1]
        empty = pd.DataFrame(columns=["node", "n", "lone", "shingles", "freqs"], dtype=object)
        if not len(some):
            return empty
        node = np.concatenate([np.frombuffer(x, np.uint64) for x in some["a"]])
        shingle = np.concatenate([np.frombuffer(x, np.uint64) for x in some["b"]])
        freq = np.concatenate([np.frombuffer(x, np.uint32) for x in some["c"]])
        order = np.lexsort((shingle, freq, node))
        node, shingle, freq = node[order], shingle[order], freq[order]
        fresh = np.ones(len(node), bool)  # a frequent shingle of a node that several tasks met stands there for each
        fresh[1:] = (node[1:] != node[:-1]) | (shingle[1:] != shingle[:-1])
        node, shingle, freq = node[fresh], shingle[fresh], freq[fresh]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        rows = []
        for lo, hi in zip(starts, [*starts[1:], len(node)], strict=True):
            n = size[int(node[lo])]
            lone = n - (hi - lo)
            if lone < n - -(-percent * n // 100) + 1:
                rows.append((_signed(node[lo : lo + 1])[0], n, lone, _signed(shingle[lo:hi]), freq[lo:hi].astype(np.int64)))
        return pd.DataFrame(rows, columns=["node", "n", "lone", "shingles", "freqs"]) if rows else empty

    return gather


def linked_nodes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) for the nodes of sets(node, n, lone, shingles, freqs) that have a link.

    Rounds: candidates of the first ones are stars, each member of a prefix shingle's group against one leader;
    verified links merge components. The last round takes all candidates that are still in different components, so
    that no link is lost, while members of one group that are joined already are not paired again.
    """
    spots = sets.select("node", F.explode(F.arrays_zip("shingles", "freqs")).alias("x")).select(
        "node", F.col("x.shingles").alias("shingle"), (F.col("x.freqs") + (F.col("x.shingles") / F.lit(2.0**64) + 0.5)).alias("place")
    )
    cuts = [k / FRAGMENTS for k in range(1, FRAGMENTS)]
    pivots = spots.agg(F.percentile_approx("place", cuts, 1000)).first()[0] or []
    fragment = sum((F.col("place") > F.lit(float(p))).cast("int") for p in pivots) if pivots else F.lit(0)
    segments = stored(
        spots.withColumn("fragment", fragment).groupBy("node", "fragment").agg(F.collect_list("shingle").alias("part")), "join-segments"
    )
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("lone")
    heads = stored(
        sets.withColumn("m", prefix.cast("int"))
        .where("m > 0")
        .select("node", "n", "lone", F.posexplode(F.slice("shingles", F.lit(1), F.least("m", F.size("shingles")))).alias("i", "shingle"))
        .withColumn("left", F.col("n") - F.col("lone") - F.col("i")),
        "join-heads",
    )
    # what two sets can share at most from the first shingle on that they share: what each has left in the global order
    most = F.least("left", "l.left")
    fits = most * (100 + percent) >= percent * (F.col("n") + F.col("l.n"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs(a, na, b, nb): overlaps are counted in each fragment and summed."""
        one = segments.select(F.col("node").alias("a"), "fragment", F.col("part").alias("pa"))
        two = segments.select(F.col("node").alias("b"), "fragment", F.col("part").alias("pb"))
        partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("both"))
        total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
        return total.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")

    def led(members: DataFrame) -> DataFrame:
        """members with the leader l of their shingle's group: the one with the smallest share of lone shingles, which
        is nearest to most others."""
        who = F.struct((F.col("lone") / F.col("n")).alias("share"), "node", "n", "left", "component")
        return members.join(members.groupBy("shingle").agg(F.min(who).alias("l")), "shingle")

    links = None
    found = None
    for turn in range(STARS + 1):
        if found is None:
            members = heads.withColumn("component", F.col("node"))
        else:
            members = heads.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = members.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
            members = stored(members.join(mixed, "shingle"), "join-members")
        apart = F.col("component") != F.col("l.component")
        if turn < STARS:
            pairs = led(members).where(apart & fits)
            if turn:  # those that the first leader has not joined follow one of their own, too
                rest = led(members).where(apart).drop("l")
                pairs = pairs.unionByName(led(rest).where(apart & fits))
        else:
            other = members.select("shingle", F.struct("node", "n", "left", "component").alias("l"))
            pairs = members.join(other, "shingle").where(fits & apart & (F.col("node") < F.col("l.node")))
        pairs = pairs.select(
            F.least("node", "l.node").alias("a"),
            F.greatest("node", "l.node").alias("b"),
            F.when(F.col("node") < F.col("l.node"), F.col("n")).otherwise(F.col("l.n")).alias("na"),
            F.when(F.col("node") < F.col("l.node"), F.col("l.n")).otherwise(F.col("n")).alias("nb"),
        )
        fresh = stored(verified(stored(pairs.distinct(), "join-pairs")), "join-links")
        links = fresh if links is None else links.unionByName(fresh)
        found = stored(components(links), "join-components")
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs.

    Two texts link when 100 * intersection >= percent * union of their five-word shingles; component_id is the
    smallest id reachable, the row's own included. Null texts and texts without words have 0 shingles and link with
    nothing. Equal shingle sets are one node, so groups of copies cost nothing more; rows with equal ids are separate
    rows that share what they reach. A null id reaches its component's smallest id, null if that has none. Other
    columns are left behind, so names cannot clash.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = int(max(16, -(-total // BUCKET_BYTES)))
    packed = text_sets(docs, id_col, text_col, buckets).groupBy("kind", "key")
    packed = stored(packed.applyInPandas(lean(_shared_of_bucket(buckets)), packed_schema(docs, id_col)), "join-shared")
    shared = packed.where("kind <> 2").select("kind", "key", "a", "b", "c")
    sets = stored(shared.groupBy("key").applyInPandas(lean(_sets_of_nodes(percent)), "node long, n long, lone long, shingles array<long>, freqs array<long>"), "join-sets")
    found = linked_nodes(sets, percent)
    rows = packed.where("kind = 2").select(F.col("id").alias("_id"), "node", "n")
    # a text without shingles is a class of its own
    own = rows.where("n > 0").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = stored(own, "join-rows")
    least = own.groupBy("component").agg(F.min("_id").alias("component_id"))
    joined = own.join(least, "component").select("_id", "n", "component_id")
    none = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return joined.unionByName(none).select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, ws, UNNEST(range(1, GREATEST(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, MIN(c) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
