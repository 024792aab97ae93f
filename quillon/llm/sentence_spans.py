"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed, equal runs are joined over all documents, and sentences that a
run other than the first covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import stored, table

#: A sentence is a stretch up to and with its marks; commas, semicolons and colons end one, too, so that a passage with
#: cut ends still holds whole ones. The pieces of a text joined are the text.
PIECE = re.compile(rb"[^.!?,;:\n]+[.!?,;:\n]*|[.!?,;:\n]+")
#: A run is the shortest one from its start that has so many sentences and so many words. Many sentences are a word or
#: two long; runs of those alone would be equal by chance.
WIDTH, WORDS = 2, 12
LAST = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def sentences(text: str | None) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Pieces of a text; of those with words their places, digests and numbers of words. What is compared are the words,
    A-Z lower-cased, with one space between."""
    pieces = [] if text is None else PIECE.findall(text.encode())
    places, digests, sizes = [], [], []
    for k, piece in enumerate(pieces):
        words = piece.lower().split()
        if words:
            places.append(k)
            digests.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            sizes.append(len(words))
    return pieces, places, digests, sizes


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(digests: np.ndarray, sizes: np.ndarray, owner: np.ndarray, last: np.ndarray, width: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of all runs of sentences laid end to end; last[k] is the end of the text that k is in."""
    n = len(digests)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    end = np.maximum(np.arange(n) + width, np.searchsorted(upto, upto[:-1] + words))
    start = np.flatnonzero(end <= last[owner])
    end = end[start]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(digests * _powers(n, ODD), dtype=np.uint64)])
    mixed = (sums[end] - sums[start]) * _powers(n, INVERSE)[start] + (end - start).astype(np.uint64) * ODD
    mixed = (mixed ^ (mixed >> np.uint64(31))) * ODD
    return start, end - start, mixed ^ (mixed >> np.uint64(29))


def runs_of_texts(rows: DataFrame, width: int, words: int) -> DataFrame:
    """(id, node, n_sentences, h, span, gone) of rows(id, node, text): the hashes and places of the runs that are the first
    of their kind in a batch of rows, and the places of the others, which are repeats whatever else there is.

    So a run that very many texts have leaves a task once for each batch. A place is start * 65536 + length."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates(["id", "node"]).sort_values(["id", "node"])
            found = [sentences(t)[2:] for t in batch["text"]]
            counts = np.array([len(d) for d, _ in found], np.int64)
            digests = np.fromiter((x for d, _ in found for x in d), np.uint64, int(counts.sum()))
            sizes = np.fromiter((x for _, s in found for x in s), np.int64, int(counts.sum()))
            owner, last = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
            start, length, h = _runs(digests, sizes, owner, last, width, words)
            who = owner[start]
            span = (start - (last - counts)[who]) * 65536 + length
            order = np.argsort(h, kind="stable")  # texts lie in order, so the first of equal runs comes first
            first = np.ones(len(order), bool)
            first[order[1:]] = h[order[1:]] != h[order[:-1]]
            edges = np.arange(1, len(counts))
            cut, cut_gone = np.searchsorted(who[first], edges), np.searchsorted(who[~first], edges)
            yield pd.DataFrame(
                {
                    "id": batch["id"].to_numpy(),
                    "node": batch["node"].to_numpy(),
                    "n_sentences": counts,
                    "h": np.split(h[first].view(np.int64), cut) if len(counts) else [],
                    "span": np.split(span[first], cut) if len(counts) else [],
                    "gone": np.split(span[~first], cut_gone) if len(counts) else [],
                }
            )

    return rows.mapInPandas(pack, "id long, node long, n_sentences long, h array<long>, span array<long>, gone array<long>")


def _cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Numbers of the sentences that the spans cover, and the text without them."""
    removed, kept = [], []
    for text, spans in zip(texts, gone, strict=True):
        if spans is None or not len(spans):
            removed.append([])
            kept.append(text or "")
            continue
        pieces, places, _, _ = sentences(text)
        out = np.zeros(len(places), bool)
        for s in spans:
            out[s >> 16 : (s >> 16) + (s & 65535)] = True
        numbers = np.flatnonzero(out)
        for k in numbers.tolist():
            pieces[places[k]] = b""
        removed.append(numbers.tolist())
        kept.append(b"".join(pieces).decode())
    return pd.DataFrame({"removed": removed, "kept_text": kept})


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, words: int = WORDS) -> DataFrame:
    """All rows of docs with n_sentences, n_removed, removed (numbers of sentences) and kept_text.

    Sentences are the pieces that have a word. From each one the shortest run of at least `width` sentences and `words`
    words is hashed; a run is a repeat when the same run stands earlier (smaller id, or earlier in the text), and every
    sentence in a repeat is removed. Null texts have no sentences and keep the empty text; texts too short for a run
    stay whole; rows with equal ids and texts are one document, different texts of one id or of none are several, in the
    order of their digests; a null id comes last. Columns of these names in docs are replaced. width is under 65536.
    """
    key = {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "_node": F.xxhash64(F.col(text_col).cast("string"))}
    rows = docs.select(key["_id"].alias("id"), key["_node"].alias("node"), F.col(text_col).cast("string").alias("text"))
    packed = stored(runs_of_texts(rows, width, words), "span-runs")
    spans = packed.select("id", "node", F.explode(F.arrays_zip("h", "span")).alias("x")).select("x.h", "id", "node", "x.span")
    spans = spans.repartition("h")  # one shuffle for the count and the join
    firsts = spans.groupBy("h").agg(F.min(F.struct("id", "node", "span")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = spans.join(firsts, "h").where(F.struct("id", "node", "span") != F.col("first"))
    parts = packed.select("id", "node", "n_sentences", "gone").unionByName(
        later.select("id", "node", F.lit(None).cast("long").alias("n_sentences"), F.array("span").alias("gone"))
    )
    # a text's runs are bounded by its own length
    found = parts.groupBy(F.col("id").alias("_id"), F.col("node").alias("_node")).agg(F.max("n_sentences").alias("_n"), F.flatten(F.collect_list("gone")).alias("_gone"))
    made = ["n_sentences", "n_removed", "removed", "kept_text"]
    texts = docs.drop(*made).withColumns(key)
    joined = texts.join(found, ["_id", "_node"], "left").drop("_id", "_node")
    cut = F.pandas_udf(_cut, "removed array<int>, kept_text string")
    joined = joined.withColumn("_x", cut(F.col(text_col).cast("string"), F.col("_gone")))
    out = joined.withColumns(
        {
            "n_sentences": F.coalesce("_n", F.lit(0)).cast("long"),
            "n_removed": F.size("_x.removed").cast("long"),
            "removed": F.col("_x.removed"),
            "kept_text": F.col("_x.kept_text"),
        }
    )
    return out.drop("_n", "_gone", "_x")


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: A run ends after 12 sentences at the latest, as each has a word.
OP6_SQL = r"""
WITH p AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^.!?,;:\n]+[.!?,;:\n]*|[.!?,;:\n]+') AS ps FROM documents),
e AS (SELECT doc_id, UNNEST(ps) AS piece, UNNEST(range(len(ps))) AS pos FROM p),
t AS (SELECT doc_id, pos, piece, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM e),
s AS (SELECT doc_id, pos, array_to_string(ws, ' ') AS same, ROW_NUMBER() OVER w - 1 AS k, SUM(len(ws)) OVER w AS upto, len(ws) AS n
      FROM t WHERE len(ws) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT a.doc_id, a.k, MIN(b.k) AS z FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + 1 AND a.k + 11 AND b.upto - a.upto + a.n >= 12 GROUP BY ALL),
h AS (SELECT r.doc_id, r.k, r.z, STRING_AGG(same, chr(10) ORDER BY s.k) AS run FROM r JOIN s ON s.doc_id = r.doc_id AND s.k BETWEEN r.k AND r.z GROUP BY ALL),
f AS (SELECT run, MIN((doc_id, k)) AS first FROM h GROUP BY run HAVING COUNT(*) > 1),
g AS (SELECT DISTINCT doc_id, UNNEST(range(k, z + 1)) AS k FROM h JOIN f USING (run) WHERE (doc_id, k) <> first),
c AS (SELECT t.doc_id, COUNT(s.k) AS n, COUNT(g.k) AS gone, STRING_AGG(piece, '' ORDER BY t.pos) FILTER (g.k IS NULL) AS kept
      FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND s.pos = t.pos LEFT JOIN g ON g.doc_id = s.doc_id AND g.k = s.k GROUP BY t.doc_id)
SELECT d.doc_id, COALESCE(c.n, 0)::BIGINT AS n_sentences, COALESCE(c.gone, 0)::BIGINT AS n_removed, sha256(COALESCE(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id)
"""
