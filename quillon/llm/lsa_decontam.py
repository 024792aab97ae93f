"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF rows over the benchmark's words. One pass makes a randomised sketch of their
Gram matrix, from which the leading right singular vectors follow (Nystrom). Candidates are the pairs of a passage and
a benchmark item whose cosine in the space of the singular vectors is high enough. Cosines are taken only where the
passage has enough of the item's rarest words for the wanted common subsequence, which loses no pair that the next check
would keep. Candidates then pass a longest-common-subsequence and an answer check.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import lean, stored, table
from quillon.llm.toxicity_ftrl import CLEAN

#: A passage is PARTS neighbouring stretches of STEP words.
STEP = 20
PARTS = 3
SKETCH, RANK = 96, 80
#: Benchmark items that are searched for in one go; more are taken in blocks.
BLOCK_ITEMS = 4096
#: So many of the commonest words are counted in a dense table, which is quicker than one by one.
DENSE = 256
LCS, ANSWER, SURE = 0.6, 0.5, 0.85
#: Least cosine of a candidate.
COSINE = 0.2
#: Arrays that one task adds up.
FAN = 8
SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(CLEAN).split()


def answer_of(text: str) -> list[bytes]:
    """Words that an item ends with: its last sentence of three words or more, else its last five words."""
    for part in reversed(SENTENCE.findall(text)):
        if len(found := words_of(part)) >= 3:
            return found
    return words_of(text)[-5:]


def numbered(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Places of words in the vocabulary, -1 for others."""
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


def common_length(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits of one number."""
    places: dict[int, int] = {}
    for k, w in enumerate(one.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(one)) - 1
    row = full
    for w in two.tolist():
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(one) - row.bit_count()


def stretches(columns: Iterable[bytes], limit: int = 300_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in groups of bounded size: their rows, words, stretch of each word, first stretch of each document."""
    rows, parts, first, blocks, n = [], [], [], [], 0
    total = 0
    for k, raw in enumerate(columns):
        ids = np.frombuffer(raw, np.int32)
        if not len(ids):
            continue
        rows.append(k)
        parts.append(ids)
        first.append(n)
        blocks.append(n + np.arange(len(ids)) // STEP)
        n = int(blocks[-1][-1]) + 1
        total += len(ids)
        if total >= limit:
            yield rows, np.concatenate(parts), np.concatenate(blocks), np.array([*first, n])
            rows, parts, first, blocks, n, total = [], [], [], [], 0, 0
    if rows:
        yield rows, np.concatenate(parts), np.concatenate(blocks), np.array([*first, n])


def passage_sums(vectors: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row k: the sum over the passage that begins at stretch k (shorter at the end of a document)."""
    ends = np.repeat(first[1:], np.diff(first))
    out = vectors.copy()
    for j in range(1, PARTS):
        at = np.arange(len(vectors)) + j
        fine = at < ends
        out[fine] += vectors[at[fine]]
    return out


def block_sums(term: np.ndarray, block: np.ndarray, n: int, matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Sums of the matrix' rows over the words of each stretch; column as made by dense_columns."""
    at = column[term]
    many = at >= 0
    width = int(column.max()) + 1
    out = dense_counts(at[many], block[many], n, width) @ matrix[np.argsort(column)[len(column) - width :]]
    term, block = term[~many], block[~many]
    if len(term):
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[block[starts]] += np.add.reduceat(matrix[term], starts)
    return out


def dense_columns(df: np.ndarray) -> np.ndarray:
    """Column of each of the DENSE commonest words in a dense table, -1 for others."""
    out = np.full(len(df), -1)
    common = np.argsort(df, kind="stable")[::-1][:DENSE]
    out[common] = np.arange(len(common))
    return out


def dense_counts(at: np.ndarray, block: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(block * width + at, minlength=n * width).reshape(n, width).astype(np.float32)


def stretch_counts(words: Iterable[bytes], size: int) -> tuple[np.ndarray, int]:
    """Number of stretches that have each word of the vocabulary, and of all stretches."""
    df, total = np.zeros(size, np.int64), 0
    for _, term, block, first in stretches(words):
        seen = np.unique(block[term >= 0] * size + term[term >= 0])
        df += np.bincount(seen % size, minlength=size)
        total += int(first[-1])
    return df, total


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(_id, _words, _df, _n): words of a text as places in the vocabulary; rows without words carry counts of stretches by
    word instead, one for each batch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [numbered(words_of(t), vocabulary).tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "_words": words, "_df": None, "_n": 0})
            df, total = stretch_counts(words, len(vocabulary))
            yield pd.DataFrame({"_id": [None], "_words": [None], "_df": [df.tobytes()], "_n": [total]})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(lean(run), f"_id {kind}, _words binary, _df binary, _n long")


def summed(rows: DataFrame, column: str, dtype: type, fan: int = FAN) -> tuple[np.ndarray | None, int]:
    """Sum of equally long arrays (binary column) and of _n, in a tree: a task adds up what it has, then fan partitions
    become one, until at most fan arrays are left."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            n += int(batch["_n"].sum())
            for x in batch[column]:
                part = np.frombuffer(x, dtype)
                total = part.copy() if total is None else np.add(total, part, out=total)
        if total is not None:
            yield pd.DataFrame({column: [total.tobytes()], "_n": [n]})

    parts = rows.rdd.getNumPartitions()
    some = rows.select(column, "_n").mapInPandas(add, f"{column} binary, _n long")
    while parts > fan:
        parts = -(-parts // fan)
        some = some.repartition(parts).mapInPandas(add, f"{column} binary, _n long")
    found = some.collect()
    if not found:
        return None, 0
    return sum(np.frombuffer(r[0], dtype) for r in found), sum(r[1] for r in found)


def singular_vectors(words: DataFrame, weight: np.ndarray, column: np.ndarray, sketch: int = SKETCH, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix, columns, from one pass over all passages."""
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(weight), min(sketch, len(weight)))))[0].astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scaled = omega * weight[:, None]
        common = np.argsort(column)[len(column) - int(column.max()) - 1 :]
        total = np.zeros(omega.shape, np.float64)
        for batch in batches:
            for _, term, block, first in stretches(batch["_words"]):
                keep = term >= 0
                term, block = term[keep], block[keep]
                sums = passage_sums(block_sums(term, block, int(first[-1]), scaled, column), first)
                # a stretch is in the passages that begin at it and up to PARTS - 1 before it
                starts = np.repeat(first[:-1], np.diff(first))
                back = sums.copy()
                for j in range(1, PARTS):
                    at = np.arange(len(sums)) - j
                    fine = at >= starts
                    back[fine] += sums[at[fine]]
                at = column[term]
                many = at >= 0
                total[common] += (dense_counts(at[many], block[many], len(back), len(common)).T @ back) * weight[common, None]
                term, block = term[~many], block[~many]
                order = np.argsort(term, kind="stable")
                term, block = term[order], block[order]
                if len(term):
                    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                    total[term[begin]] += np.add.reduceat(back[block], begin) * weight[term[begin], None]
        yield pd.DataFrame({"_z": [total.tobytes()], "_n": [0]})

    flat, _ = summed(words.select("_words").mapInPandas(lean(run), "_z binary, _n long"), "_z", np.float64)
    z = np.zeros(omega.shape) if flat is None else flat.reshape(omega.shape)
    shift = max(1e-9, 1e-7 * float(np.linalg.norm(z)))
    z = z + shift * omega
    core = omega.T.astype(np.float64) @ z
    root = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(len(core)))
    left, _, _ = np.linalg.svd(np.linalg.solve(root, z.T).T, full_matrices=False)
    return left[:, : min(rank, left.shape[1])].astype(np.float32)


class Postings:
    """Of each item the rarest words, and how many of them any text must have that shares `lcs` of the item's words.

    An item of n words of which `need` are wanted misses n - need at most, so of any n - need + t of its words t are
    there. The rarest ones are taken, which few passages have."""

    def __init__(self, terms: list[np.ndarray], df: np.ndarray, lcs: float):
        self.least = np.empty(len(terms), np.int64)
        found = []
        for q, term in enumerate(terms):
            need = min(len(term), max(1, int(np.ceil(lcs * len(term) - 1e-9))))
            self.least[q] = max(1, need // 3)
            rare = term[np.lexsort((term, df[term]))][: len(term) - need + self.least[q]]
            word, times = np.unique(rare, return_counts=True)
            found.append(np.stack([word, np.full(len(word), q), times]))
        word, self.item, self.times = (x := np.concatenate(found, axis=1))[:, np.argsort(x[0], kind="stable")]
        self.begin = np.searchsorted(word, np.arange(len(df) + 1))

    def pairs(self, term: np.ndarray, block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages (by first stretch) and items that may match, within the stretches around the passage."""
        some = np.unique(block * len(self.begin) + term)
        block, term = some // len(self.begin), some % len(self.begin)
        count = self.begin[term + 1] - self.begin[term]
        at = np.repeat(self.begin[term] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        code, place = np.unique(np.repeat(block, count) * len(self.least) + self.item[at], return_inverse=True)
        hits = np.bincount(place, weights=self.times[at], minlength=len(code))
        block, item = code // len(self.least), code % len(self.least)
        doc = np.searchsorted(first, block, side="right") - 1
        codes, counts = [], []
        for back in range(-1, PARTS + 1):
            fine = (block - back >= first[doc]) & (block - back < first[doc + 1])
            codes.append((block[fine] - back) * len(self.least) + item[fine])
            counts.append(hits[fine])
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        code = code[np.bincount(place, weights=np.concatenate(counts), minlength=len(code)) >= self.least[code % len(self.least)]]
        return code // len(self.least), code % len(self.least)


def search(words: DataFrame, items: list[tuple[object, np.ndarray, np.ndarray]], item_kind: str, weight: np.ndarray, df: np.ndarray, basis: np.ndarray, id_kind: str, lcs: float, answer: float, cosine: float) -> DataFrame:
    scaled = basis * weight[:, None]
    column = dense_columns(df)
    # a piece of an item: the item, its place there, its number of words
    pieces = [(q, int(x[0]), len(x)) for q, (_, w, _) in enumerate(items) for x in np.array_split(np.arange(len(w)), -(-len(w) // (PARTS * STEP)))]
    terms = [items[q][1][a : a + n] for q, a, n in pieces]
    queries = np.stack([scaled[t].sum(0) for t in terms])
    queries = (queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    postings = Postings(terms, df, lcs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = [w.tolist() for _, w, _ in items]
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for rows, ids, block, first in stretches(batch["_words"], max(20_000, min(300_000, 100_000_000 // len(pieces)))):
                term = ids
                rare = np.flatnonzero(term >= 0)
                rare = rare[postings.begin[term[rare] + 1] > postings.begin[term[rare]]]
                at_block, at_item = postings.pairs(term[rare], block[rare], first)
                # only the stretches of passages that are compared are summed up
                wanted = np.zeros(int(first[-1]) + PARTS, bool)
                for k in range(PARTS):
                    wanted[at_block + k] = True
                keep = (term >= 0) & wanted[block]
                sums = passage_sums(block_sums(term[keep], block[keep], int(first[-1]), scaled, column), first)
                sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
                begins = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(ids)]])
                near = np.concatenate([np.zeros(0, np.float32), *[np.einsum("ij,ij->i", sums[at_block[k : k + 100_000]], queries[at_item[k : k + 100_000]]) for k in range(0, len(at_block), 100_000)]])
                last, there, tried = None, set(), {}
                for k in np.flatnonzero(near >= cosine).tolist():
                    at, (q, before, size) = int(at_block[k]), pieces[at_item[k]]
                    doc = int(np.searchsorted(first, at, side="right")) - 1
                    item, want, end = items[q]
                    # around the piece, what the rest of the item may take up where words are put between its own
                    ahead, behind = int(before / lcs), int((len(want) - before - size) / lcs)
                    lo = max(begins[first[doc]], begins[at] - STEP - ahead)
                    hi = min(begins[first[doc + 1]], begins[min(at + PARTS, first[doc + 1])] + STEP + behind)
                    if size < len(want):
                        if any(a <= lo and hi <= b for a, b in tried.get((doc, q), ())):
                            continue  # nothing was found in more words than these
                        if (rows[doc], q) in best and best[rows[doc], q][0] == 1.0:
                            continue
                    region = ids[lo:hi]
                    if last != (lo, hi):
                        last, there = (lo, hi), set(region.tolist())
                    if sum(map(there.__contains__, listed[q])) < lcs * len(want):
                        tried.setdefault((doc, q), []).append((lo, hi))
                        continue  # no common subsequence is longer than the words that both have
                    share = common_length(want, region) / len(want)
                    if share < lcs:
                        tried.setdefault((doc, q), []).append((lo, hi))
                        continue
                    said = float(np.isin(end, region).mean())
                    if said < answer and share < SURE:
                        continue
                    found = (share, said, float(near[k]), int(begins[at] - begins[first[doc]]))
                    key = (rows[doc], q)
                    if found > best.get(key, (0.0,)):
                        best[key] = found
            yield pd.DataFrame(
                [(batch["_id"].iat[r], items[q][0], c, s, a, w) for (r, q), (s, a, c, w) in best.items()],
                columns=["_id", "item_id", "cosine", "lcs_share", "answer_share", "at_word"],
            )

    return words.select("_id", "_words").mapInPandas(lean(run), f"_id {id_kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double, at_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", lcs: float = LCS, answer: float = ANSWER, cosine: float = COSINE) -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_share, at_word): a row for each document and benchmark item that a
    passage of it repeats or paraphrases, with the passage's place.

    A candidate (cosine at least `cosine`) counts when the longest common subsequence holds `lcs` of the item's words and its surroundings
    `answer` of the words of the item's last sentence, or SURE of the item's words alone. Null and empty texts match
    nothing, on either side; items longer than a passage are looked for in pieces of a passage's length and compared as
    a whole with len(item) / lcs words and more around a piece that is found; repeated rows are judged alike; an empty benchmark gives no rows; other columns are left
    behind. Items are searched for in blocks of BLOCK_ITEMS, each in its own passes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    wanted = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).distinct()
    count = wanted.count()
    out = None
    for turn in range(-(-count // BLOCK_ITEMS)):
        part = wanted if count <= BLOCK_ITEMS else wanted.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(-(-count // BLOCK_ITEMS))) == turn)
        said = [(r[0], words_of(r[1]), answer_of(r[1])) for r in part.orderBy("_item", "_text").collect()]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in said for w in ws}))}
        items = [(q, numbered(ws, vocabulary), numbered(end, vocabulary)) for q, ws, end in said if ws]
        if not items:
            continue
        words = stored(tokenised(docs, id_col, text_col, vocabulary), "lsa-words")
        df, total = summed(words.where("_df is not null"), "_df", np.int64)
        if df is None or not total:
            continue
        # every word keeps a weight, the commonest, too: a passage that leaks often makes its own words common
        weight = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
        weight /= weight.max()
        texts = words.where("_words is not null")
        basis = singular_vectors(texts, weight, dense_columns(df))
        found = search(texts, items, item_kind, weight, df, basis, kind, lcs, answer, cosine)
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = f"_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double, at_word long"
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col)


def op1_lsa_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
