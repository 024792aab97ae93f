"""Aligning the tokens of two tokenizers, with corpus-wide counts of linked id pairs by external spill counting.

A task encodes texts in batches. Tokens of A and B whose byte ranges overlap are linked; each batch leaves a run of its
pair-document records, sorted with the A side first and cut by radix of the A id into zstd blobs: a head (pairs, and how
many documents of the batch hold each) and a body (which documents, how often). Heads of one radix part are merged with a
heap, at most about FAN at a time and in rounds, so counting moves pairs and not records, and a pair of every document
is one entry of each run. As all pairs of an A id follow each other, its highest count is known when they end. Then each
run is read once more beside the counts of its part, and what every link adds goes back to its document.

No task holds more than some runs of one part and that part's distinct pairs; a text is held as a whole, with its tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import stored, table

VOCABULARIES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model"
#: Bytes of text in a run, and those that are given to a tokenizer at a time.
RUN_BYTES, ENCODE_BYTES = 2 << 20, 1 << 19
PARTS = 16
FAN = 64
#: Characters up to which the quick encoder, which goes back over long white space, is used.
LONG = 1 << 19
#: Fixed value: how byte-level vocabularies split a text before they merge.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a head that a merge unpacks at a time, for each run.
CHUNK = 1 << 13

DOC = pa.schema(
    [("run", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("doc_id", pa.string())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("head", pa.binary()), ("body", pa.binary())]
)
DOC_SQL = "run long, place long, part int, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, head binary, body binary"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, entries: list[bytes], ends: tuple[str, str]):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], np.int64)
        #: How an id is written, inside a group and at its end.
        self.written = [f"{k}{end}".encode() for k in range(len(entries)) for end in ends]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


def plain_ranks(path: str) -> dict[bytes, int] | None:
    """The byte strings of a byte-level vocabulary by id, where merging pairs by the id that they become is all that its
    file asks for: then ranks alone encode. None otherwise."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, splits = said["model"], said["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and said["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
    if not plain or model.get("dropout") or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    vocabulary, letters = model["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    became = [vocabulary["".join(m)] for m in pairs]
    if became != sorted(set(became)):
        return None
    special = {t["content"] for t in said["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): k for t, k in vocabulary.items() if t not in special}
    return ranks if len(ranks) == 256 + len(pairs) else None


class ByteSide(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, vocabulary = byte_letters(), self.model.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            entries[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        ranks = plain_ranks(path)
        self.quick = None if ranks is None else tiktoken.Encoding("ranks", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})
        super().__init__(entries, (",", "|"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        given = [" " + t for t in texts]
        if self.quick is not None and max(map(len, given), default=0) <= LONG:
            return [self.quick.encode_ordinary(t) for t in given]
        return [e.ids for e in self.model.encode_batch_fast(given, add_special_tokens=False)]


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(self.model.get_piece_size())
        entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k in pieces for p in [self.model.id_to_piece(k)]]
        super().__init__(entries, (",", ";"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def sides(byte_bpe: str, piece_bpe: str) -> tuple[Side, Side]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteSide(byte_bpe), PieceSide(piece_bpe)


# --- runs --------------------------------------------------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def pack_head(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Interleaved (step from the key before, count), so that a head can be read from the front."""
    return packed(np.stack([np.diff(keys, prepend=0), counts.astype(np.int64)], 1))


def unpack_head(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = unpacked(blob, np.int64)[0].reshape(-1, 2)
    return np.cumsum(pairs[:, 0]), pairs[:, 1]


def stream_head(blob: bytes) -> Iterator[tuple[int, int]]:
    """(key, count) of a head, unpacked in chunks."""
    key = 0
    with zstandard.ZstdDecompressor().stream_reader(blob) as reader:
        while raw := reader.read(16 * CHUNK):
            while len(raw) % 16:
                raw += reader.read(16 - len(raw) % 16)
            pairs = np.frombuffer(raw, np.int64).reshape(-1, 2)
            keys = np.cumsum(pairs[:, 0]) + key
            key = int(keys[-1])
            yield from zip(keys.tolist(), pairs[:, 1].tolist())


def align(texts: list[str], a: Side, b: Side, parts: int) -> tuple[dict[str, list], list[tuple[int, bytes, bytes]]]:
    """Figures of each text in order, and the run of all: (part, head, body). Texts that an encoding does not give back
    have none."""
    figures = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups_sha256": [""] * len(texts)}
    places, ids_a, ids_b, size = [], [], [], []
    begin = 0
    while begin < len(texts):
        end, held = begin, 0
        while end < len(texts) and (end == begin or held < ENCODE_BYTES):
            held += len(texts[end])
            end += 1
        some = [k for k in range(begin, end) if texts[k]]
        given = [texts[k] for k in some]
        for k, text, x, y in zip(some, given, a.encode(given), b.encode(given)):
            whole = b" " + text.encode()
            if a.bytes_of(x) == whole == b.bytes_of(y):
                places.append(k)
                ids_a.append(np.array(x, np.int64))
                ids_b.append(np.array(y, np.int64))
                size.append(len(whole))
        begin = end
    if not places:
        return figures, []
    n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
    ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
    # all texts lie one after the other, so each of them ends where a token of both does
    text_ends = np.cumsum(size)
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted halves are merged
    again = np.append(ends[1:] == ends[:-1], False)
    shared, cuts = ends[again], ends[~again]  # between two cuts lies one token of each, and every link has one such place
    link_a, link_b = ids_a[np.searchsorted(ends_a, cuts)], ids_b[np.searchsorted(ends_b, cuts)]
    link_text = np.searchsorted(text_ends, cuts)
    n_groups = np.bincount(np.searchsorted(text_ends, shared), minlength=len(places))
    n_links = np.bincount(link_text, minlength=len(places))

    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    last_a, last_b = shared[group_a] == ends_a, shared[group_b] == ends_b
    written = np.concatenate([2 * ids_a + last_a, 2 * (len(a.entries) + ids_b) + last_b])
    written = written[np.argsort(np.concatenate([group_a, group_b]), kind="stable")].tolist()
    words, at = [*a.written, *b.written], 0
    for k, p in enumerate(places):
        upto = at + int(n_a[k] + n_b[k])
        text = b"".join(map(words.__getitem__, written[at:upto]))[:-1]
        figures["groups_sha256"][p] = hashlib.sha256(text).hexdigest()
        at = upto
    for c, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
        for p, v in zip(places, values.tolist()):
            figures[c][p] = v

    records = ((link_a * len(b.entries) + link_b) * len(places)) + link_text
    records, times = np.unique(records, return_counts=True)
    keys, holders = records // len(places), np.array(places)[records % len(places)]
    part = keys // len(b.entries) % parts
    run = []
    for p in range(parts):
        own = part == p
        if own.any():
            pairs, counts = np.unique(keys[own], return_counts=True)
            run.append((p, pack_head(pairs, counts), packed(holders[own].astype(np.uint32), times[own].astype(np.uint32))))
    return figures, run


def _encode(batches: Iterator[pa.RecordBatch], byte_bpe: str, piece_bpe: str, parts: int) -> Iterator[pa.RecordBatch]:
    a, b = sides(byte_bpe, piece_bpe)
    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        begin = 0
        while begin < batch.num_rows:
            held, some = 0, []
            while begin + len(some) < batch.num_rows and held < RUN_BYTES:
                raw = texts[begin + len(some)].as_py() or b""
                held += len(raw)
                try:
                    some.append(raw.decode())
                except UnicodeDecodeError:
                    some.append("")
            figures, blobs = align(some, a, b, parts)
            n, m = len(some), len(blobs)
            empty = [None] * m
            yield pa.RecordBatch.from_pydict(
                {
                    "run": [run] * (n + m),
                    "place": [*range(n), *empty],
                    "part": [*[None] * n, *[p for p, _, _ in blobs]],
                    "doc_id": [*ids.slice(begin, n).to_pylist(), *empty],
                    **{c: [*v, *empty] for c, v in figures.items()},
                    "head": [*[None] * n, *[h for _, h, _ in blobs]],
                    "body": [*[None] * n, *[x for _, _, x in blobs]],
                },
                DOC,
            )
            run += 1
            begin += n


# --- counts ------------------------------------------------------------------------------------------------------


def merged(heads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all heads in order with their counts added up, by a heap over streams."""
    keys, counts = array("q"), array("q")
    last = -1
    for key, count in heapq.merge(*map(stream_head, heads)):
        if key == last:
            counts[-1] += count
        else:
            keys.append(key)
            counts.append(count)
            last = key
    return np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)


def _merge(runs: pd.DataFrame) -> pd.DataFrame:
    first = runs.iloc[0]
    return pd.DataFrame({"part": [first["part"]], "run": [int(first["batch"])], "head": [pack_head(*merged(list(runs["head"])))]})


def count_pairs(heads: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """(part, head): one head for each part, of heads(part, run, head) of n_runs runs."""
    while True:
        batches = max(1, -(-n_runs // fan))
        dealt = heads.withColumn("batch", F.pmod(F.xxhash64("run"), F.lit(batches)))
        heads = stored(dealt.groupBy("part", "batch").applyInPandas(_merge, "part int, run long, head binary"), "align-counts")
        if batches == 1:
            return heads.select("part", "head")
        n_runs = batches


def _given_back(runs: pd.DataFrame, whole: pd.DataFrame, others: int) -> pd.DataFrame:
    """What the links of each document of the runs add: their counts, and how many have the highest count of their A id."""
    pairs, counts = unpack_head(whole["head"].iloc[0])
    side = pairs // others
    starts = np.flatnonzero(np.diff(side, prepend=-1))
    highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(side)))
    out = []
    for run, head, body in zip(runs["run"], runs["head"], runs["body"]):
        keys, holding = unpack_head(head)
        at = np.searchsorted(pairs, keys)
        holders, times = unpacked(body, np.uint32, np.uint32)
        times = times.astype(np.int64)
        total, best = np.zeros((2, int(holders.max()) + 1), np.int64)
        np.add.at(total, holders, times * np.repeat(counts[at], holding))
        np.add.at(best, holders, times * np.repeat(counts[at] == highest[at], holding))
        places = np.flatnonzero(total)
        out.append(pd.DataFrame({"run": run, "place": places, "n_best": best[places], "count_sum": total[places]}))
    return pd.concat(out)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, parts: int = PARTS, fan: int = FAN) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    A is a byte-level BPE that encodes space and text, B a piece model that adds the space. A row is a document, also
    where it repeats another one or has no id. Null and empty texts, and those that either encoding does not give back,
    have zeros and ''. Whole texts are encoded, however long; empty tables give no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    rows = stored(given.mapInArrow(lambda batches: _encode(batches, byte_bpe, piece_bpe, parts), DOC_SQL), "align-runs")
    runs = rows.where("part is not null")
    n_runs = runs.select("run").distinct().count()
    batches = max(1, -(-n_runs // fan))
    whole = count_pairs(runs.select("part", "run", "head"), n_runs, fan)
    # each batch of runs of a part gets the part's counts
    beside = whole.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    dealt = runs.select("part", "run", "head", "body").withColumn("batch", F.pmod(F.xxhash64("run"), F.lit(batches)))
    others = len(sides(byte_bpe, piece_bpe)[1].entries)
    both = dealt.groupBy("part", "batch").cogroup(beside.groupBy("part", "batch"))
    back = both.applyInPandas(lambda r, w: _given_back(r, w, others) if len(r) else pd.DataFrame(), "run long, place long, n_best long, count_sum long")
    back = back.groupBy("run", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = rows.where("part is null").select("run", "place", F.col("doc_id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return figures.join(back, ["run", "place"], "left").drop("run", "place").fillna(0, ["n_best", "count_sum"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
