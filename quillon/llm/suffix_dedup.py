"""Suffix-array dedup: removes every byte of a 100-byte string that also starts earlier.

Strings of 100 bytes that are equal have the same lowest-hashed 32-byte piece (minimizer). Runs of windows that share
one are a segment, and segments are dealt by minimizer, so all equal windows meet in one place, while most minimizers
occur once and are dropped there. Where different segments share a minimizer, their bytes are brought together, their
suffixes are sorted by a difference-cover algorithm, and adjacent 100-byte prefixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import lean, stored, table
from quillon.llm.shingles import bucket_of, dealt

PIECE = 32  # bytes of a minimizer
#: Bytes of text for each bucket, and bytes handled at once inside a task.
BUCKET_BYTES = 16 << 20
CHUNK = 1 << 20
#: Segments of one minimizer beyond which its windows are dealt one by one, by their own hash.
HOT = 2048
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A second multiplier, for a second hash.
OTHER = np.uint64(0xD6E8FEB86659FD93)
LAST = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray, width: int, factor: np.uint64 = ODD) -> np.ndarray:
    """Hashes of all stretches of width bytes, by doubling."""
    total, have, hashes = None, 0, data.astype(np.uint64) + np.uint64(1)
    step = 1
    while True:
        if width & step:
            if total is None:
                total, have = hashes, step
            else:
                # the stretch so far, then the next step bytes
                n = len(data) - have - step + 1
                total = total[:n] * factor + hashes[have : have + n]
                have += step
        step <<= 1
        if step > width:
            return mix(total)
        n = len(hashes) - step // 2
        hashes = hashes[:n] * factor + hashes[step // 2 : step // 2 + n]
        factor = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first of the smallest values of every window; by their upper 38 bits."""
    n = len(values) - width + 1
    places = np.arange(len(values), dtype=np.uint64)
    keyed = (values >> np.uint64(26) << np.uint64(26)) | places
    fill = -len(keyed) % width
    blocks = np.concatenate([keyed, np.full(fill, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (least & np.uint64((1 << 26) - 1)).astype(np.int64)


POWERS = np.concatenate([[np.uint64(1)], np.full(CHUNK * 2, ODD)])
POWERS = np.multiply.accumulate(POWERS)
INVERSE = np.concatenate([[np.uint64(1)], np.full(CHUNK * 2, np.uint64(pow(int(ODD), -1, 1 << 64)))])
INVERSE = np.multiply.accumulate(INVERSE)


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimizer, digest) of the segments of texts data[begins[i]:ends[i]], all of length bytes at least."""
    pieces = rolling(data, PIECE)
    first = sliding_first_min(pieces, length - PIECE + 1)
    valid = np.zeros(len(first) + 1, np.int8)
    np.add.at(valid, begins, 1)
    np.add.at(valid, ends - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    edge = np.ones(len(first), bool)
    edge[1:] = (first[1:] != first[:-1]) | ~valid[:-1]
    edge[begins] = True
    start = np.flatnonzero(valid & edge)
    text = np.searchsorted(begins, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], len(first)), (ends - length + 1)[text])
    windows = stop - start
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(pieces ^ ODD) * POWERS[: len(pieces)], dtype=np.uint64)])
    # the pieces of a segment tell all its bytes; dividing by a power makes its place in data not matter
    upto = start + windows + length - PIECE
    digest = mix((sums[upto] - sums[start]) * INVERSE[start] + windows.astype(np.uint64) * ODD)
    return text, start, windows, mix(pieces[first[start]] + ODD), digest


def in_chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about CHUNK at a time: data, begins, ends, number of the text, offset in it. Long texts come in pieces
    that overlap so that each window is in one of them."""
    parts, begins, ends, which, offset, total = [], [], [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK // 2):
            part = text[at : at + CHUNK // 2 + length - 1]
            if len(part) < length:
                continue
            if total + len(part) > CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), *map(np.array, (begins, ends, which, offset))
                parts, begins, ends, which, offset, total = [], [], [], [], [], 0
            parts.append(part)
            begins.append(total)
            total += len(part)
            ends.append(total)
            which.append(k)
            offset.append(at)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), *map(np.array, (begins, ends, which, offset))


def _b(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _cat(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each bucket that occurs."""
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket, kind="stable")
    for k, part in dealt(bucket[order]):
        yield k, order[part]


def pack_segments(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """kind 0: key is a bucket of minimizers; a minimizers, b digests, c places in d, e offsets, f windows, d nodes and
    ids; of equal segments of one batch only the first is sent. kind 3: key is a bucket of nodes, and the others, which
    are later copies whatever else there is, as MARKS. kind 2: id, node, n_bytes, sha256 of a text; key only spreads
    them. A node is the digest of a text that docs(_id, _text, _node) carry, so copies are one node."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for turn, batch in enumerate(batches):
            raws = [b"" if t is None else t.encode() for t in batch["_text"]]
            nodes, ids = batch["_node"].to_numpy(np.int64).view(np.uint64), batch["_id"].to_numpy(np.int64)
            key = (turn * 31 + np.arange(len(ids))) % buckets
            yield pd.DataFrame({"kind": 2, "key": key, "id": ids, "node": nodes.view(np.int64), "n": [len(x) for x in raws], "sha": [hashlib.sha256(x).hexdigest() for x in raws]}).reindex(columns=COLUMNS)
            least: dict[int, int] = {}
            for k in np.lexsort((ids, nodes)):
                least.setdefault(int(nodes[k]), int(k))
            chosen = np.array([k for k in least.values() if len(raws[k]) >= length], np.int64)
            if not len(chosen):
                continue
            texts = [raws[k] for k in chosen]
            got: list[tuple[np.ndarray, ...]] = []
            for data, begins, ends, which, offset in in_chunks(texts, length):
                text, start, windows, key, digest = segments(data, begins, ends, length)
                got.append((which[text], start - begins[text] + offset[text], windows, key, digest))
            owner, at, windows, key, digest = (np.concatenate(x) for x in zip(*got, strict=True))
            # of equal segments the first by id, text and place; a segment that very many texts have leaves a task once a batch
            order = np.lexsort((at, nodes.view(np.int64)[chosen[owner]], ids[chosen[owner]], digest, key))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
            none = np.zeros(int(again.sum()), np.uint64)
            who = chosen[owner[again]]
            gone = _marks(nodes[who].view(np.int64), ids[who], at[again], windows[again], none, none, buckets)
            yield gone.assign(kind=3, id=0, node=0, n=0, sha=None).reindex(columns=COLUMNS)
            owner, at, windows, key, digest = (x[~again] for x in (owner, at, windows, key, digest))
            rows = []
            for k, part in _by_bucket(key, buckets):
                mine, place = np.unique(owner[part], return_inverse=True)
                who = np.stack([nodes[chosen[mine]].view(np.int64), ids[chosen[mine]]])
                rows.append((0, k, _b(key[part], np.uint64), _b(digest[part], np.uint64), _b(place, np.uint32 if len(mine) > 65535 else np.uint16), who.tobytes(), _b(at[part], np.uint32), _b(windows[part], np.uint8)))
            yield pd.DataFrame(rows, columns=["kind", "key", "a", "b", "c", "d", "e", "f"]).assign(id=0, node=0, n=0, sha=None).reindex(columns=COLUMNS)

    return docs.mapInPandas(lean(pack), SCHEMA)


COLUMNS = ["kind", "key", "a", "b", "c", "d", "e", "f", "id", "node", "n", "sha"]
SCHEMA = "kind int, key int, a binary, b binary, c binary, d binary, e binary, f binary, id long, node long, n long, sha string"
#: key is a bucket of nodes; a nodes, b ids, c offsets, d windows, e keys (0: the windows are to go), f hot.
MARKS = "key int, a binary, b binary, c binary, d binary, e binary, f binary"


def _marks(nodes: np.ndarray, ids: np.ndarray, at: np.ndarray, windows: np.ndarray, keys: np.ndarray, hot: np.ndarray, buckets: int) -> pd.DataFrame:
    rows = [
        (k, _b(nodes[p], np.int64), _b(ids[p], np.int64), _b(at[p], np.uint32), _b(windows[p], np.uint8), _b(keys[p], np.uint64), _b(hot[p], np.uint8))
        for k, p in _by_bucket(nodes.view(np.uint64), buckets)
    ]
    return pd.DataFrame(rows, columns=["key", "a", "b", "c", "d", "e", "f"])


def _compare_segments(buckets: int):
    """Of one bucket of minimizers: later copies of a segment go; first ones that have rivals are to be compared."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        if group["kind"].iloc[0] > 1:
            return group
        return marks(group).assign(kind=0, id=0, node=0, n=0, sha=None).reindex(columns=COLUMNS)

    def marks(group: pd.DataFrame) -> pd.DataFrame:
        key, digest = _cat(group["a"], np.uint64), _cat(group["b"], np.uint64)
        at, windows = _cat(group["e"], np.uint32).astype(np.int64), _cat(group["f"], np.uint8)
        nodes, ids = [], []
        for a, c, d in zip(group["a"], group["c"], group["d"], strict=True):
            who = np.frombuffer(d, np.int64).reshape(2, -1)
            place = np.frombuffer(c, np.uint16 if len(c) * 4 == len(a) else np.uint32)
            nodes.append(who[0][place])
            ids.append(who[1][place])
        node, doc = np.concatenate(nodes), np.concatenate(ids)
        order = np.argsort(key)
        key, digest, at, windows, node, doc = (x[order] for x in (key, digest, at, windows, node, doc))
        same = np.concatenate([[False], key[1:] == key[:-1]])
        keep = same | np.append(same[1:], False)  # most minimizers occur once
        key, digest, at, windows, node, doc = (x[keep] for x in (key, digest, at, windows, node, doc))
        if not len(key):
            return pd.DataFrame(columns=["key", "a", "b", "c", "d", "e", "f"])
        # a text that several tasks met counts once, as its smallest id
        _, place = np.unique(node, return_inverse=True)
        least = np.full(place.max() + 1, LAST)
        np.minimum.at(least, place, doc)
        doc = least[place]
        order = np.lexsort((at, node, doc, digest, key))
        key, digest, at, windows, node, doc = (x[order] for x in (key, digest, at, windows, node, doc))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (at[1:] != at[:-1]) | (digest[1:] != digest[:-1])
        key, digest, at, windows, node, doc = (x[fresh] for x in (key, digest, at, windows, node, doc))
        lead = np.ones(len(key), bool)
        lead[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        group_of = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        rivals = np.bincount(group_of, weights=lead)[group_of]
        keep = ~lead | (rivals > 1)
        keys = np.where(lead, key, np.uint64(0))
        return _marks(node[keep], doc[keep], at[keep], windows[keep], keys[keep], (rivals > HOT)[keep], buckets)

    return compare


#: Suffixes are sorted as numbers that hold their place in the lowest 20 bits, so at most this many at once.
PLACE = 20


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys under 2**43 (ties by place), and the keys in that order."""
    packed = (key << PLACE) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << PLACE) - 1), packed >> PLACE


def named(key: np.ndarray) -> np.ndarray:
    """Ranks of keys; equal keys have equal ranks."""
    order, keys = ordered(key)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    return out


def merged(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key of one, how many of two are smaller; for each of two, how many of one are smaller or equal."""
    order, _ = ordered(np.concatenate([one, two]))
    first = order < len(one)
    before = np.cumsum(first)
    mine, other = np.empty(len(one), np.int64), np.empty(len(two), np.int64)
    mine[order[first]] = np.flatnonzero(first) - before[first] + 1
    other[order[~first] - len(one)] = before[~first]
    return mine, other


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first depth symbols, by the difference cover {1, 2} modulo 3.

    Triples at the sampled places are sorted and named, the string of names is ordered by recursion, and the places
    that are multiples of three are merged in. Names stand for three symbols, so the recursion needs a third of the
    depth and ends when names are distinct or the depth is reached; suffixes that agree that far come in any order.
    At most 2**20 - 8 symbols, each under 2**20.
    """
    n = len(symbols)
    if n < 6:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    text = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(3, np.int64)])
    ones, twos, zeros = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    a, b, c = text[sample], text[sample + 1], text[sample + 2]
    small = int(text.max()) < 1 << 14
    name = named((a << 28) | (b << 14) | c) if small else named((named((a << 21) | b) << 21) | c)
    if depth > 3 and int(name.max()) + 1 < len(sample):
        joined = np.concatenate([name[: len(ones)] + 1, [0], name[len(ones) :] + 1])
        order = suffix_order(joined, -(-depth // 3))
        rank = np.empty(len(joined), np.int64)
        rank[order] = np.arange(len(joined))
        name = np.concatenate([rank[: len(ones)], rank[len(ones) + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1

    place = np.empty(n, np.int64)
    order = sample[ordered(name)[0]]
    place[order] = np.arange(len(order))
    # zeros against ones by a symbol and a rank, against twos by two symbols and a rank
    short = (text[zeros] << 21) | rank[zeros + 1]
    before_ones, zeros_before_ones = merged(short, (text[ones] << 21) | rank[ones + 1])
    pairs = np.concatenate([(text[zeros] << 21) | text[zeros + 1], (text[twos] << 21) | text[twos + 1]])
    pairs = (named(pairs) << 21) | np.concatenate([rank[zeros + 2], rank[twos + 2]])
    before_twos, zeros_before_twos = merged(pairs[: len(zeros)], pairs[len(zeros) :])
    place[ones] += zeros_before_ones
    place[twos] += zeros_before_twos
    order = ordered(short)[0]
    place[zeros[order]] = np.arange(len(zeros))
    place[zeros] += before_ones + before_twos
    return ordered(place)[0]


def repeated(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Of the windows of segments, those whose hash another one has; no equal ones are missed."""
    inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    order, keys = ordered((rolling(data, length)[np.repeat(starts, windows) + inner] >> np.uint64(22)).astype(np.int64))
    same = np.concatenate([[False], keys[1:] == keys[:-1]])
    out = np.zeros(len(order), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def later_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, priority: np.ndarray, length: int) -> np.ndarray:
    """Of the windows of segments (flat, segment after segment), which equal one that comes earlier; priority orders
    the first windows of segments, later windows follow by one each. Equal windows are neighbours in the suffix order."""
    total = int(windows.sum())
    owner = np.repeat(np.arange(len(starts)), windows)
    inner = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(data), -1, np.int64)
    number[starts[owner] + inner] = np.arange(total)
    order = suffix_order(data, length)
    order = order[number[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    run = np.ones(len(order), bool)
    for lo in range(1, len(order), 20_000):
        hi = min(len(order), lo + 20_000)
        run[lo:hi] = (view[order[lo:hi]] != view[order[lo - 1 : hi - 1]]).any(axis=1)
    flat = number[order]
    group = np.cumsum(run) - 1
    best = np.full(int(group[-1]) + 1, LAST)
    rank = priority[owner[flat]] + inner[flat]
    np.minimum.at(best, group, rank)
    late = np.zeros(total, bool)
    late[flat] = rank > best[group]
    return late


def runs(marked: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of marked windows that lie in one segment: first window in it, number of windows, segment."""
    owner = np.repeat(np.arange(len(windows)), windows)
    joined = np.concatenate([[False], marked[1:] & marked[:-1] & (owner[1:] == owner[:-1])])
    first = np.flatnonzero(marked & ~joined)
    last = np.flatnonzero(marked & ~np.append(joined[1:], False))
    return first - (np.cumsum(windows) - windows)[owner[first]], last - first + 1, owner[first]


def _sort_bucket(length: int, buckets: int):
    """Windows to go of one bucket of segments with rivals: rows of a bytes, b windows, c nodes, d ids, e offsets, f
    keys; kind 1 has two hashes of single windows (f and a) of very common minimizers instead of bytes."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        node, doc, at, key = _cat(group["c"], np.int64), _cat(group["d"], np.int64), _cat(group["e"], np.uint32).astype(np.int64), _cat(group["f"], np.uint64)
        order = np.lexsort((at, node, doc))
        # a row that stands twice sends its windows twice, but is one document
        again = np.zeros(len(order), bool)
        again[order[1:]] = (at[order[1:]] == at[order[:-1]]) & (node[order[1:]] == node[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        priority = np.empty(len(order), np.int64)
        priority[order] = np.arange(len(order))
        if group["kind"].iloc[0] == 1:
            node, doc, at, key, priority = (x[~again] for x in (node, doc, at, key, priority))
            other = _cat(group["a"], np.uint64)[~again]
            order = np.lexsort((priority, other, key))
            late = np.zeros(len(order), bool)
            late[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
            return _marks(node[late], doc[late], at[late], np.ones(int(late.sum()), np.uint8), np.zeros(int(late.sum()), np.uint64), np.zeros(int(late.sum()), np.uint8), buckets)
        raw, windows = b"".join(group["a"]), _cat(group["b"], np.uint8).astype(np.int64)
        size = windows + length - 1
        start = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        order = order[~again[order]]
        found = []
        new = np.concatenate([[0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, [len(order)]])
        sums = np.concatenate([[0], np.cumsum(size[order])])
        lo = 0
        while lo < len(new) - 1:  # whole minimizers up to a bounded number of bytes at a time
            hi = max(lo + 1, int(np.searchsorted(sums[new], sums[new[lo]] + CHUNK - 8, side="right")) - 1)
            part = order[new[lo] : new[hi]]
            lo = hi
            pieces = [raw[start[k] : start[k] + size[k]] for k in part.tolist()]
            mine, first, many = part, np.zeros(len(part), np.int64), windows[part]
            # Only stretches of windows whose hash occurs again matter. Of stretches with equal bytes the earliest stays
            # and the others go whole; what stays may then repeat less, so this is done twice before sorting.
            for _ in range(2):
                begin = np.cumsum(many + length - 1) - (many + length - 1)
                inner, n, run = runs(repeated(np.frombuffer(b"".join(pieces), np.uint8), begin, many, length), many)
                pieces = [pieces[o][f : f + m + length - 1] for o, f, m in zip(run.tolist(), inner.tolist(), n.tolist(), strict=True)]
                mine, first, many = mine[run], first[run] + inner, n
                if not len(mine):
                    break
                rank = priority[mine] * 256 + first
                seen: set[bytes] = set()
                stays = np.zeros(len(mine), bool)
                for k in np.argsort(rank).tolist():
                    if pieces[k] not in seen:
                        seen.add(pieces[k])
                        stays[k] = True
                found.append((node[mine[~stays]], doc[mine[~stays]], at[mine[~stays]] + first[~stays], many[~stays]))
                pieces = [p for p, k in zip(pieces, stays.tolist(), strict=True) if k]
                mine, first, many, rank = mine[stays], first[stays], many[stays], rank[stays]
            if len(mine) < 2:
                continue
            begin = np.cumsum(many + length - 1) - (many + length - 1)
            late = later_windows(np.frombuffer(b"".join(pieces), np.uint8), begin, many, rank, length)
            inner, n, run = runs(late, many)
            found.append((node[mine[run]], doc[mine[run]], at[mine[run]] + first[run] + inner, n))
        if not found:
            return pd.DataFrame(columns=["key", "a", "b", "c", "d", "e", "f"])
        node, doc, at, windows = (np.concatenate(x) for x in zip(*found, strict=True))
        none = np.zeros(len(node), np.uint64)
        return _marks(node, doc, at, windows, none, none, buckets)

    return work


def _of_node(group: pd.DataFrame) -> pd.DataFrame:
    """One row for each node of a bucket: id, and arrays of offsets, windows, keys and hot. Of a text that stands under
    several ids the marks of the smallest are complete; copies of it go whole."""
    node, doc, at = _cat(group["a"], np.int64), _cat(group["b"], np.int64), _cat(group["c"], np.uint32).astype(np.int64)
    windows, keys, hot = _cat(group["d"], np.uint8).astype(np.int64), _cat(group["e"], np.uint64), _cat(group["f"], np.uint8)
    order = np.lexsort((at, doc, node))
    node, doc, at, windows, keys, hot = (x[order] for x in (node, doc, at, windows, keys, hot))
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    least = np.repeat(doc[starts], np.diff(np.append(starts, len(node)))) == doc
    node, doc, at, windows, keys, hot = (x[least] for x in (node, doc, at, windows, keys, hot))
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    rows = []
    for lo, hi in zip(starts, [*starts[1:], len(node)], strict=True):
        gone = np.flatnonzero(keys[lo:hi] == 0) + lo
        open_ = np.flatnonzero(keys[lo:hi]) + lo
        rows.append((node[lo], doc[lo:hi].min(), _b(at[gone], np.uint32), _b(windows[gone], np.uint8), _b(at[open_], np.uint32), _b(windows[open_], np.uint8), _b(keys[open_], np.uint64), _b(hot[open_], np.uint8)))
    return pd.DataFrame(rows, columns=["node", "id", "gone_at", "gone_n", "open_at", "open_n", "open_key", "open_hot"])


NODE_MARKS = "node long, id long, gone_at binary, gone_n binary, open_at binary, open_n binary, open_key binary, open_hot binary"


def pack_rivals(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Bytes of the segments that are to be compared, dealt by minimizer; of very common ones, hashes of windows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: list[bytes] = []
            sizes, node, doc, at, key = [], [], [], [], []
            ones: list[tuple[np.ndarray, ...]] = []
            for r in batch.itertuples(index=False):
                raw = r.body.encode()
                offset, n = np.frombuffer(r.open_at, np.uint32), np.frombuffer(r.open_n, np.uint8)
                keys, hot = np.frombuffer(r.open_key, np.uint64), np.frombuffer(r.open_hot, np.uint8)
                for o, w, k, h in zip(offset.tolist(), n.tolist(), keys.tolist(), hot.tolist(), strict=True):
                    piece = raw[o : o + w + length - 1]
                    if h:
                        flat = np.frombuffer(piece, np.uint8)
                        ones.append((rolling(flat, length), rolling(flat, length, OTHER), np.full(w, r.node), np.full(w, r.id), np.arange(o, o + w)))
                    else:
                        parts.append(piece)
                        sizes.append(w)
                        node.append(r.node)
                        doc.append(r.id)
                        at.append(o)
                        key.append(k)
            rows_: list[tuple] = []
            if parts:
                w, nd, dc, off, ky = np.array(sizes), np.array(node, np.int64), np.array(doc, np.int64), np.array(at), np.array(key, np.uint64)
                for k, p in _by_bucket(ky, buckets):
                    rows_.append((0, k, b"".join(parts[i] for i in p), _b(w[p], np.uint8), _b(nd[p], np.int64), _b(dc[p], np.int64), _b(off[p], np.uint32), _b(ky[p], np.uint64)))
            if ones:
                ky, more, nd, dc, off = (np.concatenate(x) for x in zip(*ones, strict=True))
                for k, p in _by_bucket(ky, buckets):
                    rows_.append((1, k, _b(more[p], np.uint64), None, _b(nd[p], np.int64), _b(dc[p], np.int64), _b(off[p], np.uint32), _b(ky[p], np.uint64)))
            yield pd.DataFrame(rows_, columns=["kind", "key", "a", "b", "c", "d", "e", "f"])

    return rows.mapInPandas(lean(pack), "kind int, key int, a binary, b binary, c binary, d binary, e binary, f binary")


def cut_texts(rows: DataFrame, length: int) -> DataFrame:
    """(id, node, n_removed, n_spans, kept, sha) of rows(id, node, body, at, n): windows at at[i] .. at[i]+n[i]-1 go."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                raw = r.body.encode()
                lo = np.concatenate([np.frombuffer(x, np.uint32) for x in r.at]).astype(np.int64)
                hi = lo + np.concatenate([np.frombuffer(x, np.uint8) for x in r.n]) + length - 1
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
                spans = list(zip(lo[fresh].tolist(), hi[np.append(fresh[1:], True)].tolist(), strict=True))
                kept, end = [], 0
                for a, b in spans:
                    kept.append(raw[end:a])
                    end = b
                kept = b"".join([*kept, raw[end:]])
                out.append((r.id, r.node, len(raw) - len(kept), len(spans), kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "node", "n_removed", "n_spans", "kept", "sha"])

    return rows.mapInPandas(lean(cut), "id long, node long, n_removed long, n_spans long, kept string, sha string")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256, text_sha256): the UTF-8 bytes of every text without those covered by a
    string of length bytes that also starts earlier (smaller id, or earlier in the same text).

    kept is what remains as text, without characters that a cut left in part; it is null where nothing was removed, so
    that texts are carried only where they change.
    Null texts are empty; texts under length bytes stay whole. Of equal texts, that of the smallest id stands for all:
    the others are removed whole. Rows with equal id and text are one document and get the same result; a null id
    comes after all others. length is 64 to 250.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # rows are told apart by id and text, so that many rows without an id are no group of their own
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_node"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(max(16, -(-total // BUCKET_BYTES)))
    packed = pack_segments(rows, length, buckets).groupBy("kind", "key").applyInPandas(lean(_compare_segments(buckets)), SCHEMA)
    packed = stored(packed, "suffix-compared")
    marks = packed.where("kind <> 2").select("key", "a", "b", "c", "d", "e", "f")
    marks = stored(marks.groupBy("key").applyInPandas(lean(_of_node), NODE_MARKS), "suffix-marks")

    texts = rows.select(F.col("_id").alias("id"), F.col("_node").alias("node"), F.col("_text").alias("body")).where("body is not null")
    rivals = marks.where(F.length("open_at") > 0).select("node", "id", "open_at", "open_n", "open_key", "open_hot")
    dealt = pack_rivals(texts.join(rivals, ["id", "node"]), length, buckets)
    more = dealt.groupBy("kind", "key").applyInPandas(lean(_sort_bucket(length, buckets)), MARKS)
    more = more.groupBy("key").applyInPandas(lean(_of_node), NODE_MARKS)
    gone = marks.unionByName(more).where(F.length("gone_at") > 0)
    gone = gone.groupBy("node", "id").agg(F.collect_list("gone_at").alias("at"), F.collect_list("gone_n").alias("n"))
    gone = stored(gone, "suffix-gone")
    cuts = stored(cut_texts(texts.join(gone, ["id", "node"]), length), "suffix-cuts").dropDuplicates(["id", "node"])

    whole = packed.where("kind = 2").select("id", "node", "n", "sha")
    least = whole.groupBy("sha").agg(F.min("id").alias("first"))
    joined = whole.join(least, "sha").join(cuts.withColumnRenamed("sha", "cut_sha"), ["id", "node"], "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n") >= length)
    return joined.select(
        F.when(F.col("id") != LAST, F.col("id")).cast(kind).alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.col("sha").alias("text_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(hex(encode(text)), '') AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 200) AS s FROM (SELECT doc_id, h, UNNEST(range(0, n - 99)) AS k FROM n WHERE n >= 100)),
f AS (SELECT s, MIN((doc_id, k)) AS first FROM w GROUP BY s HAVING COUNT(*) > 1),
g AS (SELECT doc_id, k FROM w JOIN f USING (s) WHERE (doc_id, k) <> first),
e AS (SELECT doc_id, k, k + 100 AS e, MAX(k + 100) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
r AS (SELECT doc_id, k, e, SUM(CASE WHEN before IS NULL OR k > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM e),
x AS (SELECT doc_id, span, MIN(k) AS lo, MAX(e) AS hi FROM r GROUP BY doc_id, span),
y AS (SELECT *, COALESCE(LAG(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM x),
z AS (SELECT n.doc_id, STRING_AGG(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) || substr(ANY_VALUE(h), 2 * MAX(hi) + 1) AS kept, COUNT(*) AS spans FROM y JOIN n USING (doc_id) GROUP BY n.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, (n.n - length(COALESCE(z.kept, n.h)) // 2)::BIGINT AS n_removed,
       COALESCE(z.spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(z.kept, n.h))) AS kept_sha256
FROM n LEFT JOIN z USING (doc_id)
"""
