"""Operators with an exact answer against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm.gif_media import decode_gif, encode_gif, gif_column, gif_frames, lzw_pack, lzw_unpack, media_digest, padded
from quillon.llm.ngram_join import jaccard_components
from quillon.llm.sentence_spans import sentence_spans
from quillon.llm.source_mix import mix_sources
from quillon.llm.suffix_dedup import suffix_dedup, suffix_order

BIG = 1 << 62


def test_source_mix(docs, empty):
    got = mix_sources(docs).collect()
    assert len(got) == docs.count() and mix_sources(empty).count() == 0
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) if t else 0
    total, taken, target = {}, {}, {}
    for r in got:
        assert r["mix_size"] == size(r["text"]) and r["mix_taken"] <= 2 * r["mix_size"] and r["size"] == "a"
        total[r["source"]] = total.get(r["source"], 0) + r["mix_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_taken"]
        target[r["source"]] = r["mix_target"]
    assert all(r["mix_source_size"] == total[r["source"]] for r in got)
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6
    most = max(r["mix_size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= most and target[s] <= 2 * total[s] + 1e-9 for s in total)
    again = mix_sources(docs.repartition(1)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["mix_taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_ngram_join(docs, empty):
    got = jaccard_components(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if find(j) == find(i) and rows[j]["doc_id"] is not None]
        own = r["doc_id"]
        want.append((str(own), len(sets[i]), str(min(ids) if ids and sets[i] else own)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(want)
    assert jaccard_components(empty).count() == 0


def test_suffix_dedup(docs, empty):
    got = suffix_dedup(docs).collect()
    rows = [(BIG if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for i, raw in sorted(set(rows)):
        for k in range(len(raw) - 99):
            first.setdefault(raw[k : k + 100], (i, raw, k))
    want = []
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if first[raw[k : k + 100]] != (i, raw, k):
                gone[k : k + 100] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((BIG if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert suffix_dedup(empty).count() == 0


def test_suffix_order_is_the_sorted_one():
    rng = np.random.default_rng(0)
    for n, a in ((1, 2), (7, 1), (300, 3), (2000, 2)):
        x = rng.integers(0, a, n)
        assert suffix_order(x, 10**6).tolist() == sorted(range(n), key=lambda i, x=x: x[i:].tolist())


def test_sentence_spans(docs, empty):
    got = sentence_spans(docs).collect()
    assert len(got) == docs.count() and sentence_spans(empty).count() == 0
    assert all(r["kept_text"] == (r["text"] or "") for r in got if not r["n_removed"])
    text = "One two. Three four! Five six? Seven."
    df = docs.sparkSession.createDataFrame([(1, text), (2, "New here. " + text + " And more."), (3, None), (4, "One two.")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in sentence_spans(df, width=3, words=0).collect()}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == 4 and by[2]["kept_text"] == "New here. And more." and by[4]["n_removed"] == 0


def brute_spans(rows, width, words):
    """kept text by (id, text): runs compared as words, in the order of ids and of the digests of texts."""
    parsed, first = {}, {}
    for i, node, t in sorted(set(rows)):
        pieces = re.findall(r"[^.!?,;:\n]+[.!?,;:\n]*|[.!?,;:\n]+", t)
        spoken = [k for k, p in enumerate(pieces) if p.split()]
        said = [tuple(re.findall(r"[^\x20\x09-\x0D]+", pieces[k].lower())) for k in spoken]
        parsed[i, t] = pieces, spoken, []
        for a in range(len(said)):
            z = next((z for z in range(a + width, len(said) + 1) if sum(map(len, said[a:z])) >= words), None)
            if z and first.setdefault(tuple(said[a:z]), (i, node, a)) != (i, node, a):
                parsed[i, t][2].extend(range(a, z))
    return {k: ("".join(p for n, p in enumerate(ps) if n not in {sp[g] for g in gone}), len(set(gone)), len(sp)) for k, (ps, sp, gone) in parsed.items()}


def test_sentence_spans_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("stone river light cold Green walk under paper seven Ridge".split()) + str(rng.randrange(4))
    said = lambda n: "".join(" ".join(word() for _ in range(rng.choice([1, 1, 2, 5, 9]))) + rng.choice([". ", ", ", "! ", ";\n"]) for _ in range(n))
    passages = [said(9) for _ in range(6)]
    rows = []
    for k in range(90):
        text = said(rng.randrange(1, 12)) + rng.choice(passages)[rng.randrange(0, 40) :] + said(rng.randrange(0, 9))
        rows.append((None if k % 7 == 0 else k % 60, text))
    rows += [(3, rows[3][1]), (None, rows[0][1]), (70, rows[5][1]), (71, "Yes. Yes. Yes. Yes. " * 9), (72, ""), (73, None), (74, " \n.. "), (75, said(4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = {r["text"]: r["n"] for r in df.selectExpr("text", "xxhash64(text) n").collect()}
    for width, words in ((2, 12), (3, 0)):
        want = brute_spans([(BIG if i is None else i, nodes[t], t or "") for i, t in rows], width, words)
        got = sentence_spans(df, width=width, words=words).collect()
        assert len(got) == len(rows)
        for r in got:
            key = (BIG if r["doc_id"] is None else r["doc_id"], r["text"] or "")
            assert (r["kept_text"], r["n_removed"], r["n_sentences"]) == want[key]


def test_gif_round_trip(docs, empty):
    media = gif_column(docs)
    got = media_digest(media).collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        p = padded((r["text"] or "").encode())
        want.setdefault(r["doc_id"], []).append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in got:
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
    assert len(got) == docs.count() and media_digest(gif_column(empty)).count() == 0
    frames = gif_frames(media).collect()
    assert all(sum(f["histogram"]) == len(f["rgb"]) // 3 for f in frames)


def test_gif_without_media(spark):
    df = spark.createDataFrame([(1, 4, None), (None, None, None)], "doc_id long, n_bytes long, media binary")
    got = media_digest(df).orderBy("doc_id").collect()
    assert len(got) == 2 and all(r["media_sha256"] is None and r["payload_bytes"] is None for r in got) and gif_frames(df).count() == 0


def test_gif_local_palettes_interlace_and_restored_background():
    pixels = lambda *v: b"\x02" + bytes([len(x := lzw_pack(bytes(v), 2))]) + x + b"\x00"
    grey = bytes([0, 0, 0, 10, 10, 10, 20, 20, 20, 30, 30, 30])
    local = bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9])
    head = b"GIF89a" + bytes([1, 0, 5, 0, 0x81, 0, 0]) + grey
    # rows of an interlaced picture come in the order 0, 4, 2, 1, 3; disposal 2 clears it before the next one
    first = b"\x21\xf9\x04\x08\x01\x00\x00\x00\x2c" + bytes([0, 0, 0, 0, 1, 0, 5, 0, 0x40]) + pixels(0, 1, 2, 3, 0)
    second = b"\x2c" + bytes([0, 0, 4, 0, 1, 0, 1, 0, 0x81]) + local + pixels(1)
    frames = decode_gif(head + first + second + b"\x3b")
    assert frames[0]["canvas"][:, 0, 0].tolist() == [0, 30, 20, 0, 10]
    assert frames[1]["canvas"][4, 0].tolist() == [4, 5, 6] and len({tuple(x) for x in frames[1]["canvas"][:4, 0].tolist()}) == 1


def test_gif_frames_disposal_and_transparency():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"ab" * 70_000, rng.bytes(150_000)):
        assert lzw_unpack(lzw_pack(raw), 8, len(raw)) == raw
    assert len(decode_gif(encode_gif(b"z" * 192 * 300))) == 2
    pixels = lambda *v: b"\x02" + bytes([len(x := lzw_pack(bytes(v), 2))]) + x + b"\x00"
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0]) + palette
    first = b"\x21\xf9\x04\x04\x05\x00\x00\x00\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0]) + pixels(1, 2)
    second = b"\x21\xf9\x04\x0d\x07\x00\x03\x00\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0]) + pixels(3, 1)
    third = b"\x2c" + bytes([1, 0, 0, 0, 1, 0, 1, 0, 0]) + pixels(3)
    frames = decode_gif(head + first + second + third + b"\x3b")
    assert frames[0]["canvas"].tolist() == [[[255, 0, 0], [0, 255, 0]]]
    assert frames[1]["canvas"].tolist() == [[[255, 0, 0], [255, 0, 0]]] and frames[1]["start_ms"] == 50
    assert frames[2]["canvas"].tolist() == [[[255, 0, 0], [0, 0, 255]]]


def test_damaged_gif_files_raise_value_errors():
    """Files that are cut at any byte, or have bytes changed, give frames or a ValueError, and nothing else."""
    whole = encode_gif(padded(b"some words of a text that goes on for a while " * 12))
    rng = np.random.default_rng(23)
    damaged = [whole[:k] for k in range(len(whole))]
    for _ in range(300):
        raw = bytearray(whole)
        for at in rng.integers(0, len(raw), 3):
            raw[at] = rng.integers(0, 256)
        raw[6:10] = whole[6:10]  # the picture's size decides how much memory is taken
        damaged.append(bytes(raw))
    bad = 0
    for raw in damaged:
        try:
            decode_gif(raw)
        except ValueError:
            bad += 1
    assert bad > len(whole) // 2
    with pytest.raises(ValueError):
        decode_gif(whole[: len(whole) // 2])
