"""Merkle manifest, token alignment and line runs against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import line_runs, merkle_manifest, token_alignment
from quillon.llm.line_runs import LineRuns, dedup_batch, dedup_lines
from quillon.llm.merkle_manifest import FIELDS

# --- manifest ----------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, **changed):
    values = [changed.get(c, row[c]) for c in FIELDS]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def reduced(nodes):
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0]


def walked(nodes, at, replaced):
    """(siblings, root) for the node at a place that is replaced."""
    beside = []
    while len(nodes) > 1:
        run = nodes[at - at % 3 : at - at % 3 + 3]
        beside += [x for k, x in enumerate(run) if k != at % 3]
        run[at % 3] = replaced
        nodes, at, replaced = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3, h(*run)
    return beside, replaced


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subroots = [reduced([leaf(r) for r in trees[s]]) for s in sources]
    root, out = reduced(subroots), []
    for k, s in enumerate(sources):
        leaves = [leaf(r) for r in trees[s]]
        for at, r in enumerate(trees[s]):
            new = leaves[at]
            if zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                new = leaf(r, text=r["text"].replace("\n", ""))
            low, folded = walked(list(leaves), at, new)
            high, folded = walked(list(subroots), k, folded)
            out.append((r["doc_id"], leaves[at], subroots[k], root, h(*low, *high), folded, folded == root))
    return out


SHORT = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int, h string, row int"


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_plain_trees(spark, height):
    """Small blocks make many rounds on few rows."""
    rng = random.Random(height)
    rows = []
    for k in range(160):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "é", "B", None, f"one{k % 11}", ""])
        text = rng.choice([None, "", "a\nb", "plain", "x" * 5000 + "\n", "\n\n", "é\n"])
        rows.append((None if k % 29 == 0 else k % 140, text, rng.choice([None, "en", "-"]), source, rng.choice([None, 4, -7]), "d", 1, "h", 2))
    rows += rows[40:43]
    plain = [dict(zip([c.split()[0] for c in SHORT.split(", ")], r)) for r in rows]
    out = merkle_manifest.merkle_manifest(spark.createDataFrame(rows, SHORT).repartition(4), changed=merkle_manifest.without_breaks(), height=height)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.select(columns).collect()), key=repr) == sorted(plain_manifest(plain), key=repr)


def test_siblings_lead_to_the_root(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 4}", k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle_manifest.merkle_manifest(docs, siblings=True)
    for r in out.collect():
        assert r["verified"] and r["proof_sha256"] == h(*r["siblings"]) and len(r["siblings"]) in (4, 5, 6, 7, 8)


def test_manifest_of_few_rows(spark, empty):
    assert merkle_manifest.merkle_manifest(empty).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle_manifest.merkle_manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == h("-----") and row["proof_sha256"] == h("") and row["doc_id"] is None


def test_resumed_states_need_no_left_siblings():
    nodes = [h(str(k)).encode() for k in range(11)]
    levels, _ = merkle_manifest.grow(nodes, 3)
    state = levels[0].states[1][2]
    assert merkle_manifest.resume(state, b"new", b"") == h(nodes[3].decode(), nodes[4].decode(), "new").encode()


# --- alignment ---------------------------------------------------------------------------------------------------


def plain_links(text, a, b):
    """(a ids, b ids, groups, links) of a text from all pairs of byte ranges; None where it is not given back."""
    if not text:
        return None
    x, y = a.encode([text])[0], b.encode([text])[0]
    if a.bytes_of(x) != b" " + text.encode() or b.bytes_of(y) != b" " + text.encode():
        return None

    def ranges(side, ids):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(side.entries[i]), i))
            at += len(side.entries[i])
        return out

    left, right = ranges(a, x), ranges(b, y)
    links = [(i, j) for s, e, i in left for t, u, j in right if s < u and t < e]
    ends = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    groups = []
    for begin, end in zip([0, *ends], ends):
        groups.append("|".join(",".join(str(i) for _, e, i in side if begin < e <= end) for side in (left, right)))
    return len(x), len(y), groups, links


def test_alignment_equals_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(token_alignment, "RUN_BYTES", 700)
    more = [(100, "<|endoftext|> <s> said\tthe fox <0x41>"), (101, "naïve 漢字 🙂 end"), (102, "the the the the"), (103, "the  two\n\n  spaces "), (104, "▁ low bar"), (105, "word " * 400), (None, "the fox")]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    given = given.withColumns({"n_a": F.lit("x"), "run": F.lit(1), "place": F.lit(2), "part": F.lit(3)})
    out = token_alignment.align_tokens(given, parts=3, fan=2)
    rows = [tuple(r) for r in given.select("doc_id", "text").collect()]
    a, b = token_alignment.sides(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    plain = [plain_links(t, a, b) for _, t in rows]
    count = Counter(pair for p in plain if p for pair in set(p[3]))
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    want = []
    for (k, _), p in zip(rows, plain):
        if p is None:
            want.append((k, 0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, groups, links = p
            best = sum(count[x] == highest[x[0]] for x in links)
            want.append((k, n_a, n_b, len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), best, sum(count[x] for x in links)))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, out.select(columns).collect()), key=repr) == sorted(want, key=repr)
    assert sum(p is None for p in plain) >= 3 and max(count.values()) > 5


def test_alignment_of_nothing(spark, empty):
    assert token_alignment.align_tokens(empty).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r) for r in token_alignment.align_tokens(nulls).collect()} == {(1, 0, 0, 0, 0, "", 0, 0), (None, 0, 0, 0, 0, "", 0, 0)}


def test_heads_merge_like_a_counter():
    import numpy as np

    rng = np.random.default_rng(5)
    heads, whole = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 1 << 31, 30000) // 40000)
        counts = rng.integers(1, 9, len(keys))
        whole.update(dict(zip(keys.tolist(), counts.tolist())))
        heads.append(token_alignment.pack_head(keys, counts))
    keys, counts = token_alignment.merged(heads)
    assert dict(zip(keys.tolist(), counts.tolist())) == whole and (np.diff(keys) > 0).all()


# --- lines -------------------------------------------------------------------------------------------------------


def plain_lines(rows):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            x = key(line)
            if len(x) >= 10:
                at = (k is None, k or 0)
                first[x] = min(first.get(x, at), at)
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (k is None, k or 0)]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(8)
    pool = [f"{rng.choice(['Shared', 'shared', ' SHARED'])} line number {k} {rng.choice(['', ' ', chr(9)])}" for k in range(40)] + ["short", "", "É" * 9, "É" * 10, "é" * 10, " nbsp stays here ", "exactly10c", "Kelvin K sign"]
    rows = [(None if k % 17 == 3 else k % 90, rng.choice([None, "", "\n", "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))]) if k % 6 == 0 else "\n".join([*(rng.choice(pool) for _ in range(5)), "the very common line", f"own line of {k}", "\r"])) for k in range(130)]
    rows += rows[5:8] + [(7, "\n".join(f"line {k % 3000} of a very long text" for k in range(20000)))]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], "doc_id long, text string, kept string, n_lines int, batch int, h string")
    return rows, frame.repartition(5)


def digested(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_equal_a_loop(lined, batches):
    rows, docs = lined
    assert digested(dedup_lines(docs, batches=batches, fan=2)) == plain_lines(rows)


def test_batches_of_a_store_that_is_opened_again(spark, lined, tmp_path):
    rows, docs = lined
    store = LineRuns(spark, str(tmp_path / "store"), fan=2, buckets=3)
    bounds = [(None, 20), (20, 40), (40, 60), (60, None)]
    out = None
    for low, high in bounds:
        part = docs.where((F.col("doc_id") >= low) if low is not None else F.lit(True)).where((F.col("doc_id") < high) if high is not None else F.lit(True))
        if high is None:
            part = docs.where("doc_id >= 60 or doc_id is null")
        done = dedup_batch(part, store)
        out = done if out is None else out.unionByName(done)
        store = LineRuns.opened(spark, store.folder)
    assert digested(out) == plain_lines(rows)
    # four batches of runs of two: one run of the second level
    assert [level for level, _ in store.runs] == [2] and store.version == 4
    assert all(spark.table(n).groupBy("h").count().where("count > 1").count() == 0 for _, n in store.runs)


def test_runs_are_joined_without_a_shuffle_of_their_own(spark, lined, tmp_path):
    _, docs = lined
    store = LineRuns(spark, str(tmp_path / "store"), buckets=4)
    lines = line_runs.long_lines(docs, "doc_id", "text", 10).select("h", "id")
    store.add(lines)
    probe = lines.groupBy("h").count().join(spark.table(store.runs[0][1]).select("h").hint("merge"), "h", "left_anti")
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = probe._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and probe.count() == 0


def test_no_python_in_the_plan_of_lines(lined):
    plan = dedup_lines(lined[1], batches=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan


def test_lines_of_nothing(empty):
    assert dedup_lines(empty).count() == 0
