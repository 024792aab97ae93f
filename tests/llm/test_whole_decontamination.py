"""Decontamination against brute force where an item leaks into a third of all rows."""

import random

from quillon.llm.lsa_decontam import contaminated, words_of


def longest(one, two):
    row = [0] * (len(two) + 1)
    for x in one:
        before = row
        row = [0]
        for k, y in enumerate(two):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def test_item_that_leaks_into_a_third_of_the_rows(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(30 + 5 * k) + ". " + text(6) + ".") for k in range(5)]
    rows = []
    for k in range(240):
        said = text(60)
        if k % 3 == 0:
            said += " " + items[0][1] + " " + text(40)
        if k % 80 == 7:
            said += " " + items[2][1]
        rows.append((k, said))
    rows += [(1000 + k, rows[1][1]) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        own = words_of(t)
        for q, x in items:
            part = words_of(x)
            if len(set(own) & set(part)) >= 0.6 * len(set(part)) and longest(part, own) >= 0.85 * len(part):
                want.add((i, q))
    assert len(want) == 83
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_items_longer_than_a_passage(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(6000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(300) + "."), (2, text(1000) + "."), (3, text(150) + ".")]
    loose = " ".join(w if k % 4 else f"{w} more{k} here{k}" for k, w in enumerate(items[0][1].split()))
    part = " ".join(items[1][1].split()[:400])
    rows = [(1, text(90) + " " + items[0][1] + " " + text(70)), (2, items[1][1]), (3, text(33) + " " + items[2][1]), (4, loose), (5, part), *[(k, text(400)) for k in range(10, 50)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 1)]
    assert all(r["lcs_share"] == 1.0 for r in got)
