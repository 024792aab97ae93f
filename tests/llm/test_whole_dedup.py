"""Rows that share an id keep their text: repeated rows, and different texts under one id or under none."""

import random

from quillon.llm import suffix_dedup as S
from quillon.llm.sentence_spans import sentence_spans


def test_repeated_row_that_leads_a_partly_shared_passage(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    shared = text(400)
    first, second = text(300) + shared + text(300), text(310) + shared + text(290)
    once = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    twice = spark.createDataFrame([(1, first), (1, first), (2, second)], "doc_id long, text string").repartition(2)
    for hot in (S.HOT, 0):
        monkeypatch.setattr(S, "HOT", hot)
        want = {tuple(r) for r in S.suffix_dedup(once).collect()}
        got = [tuple(r) for r in S.suffix_dedup(twice).collect()]
        assert len(got) == 3 and set(got) == want and {(r[0], r[2]) for r in want} == {(1, 0), (2, 400)}


def test_different_texts_under_one_id(spark):
    said = "One two. Three four! Five six? "
    for key in (None, 5):
        rows = [(1, said + "Seven."), (key, "New here. " + said + "And more."), (key, "All of it. Is quite. New to us. Or so."), (key, said + "Eight."), (key, "Q r. S t. U v. First."), (key, "Q r. S t. U v. Other.")]
        got = {r["text"]: r for r in sentence_spans(spark.createDataFrame(rows, "doc_id long, text string"), width=3, words=0).collect()}
        assert got[rows[1][1]]["kept_text"] == "New here. And more."
        assert got[rows[2][1]]["kept_text"] == rows[2][1]
        assert got[rows[3][1]]["kept_text"] == " Eight."
        assert sorted([got[rows[4][1]]["n_removed"], got[rows[5][1]]["n_removed"]]) == [0, 3]
        assert len(got) == len(rows)
