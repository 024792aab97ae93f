import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, component_id string, media string"


def sentence(rng, n):
    words = "the of and stone river light cold house green walk under paper seven ridge quiet ember tallow brisk".split()
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, tiny, empty and null ones."""
    import random

    rng = random.Random(4)
    base = [sentence(rng, 120) + ". " + sentence(rng, 30) for _ in range(6)]
    passage = sentence(rng, 60)
    out = [*base, base[0], base[0], base[1] + " tail", "x" + base[2][1:], passage + " " + base[3][:200], base[4][:150] + " " + passage, "ab " * 200, "one two", "ONE two", "", None, None, "   \t", "é" * 130, "é" * 131, "a" * 400]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns whose names clash with those of results, nulls in all columns and a repeated row."""
    rows = [(None if k == 3 else k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", k, "a", None, "c", None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
