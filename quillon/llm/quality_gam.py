"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits a shallow tree on one binned feature at a time; each tree is added to that feature's lookup
table. Pairs with the largest gain on what is left get tables of their own. A score is a sum of table entries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fold, table

#: Bound of the fitted model: labelled rows that it learns from.
SAMPLE_ROWS = 20_000
FEATURES = ["log_words", "distinct_words", "adjacent_repeats", "longest_run", "top_word", "upper", "digits", "symbols", "marked_words", "word_length", "short_words", "distinct_lines", "words_per_line", "sentence_marks", "packed"]
#: Byte classes.
UPPER, DIGIT = slice(65, 91), slice(48, 58)
SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"])
MARKS = np.frombuffer(b".,;:!?", np.uint8)
ENDINGS = tuple(bytes([c]) for c in SYMBOLS)


def features(text: str | None) -> list[float]:
    """Numbers of the whole text; a null or empty text has zeros."""
    raw = b"" if text is None else text.encode()
    found = raw.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = Counter(found)
    runs = [sum(1 for _ in g) for _, g in groupby(found)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    return [
        float(np.log1p(n)),
        len(words) / n,
        1 - len(runs) / n,
        max(runs) / n,
        max(words.values()) / n,
        float(counts[UPPER].sum()) / letters,
        float(counts[DIGIT].sum()) / size,
        float(counts[SYMBOLS].sum()) / size,
        sum(w.endswith(ENDINGS) for w in found) / n,
        size / n,
        sum(len(w) < 3 for w in found) / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(counts[MARKS].sum()) / n,
        len(zlib.compress(raw, 1)) / size,
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    more = "" if label_col is None else ", _label int"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="_text").assign(_x=[features(t) for t in batch["_text"]])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *([] if label_col is None else [F.col(label_col).cast("int").alias("_label")]))
    return rows.mapInPandas(measure, f"_id {kind}{more}, _x array<double>")


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values, bin by bin, of the tree of this depth that gains most at every split."""
    total = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return total
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = lg**2 / (lh + ridge) + (g.sum() - lg) ** 2 / (h.sum() - lh + ridge)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return total
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid, once along either axis, into four parts."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        top, left, whole = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        parts.append((a, top - a, left - a, whole - top - left + a))
    gain = sum(x**2 / (y + ridge) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), *parts, strict=True):
        out[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 6, rate: float = 0.1, ridge: float = 5.0) -> dict:
    """Edges, lookup tables and base of the model. Without both labels every score is the smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(share / (1 - share))), "edges": [], "tables": [], "pairs": [], "coarse": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    wide = [np.unique(np.quantile(c, np.linspace(0, 1, coarse + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    rough = [np.searchsorted(e, c, side="right") for e, c in zip(wide, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), model["base"])
    for _ in range(rounds):
        for k, b in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(tables[k])), np.bincount(b, p * (1 - p), len(tables[k])), 2, ridge)
            tables[k] += step
            total += step[b]
    p = 1 / (1 + np.exp(-total))

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(wide[i]) + 1, len(wide[j]) + 1)
        return np.bincount(rough[i] * shape[1] + rough[j], v, shape[0] * shape[1]).reshape(shape)

    able = [k for k in range(x.shape[1]) if len(wide[k])]
    gains = sorted(((_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)), ridge)[0], i, j) for i, j in combinations(able, 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    squares = [np.zeros((len(wide[i]) + 1, len(wide[j]) + 1)) for i, j in chosen]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(chosen):
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)), ridge)[1]
            squares[k] += step
            total += step[rough[i], rough[j]]
    return model | {"edges": edges, "tables": tables, "coarse": wide, "pairs": [(i, j, s) for (i, j), s in zip(chosen, squares, strict=True)]}


def gam_scores(model: dict, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model["base"])
    for k, (edges, values) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        total += values[np.searchsorted(edges, x[:, k], side="right")]
    for i, j, square in model["pairs"]:
        total += square[np.searchsorted(model["coarse"][i], x[:, i], side="right"), np.searchsorted(model["coarse"][j], x[:, j], side="right")]
    return 1 / (1 + np.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs' rows with a label, at most about rows of them, chosen by a hash of the id; the label is _label."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max(label_col).alias("_label"))
    n = some.count()
    place = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(label_col)), F.lit(1 << 30)) / float(1 << 30)
    some = some.where(place < min(1.0, rows / n if n else 1.0))
    # the sample is bounded, so it can go to all tasks
    return docs.join(F.broadcast(some), docs[id_col] == some["_key"]).drop("_key")


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict:
    found = feature_table(labelled_sample(docs.select(id_col, text_col), labels, label_col, id_col, rows), id_col, text_col, "_label").orderBy("_id").toPandas()
    x = np.array(found["_x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_gam(x, found["_label"].to_numpy(float))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row; null and empty texts are scored by the features of an empty text, repeated
    rows alike; other columns are left behind."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["_text"]], float).reshape(-1, len(FEATURES))
            s = gam_scores(model, x)
            yield pd.DataFrame({"_id": batch["_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(score, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = fit_quality(docs, labels)
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
