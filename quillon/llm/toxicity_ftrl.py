"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fold, stored, table
from quillon.llm.suffix_dedup import ODD, mix

#: Bounds of the fitted model: labelled rows of either class that it learns from, and weights.
SAMPLE_EACH = 4000
BITS = 20
EPOCHS = 4
#: Parts of the sample that reach the driver one after the other, and examples that are shuffled together.
PARTS, SHUFFLED = 16, 512
#: ASCII letters are lower-cased, other ASCII signs but digits separate words.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def hashed_ngrams(text: str | None) -> np.ndarray:
    """Places of the words, pairs of neighbours, triples and pairs with one or two words between, each with its own salt."""
    if text is None:
        return np.zeros(0, np.int32)
    found = text.encode().translate(CLEAN).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    parts = [h, h[:-1] * ODD + h[1:], (h[:-2] * ODD + h[1:-1]) * ODD + h[2:], h[:-2] * ODD + h[2:] + np.uint64(2), h[:-3] * ODD + h[3:] + np.uint64(3)]
    return (mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal with a learning rate for each coordinate; weights that L1 leaves at zero are left out."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.zb, self.nb = 0.0, 0.0

    def weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + root) / self.alpha + self.l2), 0.0)

    def base(self) -> float:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha)

    def learn(self, at: np.ndarray, y: float) -> None:
        """One step for an example with the features at."""
        zs, root = self.z[at], np.sqrt(self.n[at])
        w, b = self.weights(zs, root), self.base()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * w
        self.n[at] += g * g
        self.zb += g - (np.sqrt(self.nb + g * g) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(self.z, np.sqrt(self.n))
        places = np.flatnonzero(w)
        return places.astype(np.int32), w[places].astype(np.float32), float(self.base())


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", each: int = SAMPLE_EACH) -> dict:
    """Weights from at most about `each` rows of either class; the base is set back to the classes' true shares.
    Without both classes all weights are zero and the score is the smoothed share of ones."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max(label_col).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in some.groupBy("_label").count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = (ones + 1) / (ones + zeros + 2)
    empty = {"places": np.zeros(0, np.int32), "weights": np.zeros(0, np.float32), "base": float(np.log(share / (1 - share)))}
    if not ones or not zeros:
        return empty
    rates = [min(1.0, each / zeros), min(1.0, each / ones)]
    place = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(label_col)), F.lit(1 << 30)) / float(1 << 30)
    some = some.where(place < F.when(F.col("_label") == 1, rates[1]).otherwise(rates[0]))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_label": batch["_label"], "_x": [np.unique(hashed_ngrams(t)).tobytes() for t in batch["_text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    # the sample is bounded, so it can go to all tasks; its texts' features come to the learner a part at a time
    found = rows.join(F.broadcast(some), rows["_id"] == some["_key"]).select("_id", "_text", "_label")
    found = found.mapInPandas(measure, f"_id {kind}, _label int, _x binary").withColumn("_p", F.xxhash64("_id", "_label", "_x"))
    found = stored(found.repartitionByRange(PARTS, "_p").sortWithinPartitions("_p"), "toxicity-sample")
    if found.select("_label").distinct().count() < 2:
        return empty
    learner, rng = Ftrl(), np.random.default_rng(5)
    for _ in range(EPOCHS):
        part: list = []
        for row in chain(found.toLocalIterator(), [None]):
            if row is not None:
                part.append(row)
            if len(part) == SHUFFLED or row is None:
                for k in rng.permutation(len(part)):
                    learner.learn(np.frombuffer(part[k]["_x"], np.int32), float(part[k]["_label"]))
                part = []
    places, weights, base = learner.model()
    return {"places": places, "weights": weights, "base": base + float(np.log(rates[0] / rates[1]))}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row; null and empty texts get the base score, repeated rows the same; other
    columns are left behind."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[model["places"]] = model["weights"]
        known = dense != 0
        for batch in batches:
            sums = []
            for text in batch["_text"]:
                at = hashed_ngrams(text)
                sums.append(float(dense[np.unique(at[known[at]])].sum()))
            s = 1 / (1 + np.exp(-np.clip(np.array(sums, float) + model["base"], -35, 35)))
            yield pd.DataFrame({"_id": batch["_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(score, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
