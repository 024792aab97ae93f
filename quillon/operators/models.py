"""Classifiers over flattened windows behind one registry: Spark ML's, and the networks that this library trains.

Splits go by time, never by shuffling; the threshold comes from the validation part alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.util import DefaultParamsReader
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import SERIES, TIME
from quillon.operators import dataset as D
from quillon.operators.networks import NETWORKS, NetworkModel, load_network, train_network
from quillon.sources import written

REGISTRY: dict[str, Callable] = {
    "logistic": lambda n: LogisticRegression(maxIter=25, regParam=0.01),
    "boosted_trees": lambda n: GBTClassifier(maxIter=8, maxDepth=3, seed=42),
    "perceptron": lambda n: MultilayerPerceptronClassifier(layers=[n, 16, 2], maxIter=40, seed=42),
}


def examples(windows: DataFrame) -> DataFrame:
    """Windows with features (a vector of all values, oldest row first) and label."""
    flat = F.transform(F.flatten("x"), lambda v: v.cast("double"))
    return windows.withColumns({"features": array_to_vector(flat), "label": F.col("y").cast("double")}).drop("x")


def train(rows: DataFrame, name: str, width: int, steps: int = 32, **options) -> Model | NetworkModel:
    """Fits on the training part of examples with a part column. A network also watches the validation part; options are
    its own. Jobs run before this returns."""
    if name in NETWORKS:
        return train_network(rows, name, steps, **options)
    return REGISTRY[name](width).fit(rows.where("part = 'train'").select("features", "label"))


def predict(model: Model | NetworkModel, rows: DataFrame) -> DataFrame:
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select(SERIES, TIME, "row_index", "part", F.col("label").alias("y"), p.alias("p"))


def predictions(windows: DataFrame, width: int, names: tuple[str, ...] = tuple(REGISTRY), networks: dict[str, dict] | None = None, steps: int = 32) -> DataFrame:
    """(model, series, time, row_index, part, y, p) of each model, and of each network with its options, on all windows but
    the purged ones. The examples are written once and read by all of them."""
    rows = written(examples(D.chronological_split(windows)), "examples")
    out = None
    for name in (*names, *(networks or {})):
        model = train(rows, name, width, steps, **(networks or {}).get(name, {}))
        found = predict(model, rows.where("part <> 'purge'")).withColumn("model", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def save(model: Model | NetworkModel, path: str, columns: list[str]) -> None:
    """A trained model with the names of its inputs."""
    spark = SparkSession.active()
    network = isinstance(model, NetworkModel)
    if network:
        model.save(spark, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    rows = [(k, c, network) for k, c in enumerate(columns)]
    spark.createDataFrame(rows, "position int, column_name string, is_network boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load(path: str) -> tuple[Model | NetworkModel, list[str]]:
    """A saved model, whatever its kind, and the names of its inputs in order."""
    spark = SparkSession.active()
    columns = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
    network = bool(columns) and columns[0]["is_network"]
    model = load_network(spark, f"{path}/model") if network else DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return model, [r["column_name"] for r in columns]
