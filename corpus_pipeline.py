"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept and is written as Parquet and read
again. Stages tell rows apart by id and text: different texts under one id or under none are different documents; rows
that repeat id and text are one, of which near-duplicate removal keeps one row. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import stored, table
from quillon.llm.language_id import fit_dictionaries, identify, training_rows
from quillon.llm.lsa_decontam import contaminated
from quillon.llm.ngram_join import jaccard_components
from quillon.llm.source_mix import mix_sources
from quillon.llm.suffix_dedup import suffix_dedup

KEY = "_pipeline_key"
#: Most rows of a batch between Spark and its Python workers, which hold it several times; texts are long.
BATCH_ROWS = 2000


def _bounded(spark: SparkSession) -> None:
    """Lowers the session's batch size to BATCH_ROWS where it is larger or has no bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of id and text that sorts by the id, null ones last."""
    number = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("none"))
    return docs.withColumn(KEY, F.concat_ws(":", number, F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language is not clear."""
    _bounded(spark)
    books = fit_dictionaries(training_rows(docs))
    return identify(docs, books).where("not rejected").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest key of each group of near-duplicates, and all documents outside groups."""
    _bounded(spark)
    keyed = _keyed(docs)
    groups = jaccard_components(keyed.select(KEY, "text"), KEY)
    kept = groups.where(F.col(KEY) == F.col("component_id")).select(KEY).distinct()
    return keyed.join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 100-byte strings out of texts; characters that a cut leaves in part go with it; n_chars follows."""
    _bounded(spark)
    cuts = suffix_dedup(docs.select("doc_id", "text")).where("n_removed > 0").dropDuplicates(["doc_id", "text_sha256"])
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.coalesce("kept", F.lit("")).alias("_kept"), F.lit(True).alias("_cut"))
    text = F.when(F.col("_cut"), F.col("_kept")).otherwise(F.col("text"))
    chars = F.when(F.col("_cut"), F.char_length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("_sha"))
    return docs.join(cuts, same, "left").withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat or paraphrase a benchmark item."""
    _bounded(spark)
    keyed = _keyed(docs)
    found = contaminated(keyed.select(KEY, "text"), table(spark, sf_dir, "benchmark"), KEY)
    return keyed.join(found.select(KEY).distinct(), KEY, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the times it takes each (mix_copies) and the figures behind that."""
    return mix_sources(docs).where("mix_copies > 0")


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("source_mix", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
