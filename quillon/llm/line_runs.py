"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. The hashes that earlier batches have seen lie in runs: Parquet tables dealt into buckets by
hash and sorted inside each. A batch is reduced to its distinct hashes, merge-anti-joined with every run, and what is
left becomes a run of its own, so runs never share a hash. When a level has `fan` runs, they are merged into one of the
next level: a store of n batches has at most (fan - 1) runs on each of log(n) levels, and a hash is rewritten once a level.

All of it is DataFrame code. A hash is the 128-bit MD5 of a line's key, and no lines are compared beyond it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import shared_dir, stored, table

#: ASCII white space, and the letters that lower-casing changes.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10
FAN = 4
BATCHES = 8


def line_key(line: Column) -> Column:
    """The line without white space at its ends, in lower case as far as ASCII goes."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text; rows that repeat both get the same cuts."""
    parts = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(parts.cast("binary")))


class LineRuns:
    """A store of line hashes in a folder, for one batch after the other.

    `fan` runs of a level are merged into one of the next. Runs have `buckets` parts (the session's shuffle partitions
    unless told). A commit is a small table of the runs that hold; `opened` finds the last one, so that a store outlives
    its session, and what a failed batch has left behind is never read.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan: int = FAN, buckets: int | None = None):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        self.spark, self.fan = spark, fan
        self.folder = folder or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.runs: list[tuple[int, str]] = []

    @classmethod
    def opened(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The store as the last batch that was added in full left it."""
        log = spark.read.parquet(f"{folder}/log")
        last = log.agg(F.max("version")).first()[0]
        rows = log.where(F.col("version") == last).orderBy("place").collect()  # a row for each run, few by construction
        store = cls(spark, folder, rows[0]["fan"], rows[0]["buckets"])
        store.version = last
        store.runs = [(r["level"], r["name"]) for r in rows]
        for _, name in store.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BINARY, id {r_type(spark, folder, name)}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {store.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return store

    def _write(self, fresh: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = fresh.repartition(self.buckets, "h").sortWithinPartitions("h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _commit(self) -> None:
        self.version += 1
        rows = ", ".join(f"({k}, {level}, '{name}')" for k, (level, name) in enumerate(self.runs))
        log = self.spark.sql(f"SELECT place, level, name, {self.fan} AS fan, {self.buckets} AS buckets FROM VALUES {rows} AS run(place, level, name)")
        log.coalesce(1).write.parquet(f"{self.folder}/log/version={self.version}")

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of lines(h, id) and returns its new run: the hashes that no earlier batch has, each with the
        smallest id of the batch that holds it (null only where no other does)."""
        fresh = lines.groupBy("h").agg(F.min("id").alias("id"))
        for _, name in self.runs:
            fresh = fresh.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        name = self._write(fresh)
        self.runs.append((0, name))
        self._compact()
        self._commit()
        return self.spark.table(name)

    def _compact(self) -> None:
        """Merges the runs of each full level into one of the next. Runs are disjoint, so nothing is compared."""
        level = 0
        while sum(at == level for at, _ in self.runs) >= self.fan:
            full = [name for at, name in self.runs if at == level]
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, self._write(merged))]
            level += 1

    def forget(self) -> None:
        """Takes the runs out of the session's catalog; files stay."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def r_type(spark: SparkSession, folder: str, name: str) -> str:
    return spark.read.parquet(f"{folder}/{name}").schema["id"].dataType.simpleString()


def long_lines(docs: DataFrame, id_col: str, text_col: str, least: int, kept: Sequence[Column] = ()) -> DataFrame:
    """(row, id, pos, h, *kept) of every line whose key has at least `least` code points."""
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"), _lines(F.col(text_col)).alias("lines"), *kept)
    # what a row needs once is taken before its lines go apart
    rows = rows.select(*[c for c in rows.columns if c != "lines"], F.posexplode("lines").alias("pos", "line"))
    keyed = rows.withColumn("_key", line_key(F.col("line"))).where(F.char_length("_key") >= least)
    return keyed.withColumn("h", F.unhex(F.md5(F.col("_key").cast("binary")))).drop("line", "_key")


def _without(docs: DataFrame, lines: DataFrame, owned: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with n_lines, n_dropped and kept: without the lines whose (h, id) is not in owned."""
    same = (F.col("l.h") == F.col("o.h")) & F.col("l.id").eqNullSafe(F.col("o.id"))
    # by hash and id together, so that a line of very many documents is dealt over all tasks
    lost = lines.alias("l").join(owned.alias("o"), same, "left_anti").groupBy("row").agg(F.collect_set("pos").alias("_lost"))
    made = ["n_lines", "n_dropped", "kept"]
    rows = docs.drop(*made).withColumn("_row", row_key(F.col(id_col), F.col(text_col)))
    joined = rows.join(lost.withColumnRenamed("row", "_row"), "_row", "left")
    whole = F.coalesce(F.col(text_col), F.lit(""))

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lost"))
        return F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")

    # the lines are named by a lambda, as they would be split anew for each place otherwise
    cut = F.element_at(F.transform(F.array(_lines(F.col(text_col))), rest), 1)
    return joined.withColumns(
        {
            "n_lines": (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long"),
            "kept": F.when(F.col("_lost").isNull(), whole).otherwise(cut),
        }
    ).drop("_row", "_lost")


def dedup_batch(docs: DataFrame, store: LineRuns, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One batch of a growing corpus: docs with n_lines, n_dropped and kept, and the store knows their lines afterwards.

    A line goes where an earlier batch has its key, or a smaller id of this batch. All else is as in dedup_lines.
    """
    lines = stored(long_lines(docs, id_col, text_col, least), "line-batch")
    return _without(docs, lines, store.add(lines.select("h", "id")), id_col, text_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept: the text without the lines that a smaller id holds.

    A line's key is the line without ASCII white space at its ends, with A-Z in lower case; keys under `least` code
    points always stay. Every copy of a line inside the smallest id that holds it stays. Batches follow the order of
    ids, cut at approximate quantiles, so that the result does not depend on where they are cut. A null or empty text
    is one empty line. Rows that share an id count as one document, and so do all rows without an id, which come last;
    rows that repeat id and text get the same cuts. Texts of any length are split as a whole; empty tables give no
    rows; columns named like the results are replaced.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):
        batch = batch + (F.col(id_col).isNull() | (F.col(id_col) > F.lit(cut))).cast("int")
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = long_lines(docs, id_col, text_col, least, [batch.alias("batch")])
    lines.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    store = LineRuns(spark, fan=fan)
    owned = None
    for k in range(len(set(cuts or [])) + 1):
        run = store.add(lines.where(F.col("batch") == k).select("h", "id"))
        owned = run if owned is None else owned.unionByName(run)
    return _without(docs, lines.drop("batch"), owned, id_col, text_col)


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, MIN(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.first_id AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT ANY_VALUE(doc_id) AS doc_id, COUNT(*)::BIGINT AS n_lines, COUNT(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rid
"""
