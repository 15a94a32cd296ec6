"""State kept as tables: a sink that may get a batch twice, and what the state is.

Changes (kind, key, ordinal, gone, fields, body) come in batches. Each batch has folders of its own,
by its number, which a repetition overwrites, so the same batch twice changes nothing:
``state`` holds the last change of each key, ``bodies`` the bytes that no earlier batch has, once by their
sha256, ``log`` all changes without bodies. Every ``FOLD`` batches the state so far is folded into one
table, from which later readers start.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "kind string, key string, ordinal long, gone boolean, fields string, sha256 string, size long"
BODIES = "sha256 string, size long, body binary"
#: Batches after which the state is folded.
FOLD = 20


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tables of all batches below a folder, with ``batch``; none before the first."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def _last(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("kind", "key").orderBy(F.desc("batch"), F.desc("ordinal"), F.desc("sha256"))
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def _so_far(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    """Last changes of all batches below ``before``, from the last folded table on."""
    upto = F.lit(before is None) | (F.col("batch") < F.lit(before or 0))
    folded = _read(spark, f"{path}/folded", STATE).where(upto)
    at = folded.select("batch").distinct().agg(F.max("batch")).first()[0]
    changes = _read(spark, f"{path}/state", STATE).where(upto)
    return changes if at is None else changes.where(F.col("batch") > at).unionByName(folded.where(F.col("batch") == at))


def save(changes: DataFrame, number: int, path: str, fold: int = FOLD) -> None:
    """A batch of changes; for ``foreachBatch`` with a ``path``."""
    spark = changes.sparkSession
    rows = changes.select("kind", "key", "ordinal", F.coalesce("gone", F.lit(False)).alias("gone"), "fields", F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("size"), "body")
    put = lambda df, name: df.drop("batch").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    known = _read(spark, f"{path}/bodies", BODIES).where(F.col("batch") < number).select("sha256")
    new = rows.where("body is not null").select("sha256", "size", "body").dropDuplicates(["sha256"])
    put(new.join(known, "sha256", "left_anti"), "bodies")
    put(rows.drop("body"), "log")
    put(_last(rows.drop("body").withColumn("batch", F.lit(number).cast("long"))), "state")
    if fold and number % fold == fold - 1:
        put(_last(_so_far(spark, path, number + 1)), "folded")


def current(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, fields, sha256, size of what there is: the last change of each key that doesn't remove it."""
    return _last(_so_far(spark, path, None)).where("not gone").select("kind", "key", "fields", "sha256", "size")


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, body, whole: the bytes of what there is, and whether they are those of their sha256."""
    found = _read(spark, f"{path}/bodies", BODIES).select("sha256", "body")
    there = current(spark, path).where("sha256 is not null").join(found, "sha256", "left")
    return there.select("kind", "key", "body", F.coalesce(F.sha2("body", 256) == F.col("sha256"), F.lit(False)).alias("whole"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """kind, n, bytes of what there is, bodies (different ones), changes (all so far)."""
    there = current(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("sha256").alias("bodies"))
    changes = _read(spark, f"{path}/log", STATE).groupBy("kind").agg(F.count("*").alias("changes"))
    rows = changes.join(there, "kind", "left")
    return rows.select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bytes", "bodies")], "changes")
