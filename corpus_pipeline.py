"""A training corpus from raw documents: five stages, each a numbered operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
documents. Where a stage tells documents apart it does so by 128 bits of their id and text, so rows without an id, and different texts of one id, are documents of their own.

Edge cases of every stage: null and empty texts pass (quality scores them as empty ones); ties
and repeated rows as said below; very long texts are worked on whole; an empty table gives an
empty one; of other columns those of documents are returned, whatever the others are named.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.deploy import ship
from parlance.llm.common import documents, new_path, stored
from parlance.llm.decontaminate import contaminated
from parlance.llm.jaccard_join import jaccard_components
from parlance.llm.mixing import TARGETS, mix
from parlance.llm.quality import CUT, scored, train
from parlance.llm.token_output import read_documents, write_sequences

#: Keys that different documents may share: some are at 10^11 documents.
SHARED = 10_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def key_of() -> Column:
    """64 bits of a document."""
    return F.xxhash64("doc_id", "text")


def check_of() -> Column:
    """64 other bits of it."""
    return F.xxhash64(F.lit(1), "text", "doc_id")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, a number that tells documents apart by 128 bits: its 64 bits, or where documents
    share these and differ in the 64 others, those. Few do (n squared / 2^65), so they are listed."""
    seen = docs.groupBy(key_of().alias("key")).agg(F.min(check_of()).alias("least"), F.max(check_of()).alias("most"))
    shared = [r.key for r in seen.where("least <> most").select("key").limit(SHARED + 1).collect()]
    if len(shared) > SHARED:
        raise RuntimeError(f"more than {SHARED} keys are shared by different documents")
    return docs.withColumn("key", F.when(key_of().isin(shared), check_of()).otherwise(key_of()) if shared else key_of())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; repeated rows have one score."""
    ship(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model).where(F.col("score") >= CUT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar sets of 5-word shingles, at 0.8 or more, the one with the
    smallest id; one without an id stays only if there is no other, and of those of one id the one with the
    smallest hash. Of rows that are equal in id and text one stays, by their other columns.
    Documents without words all stay."""
    ship(spark)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\t-\r]"), F.lit(False))
    docs = keyed(docs.select(*COLUMNS)).withColumn("has_words", has_words)
    some = docs.where("has_words").drop("has_words")
    found = jaccard_components(some.select(F.col("key").alias("doc_id"), "text"), width=5, percent=80)
    ids = some.select("key", "doc_id").distinct().join(found.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = ids.groupBy("component_id").agg(first).select("first.key")
    rows = some.join(kept, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("doc"))
    return rows.select("doc.*").unionByName(docs.where("not has_words").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; rows equal in id and text go or stay together."""
    ship(spark)
    docs = keyed(docs.select(*COLUMNS))
    found = contaminated(docs.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: by file, and by row in each file. Repeated rows each
    have a place; a null source is a source of its own.

    The target weights are op9's ``TARGETS``. Each source has its share, to within less than
    a block, wherever one stops reading before a source runs out; the documents after that
    (``in_mix`` false) have the last slots, so they come last.
    """
    ship(spark)
    mixed = mix(docs.select(*COLUMNS), TARGETS)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' ids in the Arrow files that were written, in the order of ``docs``' files. A null or
    empty text is one end id; rows are told apart by their place, so nulls and repeated rows stay."""
    import public_tokenizers

    ship(spark)
    name = F.col("_metadata.file_name")
    order: tuple = (F.length(name), name, F.col("_metadata.row_index"))
    try:
        docs.select(*order)
    except AnalysisException:  # not read from files
        order = ("doc_id",)
    path = new_path(spark, "corpus")
    shards = write_sequences(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order_by=order)
    return read_documents(shards)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Training, components and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
