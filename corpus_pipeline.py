"""The corpus pipeline: language, near duplicates, repeated strings, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and but for the last returns the columns of documents. Columns beyond
those are dropped; ``text`` and ``n_chars`` are those of what is left of a text.
An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab.llm import language, neardup, packing, substrings
from neurotab.llm.common import Scratch, perhaps_among

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH, READ = 200, 512  # texts are long: so many rows at once between Spark and Python, and read from a file, keep buffers small


def _lean(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch and of a read for the session; results are read later, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are rejected: those without text or without a letter. Those without a language get the predicted one.

    Learns from labelled rows that aren't held out; where no row is labelled, every document is rejected.
    """
    _lean(spark)
    found = language.identify(docs.select(*COLUMNS), language.learn(docs)).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group alike to 0.8 in sets of five words; rows that repeat its id stay with it."""
    _lean(spark)
    groups = neardup.groups(docs.select("doc_id", "text"))
    gone = groups.where("not kept").select("doc_id").distinct()
    marked = perhaps_among(docs.select(*COLUMNS), F.col("doc_id").cast("long"), gone)  # texts that stay aren't shuffled
    return marked.where("not perhaps").select(*COLUMNS).union(marked.where("perhaps").select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every string of 400 bytes and every run of 50 words that stands twice; documents of which nothing is left go."""
    _lean(spark)
    left = substrings.deduplicate(docs, keep_text=True, more=("lang", "source"), words=True)
    return left.where("n_removed = 0 or n_bytes > n_removed").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of what is left, by number of words."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", drop_repeated_strings),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
