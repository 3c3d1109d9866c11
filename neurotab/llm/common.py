"""What the operators of this subpackage share: scratch tables, row keys, connected components."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package; on a cluster it is installed on every machine."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where a session on one machine names none (tests), a new local one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="neurotab-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Written tables in the shared folder, to cut lineage and to be read more than once; lost executors don't lose them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.there: set[str] = set()

    def path(self) -> str:
        self.n += 1
        return f"{self.dir}/t{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back."""
        schema, path = df.schema, self.path()
        df.write.parquet(path)
        self.there.add(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of cut() that nothing reads any more."""
        self._delete(t._scratch_path for t in tables)

    def last(self, df: DataFrame) -> DataFrame:
        """Writes df and deletes all other tables: the result, after which nothing else is left on disk."""
        before = list(self.there)
        out = self.cut(df)
        self._delete(before)
        return out

    def _delete(self, paths) -> None:
        """Deletes tables, and lets Spark delete shuffle files: it does so when the driver collects the plans that wrote them."""
        jvm = self.spark._jvm
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.there.discard(path)
        gc.collect()
        jvm.System.gc()


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty string."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def row_key(text: str = "text", key: str = "doc_id") -> Column:
    """Key of a row of documents by which results of its text are joined back: null and repeated doc_id don't mix different texts."""
    return F.struct(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.xxhash64(F.col(key), F.col(text)).alias("h"))


def perhaps_among(df: DataFrame, key: Column, ids: DataFrame, bits: int = 25) -> DataFrame:
    """df with ``perhaps``: false only where no row of ids (one column, of the type of key) equals key.

    ids become a bitmap of 2^bits places, which is broadcast as rows of 64 places: at
    most 2^(bits - 6) rows, however many ids there are. So rows that a join would drop
    aren't shuffled for it. Null is among no ids.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    one = F.call_function("shiftleft", F.expr("1L"), F.col("_h").bitwiseAND(63).cast("int"))
    words = ids.toDF("_id").where("_id is not null").select(place(F.col("_id")).alias("_h")).groupBy(F.shiftright("_h", 6).alias("_at")).agg(F.bit_or(one).alias("_set"))
    marked = df.withColumn("_h", place(key)).join(F.broadcast(words), F.shiftright("_h", 6) == F.col("_at"), "left")
    bit = F.call_function("shiftright", F.col("_set"), F.col("_h").bitwiseAND(63).cast("int")).bitwiseAND(1)
    return marked.withColumn("perhaps", key.isNotNull() & F.coalesce(bit == 1, F.lit(False))).drop("_h", "_at", "_set")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (src, dst) reach, for each node that has a link.

    Every round takes the smallest label among neighbours and then the label of
    that label, so a chain shrinks by a power; rounds end when no label changes.
    Only counts of changed labels reach the driver.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = scratch.cut(both.where("src <> dst").distinct())
    lab = scratch.cut(e.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("label")).withColumn("changed", F.lit(True)))
    while True:
        near = e.join(lab, e.dst == lab.node).select(e.src.alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = lab.select("node", "label", F.col("label").alias("old"))
        hop = near.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        over = lab.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = hop.join(over, hop.label == over.at).select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("old")).alias("changed"))
        before, lab = lab, scratch.cut(new)
        scratch.drop(before)
        if not lab.where("changed").limit(1).count():
            scratch.drop(e)
            return lab.select("node", F.col("label").alias("component"))
