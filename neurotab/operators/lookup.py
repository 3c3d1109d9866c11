"""Looking up labels and side files by name, and the split designs that follow from names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names under which samples and groups are looked for, in this order.
SAMPLE_NAMES = ("SampleID", "sample_id", "ID", "样本", "样本ID", "样本编号")
GROUP_NAMES = ("Group", "group", "Label", "label", "组别", "分组", "类别")


def label_map(tables: Sequence[DataFrame], samples: Sequence[str] = SAMPLE_NAMES, groups: Sequence[str] = GROUP_NAMES) -> DataFrame | None:
    """(sample, label), one row a sample, of the tables that have both columns; a later table wins, and in one table the largest label.

    Blanks around both are cut, and rows that lack either are left out. None if no table has both columns.
    """
    found = None
    for place, t in enumerate(tables):
        s, g = next((c for c in samples if c in t.columns), None), next((c for c in groups if c in t.columns), None)
        if s and g:
            rows = t.select(F.trim(F.col(s).cast("string")).alias("sample"), F.lit(place).alias("place"), F.trim(F.col(g).cast("string")).alias("label"))
            found = rows if found is None else found.union(rows)
    if found is None:
        return None
    return found.where("sample <> '' and label <> ''").groupBy("sample").agg(F.max(F.struct("place", "label")).label.alias("label"))


def with_labels(df: DataFrame, sample: str, tables: Sequence[DataFrame], fallback: Column, out: str = "group", samples: Sequence[str] = SAMPLE_NAMES, groups: Sequence[str] = GROUP_NAMES) -> DataFrame:
    """df with the label of each sample, or with ``fallback`` (say, its prefix) where no table has one."""
    labels = label_map(tables, samples, groups)
    if labels is None:
        return df.withColumn(out, fallback)
    d = df.withColumn(out, fallback).withColumn("_sample", F.trim(F.col(sample).cast("string")))
    j = d.join(labels.toDF("_sample", "_label"), "_sample", "left")
    return j.withColumn(out, F.coalesce("_label", out)).drop("_sample", "_label")


def side_file(df: DataFrame, files: DataFrame, folder: str, stem: str, name: str, out: str) -> DataFrame:
    """For each row of df the file of its folder with its own stem, else the folder's first file by name, else null.

    ``files`` has the usable files (folder, stem, name). Two joins on keys: the first
    file of a folder is an aggregate, so rows and files of a folder aren't paired.
    """
    own = files.groupBy(folder, stem).agg(F.min(name).alias("_own"))
    first = files.groupBy(folder).agg(F.min(name).alias("_first"))
    j = df.join(own, [folder, stem], "left").join(first, folder, "left")
    return j.withColumn(out, F.coalesce("_own", "_first")).drop("_own", "_first")


def leave_out(df: DataFrame, column: str, value, out: str = "split") -> DataFrame:
    """``val`` for rows of one centre, ``train`` for the others and for rows without a centre."""
    return df.withColumn(out, F.when(F.col(column) == value, "val").otherwise("train"))


def split_by_suffix(df: DataFrame, id: str, design: Mapping[int, str], out: str = "split") -> DataFrame:
    """The split that the design gives to the number at the end of an id, such as {1: train, 2: train, 3: test, 4: ext}; else null."""
    number = F.regexp_extract(F.col(id).cast("string"), r"(\d+)$", 1).try_cast("int")
    split = F.lit(None).cast("string")
    for n, name in design.items():
        split = F.when(number == n, name).otherwise(split)
    return df.withColumn(out, split)


def split_random(df: DataFrame, id: str, ratio: float = 0.2, seed: int = 0, out: str = "split") -> DataFrame:
    """``val`` for about that share of ids by a seeded hash, so a row's split doesn't depend on the other rows; else ``train``."""
    u = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn(out, F.when(u < ratio, "val").otherwise("train"))
