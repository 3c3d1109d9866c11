"""Readers of the file layouts of recordings, abundance matrices, clinical tables, points and images, and sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = r"(?i)^(NC|HS|ZS|QC)\d+$"


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_trace(spark: SparkSession, path: str, time: str = "Filtered (1) Timestamps", value: str = "Filtered (1) Values") -> DataFrame:
    """recording_id, t_sec, value of single-channel CSV files with a header."""
    df = require(spark.read.csv(path, header=True), [time, value])
    cell = lambda c: F.col(f"`{c}`").try_cast("double")
    return df.select(F.input_file_name().alias("recording_id"), cell(time).alias("t_sec"), cell(value).alias("value"))


def read_headerless_trace(spark: SparkSession, path: str, pick: str = "second", fs: float | None = None) -> DataFrame:
    """The same from files without a header; rows whose picked cells aren't numbers, headers among them, are dropped.

    pick ``second``: time is column 1 and the value column 2. ``third``: the value is
    column 3 of three or more, else column 1. ``last``: the last column. Of the latter
    two, time is the row's number in its file over ``fs`` (null without fs); each
    file's rows are numbered, in the order of the file, so files aren't split then.
    """
    if pick == "second":
        df = spark.read.csv(path, header=False)
        return df.select(F.input_file_name().alias("recording_id"), F.col("_c0").try_cast("double").alias("t_sec"), F.col("_c1").try_cast("double").alias("value")).where("t_sec is not null and value is not null")
    if pick not in ("third", "last"):
        raise ValueError("pick must be second, third or last")
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("recording_id"), F.posexplode(F.split("value", "\r?\n")).alias("_i", "_line"))
    cells = F.split("_line", ",")
    cell = F.element_at(cells, -1) if pick == "last" else F.when(F.size(cells) >= 3, F.get(cells, F.lit(2))).otherwise(F.get(cells, F.lit(0)))
    rows = whole.select("recording_id", "_i", F.trim(cell).try_cast("double").alias("value")).where("value is not null")
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("_i")) - 1
    return rows.select("recording_id", (number / F.lit(fs) if fs else F.lit(None).cast("double")).alias("t_sec"), "value")


def with_time_axis(df: DataFrame, keys: Sequence[str], index: str, time: str, fs: float) -> DataFrame:
    """``time`` where it rises strictly within its key, else index / fs."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_up", F.coalesce(F.col(time) > F.lag(time).over(w.orderBy(index)), F.lit(True)))
    return d.withColumn(time, F.when(F.min("_up").over(w), F.col(time)).otherwise(F.col(index) / fs)).drop("_up")


def read_eeg_text(spark: SparkSession, path: str, columns: Sequence[int] = (*range(1, 9), 11), sep: str = ",") -> DataFrame:
    """Chosen columns of a text export without header whose comment lines begin with %."""
    df = spark.read.csv(path, header=False, comment="%", sep=sep, ignoreLeadingWhiteSpace=True)
    return df.select(*(F.col(f"_c{i}").try_cast("double").alias(f"ch{i}") for i in columns))


def read_wide_signal(spark: SparkSession, path: str, time: str = "time_from_stim_s", pattern: str = ".*", before: float | None = None) -> DataFrame:
    """t_sec, channel, value from one column a channel; with ``before``, samples before that time only, so that a scan can leave out the rest."""
    df = require(spark.read.csv(path, header=True, inferSchema=True), [time])
    df = df if before is None else df.where(F.col(time) < before)
    names = [c for c in df.columns if c != time and re.search(pattern, c)]
    return df.unpivot([time], names, "channel", "value").withColumnRenamed(time, "t_sec")


def aligned(df: DataFrame, time: str, onset: Column | float, fs: float | None = None, width: float | None = None, step: float | None = None, start: float = 0.0) -> DataFrame:
    """``time`` counted from the onset. With fs the column is a sample number; with width and step it is a window's number, whose time is its centre, start + i * step + width / 2."""
    at = F.col(time).cast("double")
    if width is not None and step is not None:
        at = F.lit(start) + at * step + width / 2
    elif fs:
        at = at / fs
    return df.withColumn(time, at - onset)


def read_clinical(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    return require(spark.read.csv(path, header=True, inferSchema=True), required)


def violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value isn't one of those allowed, case ignored; null counts as one."""
    return df.where(~F.coalesce(F.lower(F.trim(F.col(column))).isin(*[a.lower() for a in allowed]), F.lit(False)))


def rename_first(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Renames, for each wanted name, the first candidate column that exists; blanks around headers are ignored."""
    have = {c.strip(): c for c in df.columns}
    for want, candidates in names.items():
        got = next((have[c] for c in candidates if c in have), None)
        if got and got != want:
            df = df.withColumnRenamed(got, want)
    return df


def abundance(df: DataFrame, label: str = "Group", sample: str = "ID", name: str = "Metabolites", keep_qc: bool = False) -> DataFrame:
    """feature, sample_id, group, value from either layout: sample rows if the label column is there, feature rows if three columns or more look like samples.

    Features without name take their ID or F and their number; repeated names get __2, __3 by their order.
    """
    if label in df.columns:
        features = [c for c in df.columns if c not in (label, sample)]
        cast = df.select(F.col(sample).cast("string").alias("sample_id"), F.col(label).alias("group"), *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in features))
        out = cast.unpivot(["sample_id", "group"], features, "feature", "value")
    else:
        samples = [c for c in df.columns if re.match(SAMPLE, c)]
        if len(samples) < 3:
            raise ValueError("neither a label column nor three sample columns")
        number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
        blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        d = df.withColumn("_i", number)
        d = d.withColumn("_n", F.coalesce(blank(name) if name in df.columns else F.lit(None).cast("string"), blank(sample) if sample in df.columns else F.lit(None).cast("string"), F.concat(F.lit("F"), F.col("_i").cast("string"))))
        again = F.row_number().over(Window.partitionBy("_n").orderBy("_i"))
        d = d.select(F.when(again == 1, F.col("_n")).otherwise(F.concat_ws("__", "_n", again.cast("string"))).alias("feature"), *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in samples))
        out = d.unpivot(["feature"], samples, "sample_id", "value").withColumn("group", F.upper(F.regexp_extract("sample_id", "(?i)^(NC|HS|ZS|QC)", 1)))
    out = out.select("feature", "sample_id", "group", "value")
    return out if keep_qc else out.where("group <> 'QC'")


def point_features(df: DataFrame) -> DataFrame:
    """x, y, z, feats from either array layout: coords (three numbers), e_field and anatomy (a number or an array each), or points (three numbers and then features); other columns are kept."""
    if {"coords", "e_field", "anatomy"} <= set(df.columns):
        parts = [F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(c) for c in ("e_field", "anatomy")]
        place, feats, used = F.col("coords"), F.concat(*(p.cast("array<double>") for p in parts)), ("coords", "e_field", "anatomy")
    elif "points" in df.columns:
        place, feats, used = F.col("points"), F.slice("points", F.lit(4), F.greatest(F.size("points") - 3, F.lit(0))).cast("array<double>"), ("points",)
    else:
        raise ValueError("neither coords, e_field and anatomy nor points are there")
    return df.select(*(c for c in df.columns if c not in used), *(F.get(place, F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyz")), feats.alias("feats"))


def points(df: DataFrame) -> DataFrame:
    """x, y, z by name whatever their case, else the first three columns."""
    by = {c.lower(): c for c in df.columns}
    names = [by[c] for c in "xyz"] if all(c in by for c in "xyz") else df.columns[:3]
    return df.select(*(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(names, "xyz")), *(f"`{c}`" for c in df.columns if c not in names))


def audit(tables: Mapping[str, DataFrame], rows: int = 200, columns: int = 50) -> DataFrame:
    """A row a table: its QC columns, its sample columns, whether one of its first cells says QC."""
    out = None
    for name, df in tables.items():
        cells = [F.coalesce(F.col(f"`{c}`").cast("string").rlike(r"\bQC\b"), F.lit(False)) for c in df.columns[:columns]]
        one = df.limit(rows).agg(F.coalesce(F.max(F.exists(F.array(*cells), lambda x: x)), F.lit(False)).alias("has_qc_cell"))
        qc, samples = ([c for c in df.columns if re.match(p, c)] for p in (r"(?i)^QC", SAMPLE))
        one = one.select(F.lit(name).alias("table"), F.lit(",".join(qc)).alias("qc_columns"), F.lit(len(samples)).alias("n_samples"), "has_qc_cell")
        out = one if out is None else out.union(one)
    return out


def read_images(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """origin, height, width, nChannels, data (BGR) of images whose name matches; files that aren't images are skipped."""
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    return df.where(F.col("origin").rlike(pattern))


def find_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, modificationTime and length of files below path whose name matches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")


def write_results(df: DataFrame, path: str, metadata: Mapping[str, str] | None = None, format: str = "parquet") -> None:
    """Writes a table and, beside it, a one-row JSON table of the run's settings."""
    df.write.mode("overwrite").format(format).option("header", True).save(path)
    if metadata:
        spark = df.sparkSession
        spark.createDataFrame([tuple(map(str, metadata.values()))], [*metadata]).coalesce(1).write.mode("overwrite").json(f"{path}-metadata")
