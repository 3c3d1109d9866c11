"""Many trace files in one job: what fails stays with its file, as a row.

Files are read as bytes and decoded inside tasks; an error of a file becomes its row
(file, ok, error), and the job goes on. What is decoded is one long table of all
files, on which the usual operators work by chunks, so no file's trace is gathered
again after it was decoded.
"""

from __future__ import annotations

import gzip
import io
import re
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab.operators import signal
from neurotab.sources.shared import settled

SAMPLES = "file string, error string, idx long, t_sec double, value double"


def decode(name: str, content: bytes, columns: tuple[str, str] | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a CSV trace: the named columns, or without names the first two, where a first line that isn't numbers is a header.

    Raises ValueError with the reason if the file is empty, lacks a column, has a cell
    that isn't a number or under ``least`` samples; .gz files are unpacked.
    """
    if name.endswith(".gz"):
        content = gzip.decompress(content)
    if not content.strip():
        raise ValueError("the file is empty")
    table = pd.read_csv(io.BytesIO(content), header=0 if columns else None, dtype=str, keep_default_na=False)
    if columns:
        missing = [c for c in columns if c not in table.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        table = table[list(columns)]
    elif table.shape[1] < 2:
        raise ValueError("under two columns")
    else:
        table = table.iloc[:, :2]
        head = pd.to_numeric(table.iloc[0], errors="coerce")
        table = table.iloc[1:] if head.isna().any() else table
    numbers = np.column_stack([pd.to_numeric(table.iloc[:, i], errors="coerce").to_numpy(float) for i in (0, 1)])
    bad = np.flatnonzero(~np.isfinite(numbers).all(1))
    if len(bad):
        raise ValueError(f"sample {bad[0]} isn't a pair of numbers")
    if len(numbers) < least:
        raise ValueError(f"{len(numbers)} samples, {least} are needed")
    return numbers[:, 0], numbers[:, 1]


def write_traces(df: DataFrame, folder: str, key: str, order: str) -> int:
    """Writes the rows of each key by ``order`` as a CSV file ``<key>=<value>.csv`` of the other columns; gives the number of files.

    All files are in one folder, so listing them is one call. Tasks write through
    pyarrow's file systems, under another name first: a file is there when it is whole.
    """
    names = [c for c in df.columns if c != key]

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        attempt, here, n, sink, out = TaskContext.get().taskAttemptId(), None, 0, None, None

        def close():
            out.close()
            sink.close()
            files.move(f"{here}.{attempt}", here)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            start = np.flatnonzero(signal.first_rows(table, [key])) if batch.num_rows else np.empty(0, int)
            for a, b in zip(start.tolist(), [*start[1:].tolist(), batch.num_rows]):
                path = f"{base}/{key}={quote(str(batch.column(key)[a].as_py()), safe='')}.csv"
                part = table.slice(a, b - a).select(names)
                if path != here:
                    if out is not None:
                        close()
                    here, n = path, n + 1
                    sink = files.open_output_stream(f"{path}.{attempt}")
                    out = csv.CSVWriter(sink, part.schema)
                out.write_table(part)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_batch(spark: SparkSession, folder: str, pattern: str = "*.csv", columns: tuple[str, str] | None = None, least: int = 64, fs: float = 20000.0, largest: int = 1 << 30) -> DataFrame:
    """file, error, idx, t_sec, value: the samples of all files in a tree, and of each failed file one row that has only its error.

    Times that don't rise strictly within a file are idx / fs instead. Files over
    ``largest`` bytes aren't read: that is their error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for name, content in zip(batch.column("path"), batch.column("content")):
                name = name.as_py()
                try:
                    t, x = decode(name, content.as_py(), columns, least)
                except Exception as e:  # any failure of a file is its result
                    yield part([([name], [f"{type(e).__name__}: {e}"], [None], [None], [None])])
                    continue
                t = t if (np.diff(t) > 0).all() else np.arange(len(x)) / fs
                for i in range(0, len(x), 1 << 18):
                    p = slice(i, i + (1 << 18))
                    k = len(x[p])
                    held.append((pa.repeat(pa.scalar(name), k), pa.nulls(k, pa.string()), np.arange(i, i + k), t[p], x[p]))
                    n += k
                    if n >= 1 << 16:  # small files share a batch
                        yield part(held)
                        held, n = [], 0
            if held:
                yield part(held)

    def part(held: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "error": pa.string(), "idx": pa.int64(), "t_sec": pa.float64(), "value": pa.float64()}
        columns = [pa.concat_arrays([pa.array(h[i], k) for h in held]) for i, k in enumerate(kinds.values())]
        return pa.RecordBatch.from_arrays(columns, list(kinds))

    large = files.where(F.col("length") > largest).select(F.col("path").alias("file"), F.concat(F.lit("ValueError: "), F.col("length").cast("string"), F.lit(f" bytes, at most {largest} are read")).alias("error"))
    read = files.where(F.col("length") <= largest).select("path", "content").mapInArrow(run, SAMPLES)
    # Spark's scans skip files of no bytes, so these are told from the names that its listing has
    plain = lambda name: unquote(re.sub("^file:/+", "file:/", name))
    names = spark.createDataFrame([(plain(name),) for name in files.inputFiles()], "file string")
    empty = names.join(files.select(F.col("path").alias("file")), "file", "left_anti").withColumn("error", F.lit("ValueError: the file is empty"))
    return read.unionByName(large, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)


def sort_batch(spark: SparkSession, folder: str, pattern: str = "*.csv", columns: tuple[str, str] | None = None, fs: float = 20000.0, low: float = 300.0, high: float = 6000.0, threshold: float = 4.0, refractory: int = 20, side: int = 20, least: int = 64) -> DataFrame:
    """file, ok, error, n_samples, n_spikes, isi_violation, snr_baseline of each file of a tree.

    Band-pass, threshold in units of the MAD scale, refractory rule, waveforms of
    ``side`` samples on both sides and their quality, for all good files together.
    A file that fails has zero samples and spikes and no quality.
    """
    samples = settled(read_batch(spark, folder, pattern, columns, least, fs))
    good = samples.where("error is null").select("file", F.col("idx").alias("i"), "value")
    filtered = settled(signal.bandpass(good, ["file"], "i", "value", fs, low, high))
    spikes = signal.detect_spikes(filtered, ["file"], "i", "filtered", threshold, refractory)
    waves = signal.waveforms(spikes, filtered, ["file"], "i", "filtered", side, side)
    quality = signal.cluster_quality(spikes, waves, ["file"], "i", fs).select("file", "n_spikes", "isi_violation", "snr_baseline")
    per = samples.groupBy("file").agg(F.max("error").alias("error"), F.count("idx").alias("n_samples"))
    return per.join(quality, "file", "left").select("file", F.col("error").isNull().alias("ok"), "error", "n_samples", F.coalesce("n_spikes", F.lit(0)).alias("n_spikes"), "isi_violation", "snr_baseline")


def tally(results: DataFrame) -> DataFrame:
    """One row: processed, failed and the failures as (file, error), sorted by file."""
    failures = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("file", "error"))))
    return results.agg(F.count(F.when(F.col("ok"), 1)).alias("processed"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), failures.alias("failures"))
