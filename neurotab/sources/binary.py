"""Data source of interleaved multichannel recordings: one partition a byte range that holds whole samples."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class InterleavedSource(DataSource):
    """``spark.read.format("interleaved")``: options path, channels, dtype (int16), offset (0), samples (a partition, 2**20)."""

    @classmethod
    def name(cls) -> str:
        return "interleaved"

    def schema(self) -> str:
        return "sample_idx long, channel int, value double"

    def reader(self, schema) -> DataSourceReader:
        return InterleavedReader(self.options)


class InterleavedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.channels = options["path"], int(options["channels"])
        self.dtype, self.offset, self.samples = np.dtype(options.get("dtype", "int16")), int(options.get("offset", 0)), int(options.get("samples", 1 << 20))
        self.width = self.channels * self.dtype.itemsize

    def partitions(self):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + os.path.abspath(self.path))
        size = files.get_file_info(at).size - self.offset
        if size % self.width:
            raise ValueError(f"{size} bytes aren't a whole number of samples of {self.width} bytes")
        n = size // self.width
        return [Range(self.path, i, min(i + self.samples, n)) for i in range(0, n, self.samples)] or [Range(self.path, 0, 0)]

    def read(self, part: Range):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(part.path if "://" in part.path else "file://" + os.path.abspath(part.path))
        n = part.stop - part.start
        with files.open_input_file(at) as f:
            x = np.frombuffer(f.read_at(n * self.width, self.offset + part.start * self.width), self.dtype)
        idx = np.repeat(np.arange(part.start, part.stop), self.channels)
        channel = np.tile(np.arange(self.channels, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(channel), pa.array(x.astype(np.float64))], ["sample_idx", "channel", "value"])
