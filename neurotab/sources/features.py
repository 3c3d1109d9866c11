"""Data source of feature arrays: .npy files and keyed .npz archives, a partition a range of rows."""

from __future__ import annotations

import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KEYS = ("X", "features")  # fixed values: names of the array, the first that is there


class Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class FeatureSource(DataSource):
    """``spark.read.format("features")``: options path (one .npy or .npz file) and rows (a partition, 65,536).

    Rows are (row, features). An array of one dimension has one feature a row. An
    archive without one of the keys, another suffix or an array of objects or of more
    than two dimensions is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "row long, features array<double>"

    def reader(self, schema) -> DataSourceReader:
        return FeatureReader(self.options)


def _open(path: str):
    import os

    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    return files.open_input_file(at)


class _Header:
    """Shape, type and place of an array, from the first bytes of a .npy file."""

    def __init__(self, f):
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.dtype = read(f)
        self.start = f.tell()
        if self.dtype.hasobject or len(self.shape) not in (1, 2):
            raise ValueError("features must be an array of numbers with one or two dimensions")
        self.width = self.shape[1] if len(self.shape) == 2 else 1


class FeatureReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 1 << 16))
        if not self.path.lower().endswith((".npy", ".npz")):
            raise ValueError("features must be a .npy or .npz file")

    def _member(self, f):
        """The array's bytes: the file itself, or a member of the archive, which is unpacked as it is read."""
        if self.path.lower().endswith(".npy"):
            return f
        archive = zipfile.ZipFile(f)
        for key in KEYS:
            if f"{key}.npy" in archive.namelist():
                return archive.open(f"{key}.npy")
        raise ValueError(f"the archive must contain {' or '.join(KEYS)}")

    def partitions(self):
        with _open(self.path) as f:
            n = _Header(self._member(f)).shape[0]
        return [Rows(self.path, i, min(i + self.rows, n)) for i in range(0, n, self.rows)] or [Rows(self.path, 0, 0)]

    def read(self, part: Rows):
        with _open(self.path) as f:
            member = self._member(f)
            h = _Header(member)
            n, size = part.stop - part.start, h.dtype.itemsize
            if h.fortran and h.width > 1:  # columns one after another: a range of rows is a piece of each
                pieces = []
                for c in range(h.width):
                    member.seek(h.start + (c * h.shape[0] + part.start) * size)
                    pieces.append(np.frombuffer(member.read(n * size), h.dtype))
                x = np.stack(pieces, 1) if pieces else np.empty((n, 0))
            else:
                member.seek(h.start + part.start * h.width * size)
                x = np.frombuffer(member.read(n * h.width * size), h.dtype).reshape(n, h.width)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * h.width)
        lists = pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float64).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.stop)), lists], ["row", "features"])
