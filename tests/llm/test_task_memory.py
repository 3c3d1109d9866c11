"""What a task holds at once while it works on texts doesn't grow with them."""

import tracemalloc

import pyarrow as pa

from neurotab.llm import neardup, substrings


class Tasks:
    """A table whose mapInArrow gives the function that tasks run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak(run, batch):
    """MB at once beside what is there, and rows."""
    tracemalloc.start()
    n = sum(b.num_rows for b in run([batch]))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, n


def test_texts_are_worked_on_by_slices(spark):
    texts = [" ".join(f"w{(k * k + i) % 7919}x" for i in range(3000)) for k in range(250)]
    own = pa.array(range(len(texts)), pa.int64())
    most, n = peak(substrings.find_anchors(Tasks(spark), 400, 200), pa.RecordBatch.from_arrays([own, own, pa.array(texts)], ["d", "h", "text"]))
    assert n > len(texts) and most < 60
    most, n = peak(neardup.sketches(Tasks(spark), 5), pa.RecordBatch.from_arrays([own, pa.array(texts)], ["doc_id", "text"]))
    assert n == len(texts) and most < 60
