"""Removal of long strings that occur more than once, found by a hash-compared suffix sort.

A window is ``LENGTH`` bytes of one text. Each byte that lies in a window whose
bytes also stand anywhere else goes. Sorting every suffix of a corpus would move
it many times over, so only anchored suffixes are sorted: the anchor of a window
is the place in it where the ``GRAM`` bytes with the smallest hash begin, the first
of equals. Equal windows have their anchors at the same place, and neighbouring
windows mostly share one, so one anchor stands for a run of windows.

1. A pass over the texts gives the anchors with a hash of their gram and a digest
   of their run's bytes. Grams that occur once settle their windows.
2. Runs whose bytes occur again as a whole, by a BLAKE2 digest of 128 bits that
   stands for the bytes, are removed as a whole.
3. What is left, anchors at the edges of repeated passages, is compared: the
   bytes of these runs go to buckets of grams, where their suffixes are sorted by
   a mergesort that compares two suffixes in logarithmic time, by binary search
   over prefix polynomial hashes for their common extension. From its place in
   the order every suffix looks to both sides while the common extension suffices,
   finds the common extension to the left the same way, and what windows both give
   is compared byte by byte. Grams with more than ``CROWD`` such runs go another,
   exact way: their windows are counted by such digests in a Spark aggregation.

Repeated runs of words are found the same way: there each word stands as ``WORD``
bytes of a hash, so a run of ``LENGTH // WORD`` words is one string of LENGTH bytes,
however short its words are and whatever blanks are between them.

Cases: null counts as empty; texts under LENGTH bytes keep all. Rows that repeat
a text are copies of each other whether or not they repeat the doc_id. Overlapping
repeats inside one text count. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch, perhaps_among, ship

LENGTH, GRAM, CROWD = 400, 200, 2000
PIECE, RUNS = 1 << 18, 1000  # bytes whose anchors, and runs whose suffixes, a task holds at once
WORD = 8
_ODD = 0x9E3779B97F4A7C15
_BITS = np.uint64(21)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base % (1 << 64), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Polynomial hashes of any stretch of a byte array, modulo 2 ** 64."""

    up = down = np.empty(0, np.uint64)

    def __init__(self, x: np.ndarray, place: np.ndarray | None = None):
        n = int(place.max()) + 1 if place is not None and len(place) else len(x)
        if len(Hashes.up) <= n:
            Hashes.up, Hashes.down = _powers(n + 1, _ODD), _powers(n + 1, pow(_ODD, -1, 1 << 64))
        weight = self.up[: len(x)] if place is None else self.up[place]
        self.sum = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * weight, out=self.sum[1:])

    def of(self, start: np.ndarray, length, place: np.ndarray | None = None) -> np.ndarray:
        """Hash of each stretch; place: its start as counted in its own text."""
        return (self.sum[start + length] - self.sum[start]) * self.down[start if place is None else place]


def window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of v[i : i + w] for each i, by running minima of blocks from both sides."""
    m = -(-len(v) // w) * w
    p = np.full(m, np.iinfo(np.uint64).max)
    p[: len(v)] = v
    p = p.reshape(-1, w)
    head = np.minimum.accumulate(p, 1).ravel()
    tail = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: len(v) - w + 1], head[w - 1 : len(v)])


def digests(buffer: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the digest of each stretch of buffer."""
    view, of = memoryview(buffer), hashlib.blake2b
    halves = np.frombuffer(b"".join([of(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]), np.int64)
    return halves[::2], halves[1::2]


def anchors(buffer: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts that end at ``ends`` in buffer: text, anchor, gram hash, digest of the run in two halves, first and last window of each anchor's run."""
    x = np.frombuffer(buffer, np.uint8)
    if len(x) < length:
        return (np.empty(0, np.int64),) * 7
    h = Hashes(x)
    at = np.arange(len(x) - gram + 1)
    g = _mix(h.of(at, gram))
    low = (np.uint64(1) << _BITS) - np.uint64(1)
    least = window_minimum((g & ~low) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    ok = np.flatnonzero(start + length <= ends[text])
    if not len(ok):
        return (np.empty(0, np.int64),) * 7
    new = np.append(True, (np.diff(anchor[ok]) != 0) | (np.diff(ok) != 1) | (np.diff(text[ok]) != 0))
    first = ok[new]
    last = ok[np.append(np.flatnonzero(new)[1:], len(ok)) - 1]
    a = anchor[first]
    return text[first], a, g[a].view(np.int64), *digests(buffer, first, last + length), first, last


def word_limits(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw begin and end; ASCII blanks are between them."""
    x = np.frombuffer(raw, np.uint8)
    solid = np.concatenate([[False], (x != 32) & ((x < 9) | (x > 13)), [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def word_units(raw: bytes) -> bytes:
    """``WORD`` bytes for each word of raw, by a hash of its bytes."""
    start, end = word_limits(raw)
    if not len(start):
        return b""
    return _mix(Hashes(np.frombuffer(raw, np.uint8)).of(start, end - start)).tobytes()


def find_anchors(texts: DataFrame, length: int, gram: int, words: bool = False) -> DataFrame:
    """d, h, gram, run and run2 (digest), pos, first, last (places of windows) of each anchor of rows d, h, text; places count in word_units if words."""
    names = ["d", "h", "gram", "run", "run2", "pos", "first", "last"]

    def run(batches):
        for batch in batches:
            d, h = (batch.column(i).to_numpy() for i in (0, 1))
            parts, owner, offset, size = [], [], [], 0
            for i, t in enumerate(batch.column(2)):
                raw = (t.as_py() or "").encode()
                raw = word_units(raw) if words else raw
                for at in range(0, len(raw) - length + 1, PIECE):  # windows that begin in a piece
                    parts.append(raw[at : at + PIECE + length - 1])
                    owner.append(i)
                    offset.append(at)
                    size += len(parts[-1])
                    if size >= PIECE // 2:
                        yield out(d, h, parts, owner, offset)
                        parts, owner, offset, size = [], [], [], 0
            if parts:
                yield out(d, h, parts, owner, offset)

    def out(d, h, parts, owner, offset):
        ends = np.cumsum([len(p) for p in parts])
        text, a, g, r, r2, first, last = anchors(b"".join(parts), ends, length, gram)
        own, move = np.asarray(owner)[text], (np.asarray(offset) - (ends - [len(p) for p in parts]))[text]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (d[own], h[own], g, r, r2, a + move, first + move, last + move)], names)

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


class Runs:
    """Runs of windows around anchors, and the order of their suffixes from the anchor on."""

    def __init__(self, gram: np.ndarray, raw: list[bytes], left: np.ndarray):
        self.raw, self.left = raw, left.astype(np.int64)
        size = np.array([len(r) for r in raw], np.int64)
        self.off = np.cumsum(size) - size
        self.right = size - self.left  # bytes from the anchor on
        self.x = np.frombuffer(b"".join(raw), np.uint8)
        self.h = Hashes(self.x, np.arange(len(self.x)) - np.repeat(self.off, size))
        self.group = np.unique(gram, return_inverse=True)[1]

    def _same(self, i, j, back, length):
        a, b = self.left[i] - back, self.left[j] - back
        return self.h.of(self.off[i] + a, length, a) == self.h.of(self.off[j] + b, length, b)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes i and j, by binary search over their prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(i, j, 0, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes before the anchors of i and j."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.left[i], self.left[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(i, j, mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j: by group, then by bytes, the shorter first, then by number."""
        out = self.group[i] < self.group[j]
        k = np.flatnonzero(self.group[i] == self.group[j])
        p, q = i[k], j[k]
        n = self.ahead(p, q)
        ended = (n == self.right[p]) | (n == self.right[q])
        last = len(self.x) - 1
        c = self.x[np.minimum(self.off[p] + self.left[p] + n, last)].astype(np.int64) - self.x[np.minimum(self.off[q] + self.left[q] + n, last)].astype(np.int64)
        c = np.where(ended, self.right[p] - self.right[q], c)
        out[k] = np.where(c != 0, c < 0, p < q)
        return out

    def sorted(self) -> np.ndarray:
        """All suffixes in order, by a mergesort whose merges rank every suffix in the neighbouring run by binary search."""
        order, width, n = np.arange(len(self.raw)), 1, len(self.raw)
        place = np.arange(n)
        while width < n:
            block = place // width
            start, other = block * width, (block ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            top = high.copy()
            bottom = low.copy()
            while (open_ := bottom < top).any():
                k = np.flatnonzero(open_)
                mid = (bottom[k] + top[k]) // 2
                less = self.before(order[mid], order[k])
                bottom[k] = np.where(less, mid + 1, bottom[k])
                top[k] = np.where(less, top[k], mid)
            to = np.minimum(start, other) + (place - start) + (bottom - low)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, width * 2
        return order

    def repeated(self, windows: np.ndarray, wanted: np.ndarray, length: int) -> list[tuple[int, int, int]]:
        """(run, a, b): windows that begin a to b bytes before the anchor stand in another run too. windows: their number in each run."""
        order = self.sorted()
        n, found = len(order), []
        common = self.ahead(order[:-1], order[1:]) if n > 1 else np.empty(0, np.int64)
        common = np.where(self.group[order[:-1]] == self.group[order[1:]], common, -1) if n > 1 else common
        far, near = self.left, self.left - windows + 1  # windows of a run begin near .. far bytes before the anchor
        have_a, have_b = np.full(n, 1 << 30), np.full(n, -1)
        for way in (1, -1):
            t = np.flatnonzero(wanted[order])
            here, reach = t.copy(), np.full(len(t), 1 << 30)
            while len(t):
                step = here if way > 0 else here - 1
                ok = (step >= 0) & (step < n - 1)
                t, here, reach, step = t[ok], here[ok], reach[ok], step[ok]
                reach, here = np.minimum(reach, common[step]), here + way
                i = order[t]
                ok = (reach >= length - far[i]) & ~((have_a[i] <= near[i]) & (have_b[i] >= far[i]))
                t, here, reach, i = t[ok], here[ok], reach[ok], i[ok]
                j = order[here]
                a, b = np.maximum(length - reach, near[i]), np.minimum(self.behind(i, j), far[i])
                for k in np.flatnonzero((a <= b) & ~((have_a[i] <= a) & (have_b[i] >= b))):
                    p, q, u, v = int(i[k]), int(j[k]), int(a[k]), int(b[k])
                    x, y = self.left[p] - v, self.left[q] - v
                    if self.raw[p][x : x + v - u + length] != self.raw[q][y : y + v - u + length]:
                        continue  # equal hashes of unequal bytes
                    found.append((p, u, v))
                    if v + 1 >= have_a[p] and u <= have_b[p] + 1 or have_b[p] < 0:
                        have_a[p], have_b[p] = min(have_a[p], u), max(have_b[p], v)
        return found


def _solve(length: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = Runs(pdf.gram.to_numpy(), pdf.raw.tolist(), (pdf.pos - pdf["first"]).to_numpy())
        found = runs.repeated((pdf["last"] - pdf["first"] + 1).to_numpy(), ~pdf.solved.to_numpy(), length)
        k = np.array([p for p, _, _ in found], int)
        pos = pdf.pos.to_numpy()[k]
        return pd.DataFrame({"d": pdf.d.to_numpy()[k], "h": pdf.h.to_numpy()[k], "s0": pos - np.array([v for _, _, v in found], int), "s1": pos - np.array([u for _, u, _ in found], int)})

    return solve


def repeated_windows(scratch: Scratch, texts: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(d, h, s0, s1): windows s0 to s1 of a text also stand elsewhere, of its word_units if words. texts: d, h, text and more columns."""
    found = scratch.cut(find_anchors(texts.select("d", "h", "text"), length, gram, words))
    # a table for each summary: then both sides of a join come from a plain exchange, whose large partitions Spark splits
    alike = (F.min("run") == F.max("run")) & (F.min("run2") == F.max("run2"))
    grams = scratch.cut(found.groupBy("gram").agg(F.count("*").alias("n"), alike.alias("same")).where("n > 1").drop("n"))
    again = scratch.cut(found.join(grams, "gram"))
    scratch.drop(found, grams)
    mixed = again.where("not same")
    by_run = scratch.cut(mixed.groupBy("gram", "run", "run2").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "pos")).alias("one")))
    crowd = scratch.cut(by_run.groupBy("gram").agg((F.count("*") > CROWD).alias("crowded"), F.min("n").alias("fewest")))
    left = scratch.cut(mixed.join(by_run.join(crowd, "gram"), ["gram", "run", "run2"]))
    scratch.drop(by_run, crowd)
    whole = again.where("same").select("d", "h", "first", "last").union(left.where("n > 1").select("d", "h", "first", "last")).toDF("d", "h", "s0", "s1")
    compare = left.where("fewest = 1 and (n = 1 or one = struct(d, h, pos))").withColumn("solved", F.col("n") > 1)
    wanted = scratch.cut(compare.groupBy("d", "h").agg(F.collect_set(F.struct("gram", "pos", "first", "last", "solved", "crowded")).alias("runs")))
    n = compare.count()
    schema = pa.schema([("gram", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("solved", pa.bool_()), ("crowded", pa.bool_()), ("raw", pa.binary())])

    def cut_out(batches):
        for batch in batches:
            names = batch.schema.names
            for d, h, text, runs in zip(*(batch.column(names.index(c)) for c in ("d", "h", "text", "runs"))):
                raw = text.as_py().encode()
                raw = word_units(raw) if words else raw
                rows = [{**r, "d": d.as_py(), "h": h.as_py(), "raw": raw[r["first"] : r["last"] + length]} for r in runs.as_py()]
                for at in range(0, len(rows), RUNS):
                    yield pa.RecordBatch.from_pylist(rows[at : at + RUNS], schema)

    near = perhaps_among(texts.select("d", "h", "text"), F.xxhash64("d", "h"), wanted.select(F.xxhash64("d", "h"))).where("perhaps").drop("perhaps")
    runs = near.join(wanted, ["d", "h"]).mapInArrow(cut_out, "gram long, d long, h long, pos long, first long, last long, solved boolean, crowded boolean, raw binary")
    buckets = max(1, n // RUNS)
    few = runs.where("not crowded").withColumn("bucket", F.pmod("gram", F.lit(buckets))).groupBy("bucket").applyInPandas(_solve(length), "d long, h long, s0 long, s1 long")
    out = whole.union(few)
    if left.where("crowded and fewest = 1").limit(1).count():
        out = out.union(_counted(runs.where("crowded"), length))
    return out


def _counted(runs: DataFrame, length: int) -> DataFrame:
    """The same for runs of crowded grams: their windows, counted by digests."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("s", pa.int64()), ("solved", pa.bool_())])

    def windows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = np.arange(r["last"] - r["first"] + 1)
                x, y = digests(r["raw"], at, at + length)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(k, r["d"])), pa.array(np.full(k, r["h"])), pa.array(at + r["first"]), pa.array(np.full(k, r["solved"]))], schema=schema)

    every = runs.mapInArrow(windows, "x long, y long, d long, h long, s long, solved boolean")
    twice = every.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return every.where("not solved").join(twice, ["x", "y"]).select("d", "h", F.col("s").alias("s0"), F.col("s").alias("s1"))


def _removed(windows: list[dict], length: int) -> list[list[int]]:
    """Maximal stretches [start, end) that the windows cover."""
    out: list[list[int]] = []
    for s0, s1 in sorted((w["s0"], w["s1"]) for w in windows):
        if out and s0 <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s1 + length)
        else:
            out.append([s0, s1 + length])
    return out


def _removed_words(raw: bytes, windows: list[dict], length: int) -> list[dict]:
    """The windows of word_units as windows of raw: whole words with the blanks after them, and those before the first word."""
    if not windows:
        return []
    start, _ = word_limits(raw)
    start = np.append(start, len(raw))
    start[0] = 0
    spans = [(start[-(-a // WORD)], start[b // WORD]) for a, b in _removed(windows, length)]
    return [{"s0": int(a), "s1": int(b)} for a, b in spans]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    return docs.select("doc_id", key.alias("d"), F.xxhash64("doc_id", text).alias("h"), text.alias("text"), *more)


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, more: tuple[str, ...] = (), words: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and what is left as text if wanted.

    With words, runs of ``length // WORD`` words that stand twice go too, with the
    blanks after each word; words are equal by a hash of 64 bits.
    With keep_text the left bytes are read as UTF-8 again; a stretch that begins or
    ends inside a character takes the whole character with it.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = _keyed(docs, *more)
    found = repeated_windows(scratch, texts, length).withColumn("words", F.lit(False))
    if words:
        of_words = Scratch(docs.sparkSession, "words")
        found = scratch.last(found)
        runs = of_words.last(repeated_windows(of_words, texts, length, words=True))
        found = found.union(runs.withColumn("words", F.lit(True)))
    windows = scratch.last(found.groupBy("d", "h").agg(F.collect_list(F.struct("s0", "s1", "words")).alias("windows")))
    if words:
        of_words.drop(runs)
    # texts without windows stay where they are
    marked = perhaps_among(texts, F.xxhash64("d", "h"), windows.select(F.xxhash64("d", "h")))
    there = marked.where("perhaps").join(windows, ["d", "h"], "left").select("doc_id", "text", "windows", *more)
    joined = there.union(marked.where("not perhaps").select("doc_id", "text", F.lit(None).cast(windows.schema["windows"].dataType).alias("windows"), *more))
    kept = [docs.schema[c] for c in ("doc_id", *more)]
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    fields = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    schema = StructType([*kept, *fields, *([StructField("text", StringType())] if keep_text else [])])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            rows = []
            for text, ws in zip(batch.column(names.index("text")), batch.column(names.index("windows"))):
                raw = text.as_py().encode()
                ws = ws.as_py() or []
                spans = _removed([w for w in ws if not w["words"]], length)
                if words:
                    own = [{"s0": a, "s1": b} for a, b in spans]
                    spans = _removed(own + _removed_words(raw, [w for w in ws if w["words"]], length), 0)
                left, at = [], 0
                for a, b in spans:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), *([b"".join(left).decode(errors="ignore")] if keep_text else [])))
            columns = list(zip(*rows)) if rows else [()] * (4 + keep_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            same = [batch.column(names.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)
