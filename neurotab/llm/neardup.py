"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function orders all shingles. A document's sketch is its ``SKETCH``
smallest shingle hashes. Its runs of ``RUN`` neighbouring values go to inverted
lists: a list of one value alone would hold every document with a common word pair
or passage. Of two documents with Jaccard similarity s, each of the smallest values
of their union is shared with probability s, and what is shared side by side there
stands side by side in both sketches. So at 0.8 a pair has no run of three in common
with probability 9e-8 (48 trials without such a run), and less above. Where sets are
so small that unshared values could break every run, a rule of counting says which
(``runs``), they are listed by shorter runs as well; sets of up to ``SKETCH`` values
miss nothing. For lower thresholds runs are shorter, down to single values.

Lists of up to ``LONG`` members give all their pairs. In longer lists, as large groups
of copies or common passages make them, members are checked against the smallest one
first. Where a list is then more than one component, its members are paired anew by
their rarest values only (``across``).

Pairs whose sizes rule the similarity out go; then those whose union sketch (the
``SKETCH`` smallest hashes of both) estimates it below ``LEAST_ESTIMATE``, over
four standard deviations under the threshold; the rest is verified on full sets,
which are sets of 64-bit hashes of the shingles.

Cases: null and empty texts, and texts of blanks, have no shingle, link with
nothing and are kept. A text of fewer words than a shingle is one shingle.
Equal sets are copies: one class, whose smallest doc_id stands for it. Rows that
repeat a doc_id count as one document and so are linked; of their sets the one of
smallest digest is compared with others. A row without doc_id is neither compared
nor linked; it has no component and is kept. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch, components, perhaps_among, ship
from neurotab.llm.tokens import grouped

SKETCH, RUN, LONG, LEAST_ESTIMATE = 48, 3, 64, 0.54
MISS = 1e-6  # chance that two large sets at the threshold have no run in common
WIDE, SLACK, SALTS, PART = 512, 0.1, 16, 256  # values of members of long lists, and what their shared share may lack; parts of a long list, at least so many members each
ODD = 1024  # bits of an odd sketch
PLACES = 24  # bits of the most places at which values are counted
SLICE = 1 << 18  # characters whose words a task holds at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.empty(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A hash whose bits all depend on all bits of h (the finisher of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(n, _ODD)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (signed) of each text."""
    raw = [t.encode() + b" " for t in texts]
    x = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(r) for r in raw])
    word = ~_BLANK[x]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # bytes from the end of a word weigh by powers, so a word's hash doesn't depend on its place
    length = end - start
    place = np.repeat(end, length) - 1 - _ranges(start, length)
    top = int(length.max()) if len(length) else 0
    v = (x[word].astype(np.uint64) + np.uint64(1)) * _powers(top + 1)[place]
    h = _mix(np.add.reduceat(v, np.cumsum(length) - length) + length.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    cut = np.searchsorted(start, ends)
    out, at = [], 0
    for c in cut:
        w = h[at:c]
        k = min(size, len(w))
        s = np.zeros(max(len(w) - k + 1, 0) if k else 0, np.uint64)
        for i in range(k):
            s = s * _ODD + w[i : len(w) - k + 1 + i]
        out.append(np.unique(_mix(s + np.uint64(k)).view(np.int64)))
        at = c
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - start, length)


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the whole set, null for none), sketch."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in grouped(texts, SLICE):
                sets = shingle_sets(texts[s], size)
                sketch = [x[:SKETCH] for x in sets]
                offsets = np.cumsum([0, *map(len, sketch)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketch)))
                ids = [_digest(x.tobytes()) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sketch array<long>")


def _marked(scratch: Scratch, lists: DataFrame) -> DataFrame:
    """Rows of lists of two or more, with their number as members. The counts are a table, so that Spark may split a long list's rows in the join."""
    counts = scratch.cut(lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    marked = scratch.cut(lists.join(counts, "key"))
    scratch.drop(counts)
    return marked


def _pairs(lists: DataFrame) -> DataFrame:
    """All pairs a < b of members of a list."""
    one = lists.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"))
    two = lists.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"))
    return one.join(two, "key").where("a < b").select("a", "b", "n_a", "n_b")


def _leaders(lists: DataFrame) -> DataFrame:
    """(key, a, n_a): the smallest member of each list."""
    first = lists.groupBy("key").agg(F.min(F.struct("id", "n")).alias("f"))
    return first.select("key", F.col("f.id").alias("a"), F.col("f.n").alias("n_a"))


def runs(percent: int) -> list[tuple[int, int | None]]:
    """(length, size): sets of up to that size (None: all sets) are listed by runs of that length."""
    p = percent / 100

    def missed(r: int) -> float:
        """Chance of no r shared values in a row among SKETCH."""
        at = [1.0] + [0.0] * (r - 1)  # by the shared values just before
        for _ in range(SKETCH):
            at = [sum(at) * (1 - p), *(x * p for x in at[:-1])]
        return sum(at)

    def broken(r: int) -> int:
        """The largest union, of those that sketches hold whole, whose unshared values can stand so that no run of r is left."""
        shared = lambda n: -(-n * percent // 100)
        return max((n for n in range(1, SKETCH + 1) if shared(n) < n and shared(n) <= (r - 1) * (n - shared(n) + 1)), default=0)

    length = next(r for r in range(RUN, 0, -1) if r == 1 or missed(r) <= MISS)
    out: list[tuple[int, int | None]] = [(length, None)]
    while length > 1 and broken(length):
        out.append((length - 1, broken(length)))
        length -= 1
    return out


def candidates(scratch: Scratch, reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify, and the long lists (key, id, n) of which so far only pairs with the smallest member are among them."""
    listed = []
    for length, most in runs(percent):
        rows = reps.where(F.size("sketch") >= length).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("sketch") - length + 1)))
        key = F.xxhash64(F.lit(length), *(F.element_at("sketch", F.col("i") + k) for k in range(length)))
        listed.append((rows if most is None else rows.where(F.col("n") <= most)).select("id", "n", key.alias("key")))
    marked = _marked(scratch, reduce(DataFrame.union, listed))
    short, long = (marked.where(F.col("members") <= LONG).drop("members"), marked.where(F.col("members") > LONG).drop("members"))
    members = long.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"))
    leaders = scratch.cut(_leaders(long))
    leading = members.join(leaders, "key").where("a < b").select("a", "b", "n_a", "n_b")
    pairs, long_lists = scratch.cut(_fits(_pairs(short).union(leading), percent)), scratch.cut(long.select("key", "id", "n"))
    scratch.drop(leaders, marked)
    return pairs, long_lists


def _fits(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes leave the similarity possible."""
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, n, s) for the documents (id, set_id) wanted: size of the set, and as bytes all its hashes in order."""
    texts = perhaps_among(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), F.col("id"), wanted.select("id"))
    texts = texts.where("perhaps").join(wanted, "id").select("id", "set_id", "text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for s in grouped(texts, SLICE):
                sets = shingle_sets(texts[s], size)
                own = [_digest(x.tobytes()) == d for x, d in zip(sets, batch.column(1)[s.start : s.stop].to_pylist())]
                columns = [batch.column(0)[s.start : s.stop], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s"]).filter(pa.array(own, pa.bool_()))

    return texts.mapInArrow(run, "id long, n long, s binary").dropDuplicates(["id"])


def smallest(sets: DataFrame, most: int) -> DataFrame:
    """(id, n, s, odd) with s as an array of its ``most`` smallest hashes, and odd the odd sketch of the whole set: bit i says whether an odd number of hashes end in i."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            odd = [np.packbits((np.bincount(x & (ODD - 1), minlength=ODD) & 1).astype(np.uint8)).view(np.int64) for x in sets]
            lists = [pa.array(v, pa.list_(pa.int64())) for v in ([x[:most] for x in sets], odd)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], ["id", "n", "s", "odd"])

    return sets.select("id", "n", "s").mapInArrow(run, "id long, n long, s array<long>, odd array<long>")


def odd_fits(a: list[Column], b: list[Column], n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether two odd sketches (the words of each) leave the similarity possible.

    They differ in one bit at most for each value that only one set holds, which
    alike sets have ``most`` of. Where these are many, bits cancel out: the number of
    different bits is then 5 standard deviations over its mean at most.
    """
    differ = reduce(Column.__add__, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)))
    most = (n_a + n_b) * (100 - percent) / float(100 + percent)
    mean, deviation = ODD / 2 * (1 - F.exp(-most * (2 / ODD))), ODD**0.5 / 2 * F.sqrt(1 - F.exp(-most * (4 / ODD)))
    return (differ <= most) & (differ <= mean + 5 * deviation)


def estimated(scratch: Scratch, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their union sketch doesn't rule out."""
    sketch = reps.select("id", "sketch")
    both = pairs.join(sketch.toDF("a", "x"), "a").join(sketch.toDF("b", "y"), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    return scratch.cut(both.where(shared >= LEAST_ESTIMATE * F.size(union)).select("a", "b"))


def verify(scratch: Scratch, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets, as (src, dst)."""
    sets = sets.select("id", "s")
    joined = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["src", "dst"])

    links = scratch.cut(joined.select("a", "b", "x", "y").mapInArrow(check, "src long, dst long"))
    scratch.drop(near)
    return links


def value_classes(wide: DataFrame) -> np.ndarray:
    """How many sets hold a value, as a class of one byte for each place that hashed values have: 0 for one set at most, else it rises with the logarithm.

    Each task sends the places of its values with their numbers as arrays, and a
    place's sum is at least the number of each of its values. The places are as many
    as there are values, 2^``PLACES`` at most, so what the driver gets is bounded.
    """
    total = wide.agg(F.sum(F.size("s"))).first()[0] or 1
    bits = min(PLACES, max(16, int(total).bit_length()))
    cut = bits - 8  # 256 blocks of places

    def count(batches):
        at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = batch.column(0).flatten().to_numpy() & ((1 << bits) - 1)
            at, where = np.unique(np.concatenate([at, more]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, np.ones(len(more), np.int64)])).astype(np.int64)
            if len(at) > 1 << 21:
                yield out(at, n)
                at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at):
            yield out(at, n)

    def out(at, n):
        blocks, first = np.unique(at >> cut, return_index=True)
        own = [slice(a, b) for a, b in zip(first, [*first[1:], len(at)])]
        lists = [pa.array([v[s].astype(np.int32) for s in own], pa.list_(pa.int32())) for v in (at & ((1 << cut) - 1), n)]
        return pa.RecordBatch.from_arrays([pa.array(blocks), *lists], ["block", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        at, n = (table[c].combine_chunks().flatten().to_numpy() for c in ("at", "n"))
        held = np.bincount(at, n, 1 << cut)
        classes = np.where(held > 1, np.minimum(255, np.ceil(8 * np.log2(np.maximum(held, 1)))), 0).astype(np.uint8)
        return pa.table({"block": pa.array([table["block"][0].as_py()]), "classes": pa.array([classes.tobytes()], pa.binary())})

    parts = wide.select("s").mapInArrow(count, "block long, at array<int>, n array<int>").groupBy("block").applyInArrow(add, "block long, classes binary")
    classes = np.zeros(1 << bits, np.uint8)
    for r in parts.collect():
        classes[r.block << cut : (r.block + 1) << cut] = np.frombuffer(r.classes, np.uint8)
    return classes


def prefixes(wide: DataFrame, percent: int) -> DataFrame:
    """(v, id, n, i, o0, o1, ...): the values that a set is listed by, with their places i in the order of all its values and its odd sketch.

    The order is one of all values, from those that few sets hold to those that many
    hold. A value that no other set holds takes its place in the order but isn't listed.
    """
    classes = wide.sparkSession.sparkContext.broadcast(value_classes(wide))
    odd = [f"o{k}" for k in range(ODD // 64)]

    def run(batches):
        table = classes.value
        for batch in batches:
            found, places = [], []
            for n, s in zip(batch.column(1).to_pylist(), batch.column(2)):
                v = s.values.to_numpy()
                whole = n + (-percent * n // 100) + 1 if n <= WIDE else 0
                part = min(n, WIDE) - int((percent / 100 - SLACK) * WIDE) + 1 if 100 * n > percent * WIDE else 0
                of = table[v & (len(table) - 1)]
                first = np.lexsort((v, of))[: max(whole, part)]
                places.append(np.flatnonzero(of[first]))
                found.append(v[first[places[-1]]])
            row = pa.array(np.repeat(np.arange(len(found)), [len(v) for v in found]))
            words = np.array(batch.column(3).to_pylist(), np.int64).reshape(-1, len(odd)).T
            own = [pa.array(np.ascontiguousarray(w)).take(row) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate([np.zeros(0, np.int64), *places]), pa.int32()), *own], ["v", "id", "n", "i", *odd])

    return wide.select("id", "n", "s", "odd").mapInArrow(run, ", ".join(["v long, id long, n long, i int", *(f"{o} long" for o in odd)]))


def across(scratch: Scratch, long: DataFrame, reached: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar, of members of long lists with several components, not in one component yet.

    A prefix filter over the ``WIDE`` smallest values of each set, which are all of
    most: of two sets that share c of their n values, the n - c + 1 that the fewest
    members hold have one in common. So documents that share no more than a common
    passage don't meet. Where sets are whole this misses nothing; of larger ones c is
    taken ``SLACK`` below the threshold, five standard deviations. In the lists of
    these values, members outside the largest component meet all others, in ``SALTS``
    parts where a list is long; where both sets are whole, a pair whose places in the
    order of values rule the similarity out goes. Inside that join the odd sketches of
    the whole sets (``odd_fits``) keep only pairs close to the threshold or above it.
    """
    labels = long.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labels = scratch.cut(labels.select("key", "id", "component"))
    mixed = scratch.cut(labels.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key"))
    members = scratch.cut(labels.join(mixed, "key").select("id", "component").distinct())
    wide = scratch.cut(smallest(sets.join(members.select("id"), "id", "left_semi"), WIDE))
    scratch.drop(labels, mixed)
    words = range(ODD // 64)
    odd = [f"o{k}" for k in words]
    rows = prefixes(wide, percent).join(members, "id")
    listed = scratch.cut(rows.select("v", "id", "n", "i", "component", *odd))
    sizes = listed.groupBy("v", "component").agg(F.count("*").alias("m"))
    heads = sizes.groupBy("v").agg(F.max(F.struct("m", "component")).alias("h"), F.count("*").alias("k"), F.sum("m").alias("members")).where("k > 1")
    heads = scratch.cut(heads.select("v", F.col("h.component").alias("head"), F.least(F.lit(SALTS), F.ceil(F.col("members") / PART)).cast("int").alias("parts")))
    members = listed.join(heads, "v")
    y = members.select("v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("i").alias("j"), F.col("component").alias("c_b"), *(F.col(f"o{k}").alias(f"y{k}") for k in words))
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    x = members.where("component <> head").select("v", every_part, F.col("id").alias("a"), F.col("n").alias("n_a"), "i", F.col("component").alias("c_a"), "head", *(F.col(f"o{k}").alias(f"x{k}") for k in words))
    # a pair outside the largest component is met from both sides: once is enough
    other = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("head")) | (F.col("a") < F.col("b")))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    most = F.least("i", "j") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j"))
    placed = (F.greatest("n_a", "n_b") > WIDE) | ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    close = odd_fits(*([F.col(f"{side}{k}") for k in words] for side in "xy"), F.col("n_a"), F.col("n_b"), percent)
    found = x.join(y, ["v", "part"]).where(other & fits & placed & close)
    more = scratch.cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(wide, listed, heads)
    return more


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    found = scratch.cut(sketches(docs, size))
    sets = found.where("set_id is not null and doc_id is not null")
    # one row for each class of equal sets, and of those one for each doc_id
    classes = scratch.cut(sets.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    first = classes.select("set_id", "id")
    reps = scratch.cut(classes.groupBy("id").agg(F.min(F.struct("set_id", "n", "sketch")).alias("r")).select("id", "r.*"))
    pairs, long = candidates(scratch, reps, percent)
    near = estimated(scratch, pairs, reps)
    scratch.drop(pairs)
    # texts are shuffled once, for all sets that pairs and long lists need, and few others
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).union(long.select("id")).distinct()
    wanted = scratch.cut(wanted.join(reps.select("id", "set_id"), "id"))
    whole = scratch.cut(full_sets(docs, wanted, size))
    scratch.drop(wanted)
    links = verify(scratch, near, whole, percent)
    reached = components(scratch, links)
    if long.limit(1).count():
        more = across(scratch, long, reached, whole, percent)
        links = links.union(verify(scratch, estimated(scratch, more, reps), whole, percent))
        reached = components(scratch, links)
        scratch.drop(more)
    scratch.drop(whole, reps, long)
    # members of a class go where its smallest document goes
    component_of = first.join(reached, first.id == reached.node, "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "set_id").join(component_of, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return scratch.last(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


#: The same rows for two-word shingles in SQL for DuckDB, every pair that shares a shingle counted.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w)<2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1]) END) sh FROM d)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.sh=b.sh AND a.doc_id<b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*c>=80*(x.n+y.n-c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b=e.a),
m AS (SELECT a, min(b) m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) component_id, d.doc_id=least(d.doc_id, coalesce(m.m, d.doc_id)) kept
FROM d LEFT JOIN n ON n.doc_id=d.doc_id LEFT JOIN m ON m.a=d.doc_id"""
