"""Collocations: phrases whose words stand together more often than their parts suggest, by exact counts of all phrases.

Counts come from tries of phrases. A task keeps word ids in a shallow trie
(``PhraseTrie``): the first levels are nodes by word id, below them hash containers
hold the remaining words with a count, and a container that grows over ``BURST``
entries becomes a node of containers. A window of up to five words is one entry, as
each phrase is the beginning of exactly one window at each place where it stands.
When a task's trie is full, its largest subtrees are written whole, each one row: a
sorted run of what follows a first word. The runs of a first word are merged in
order; its phrases are the beginnings of its windows. The subtree of a very frequent
first word is cut into buckets by the two words after it (``crowded``), as many as its
share of all words asks for, so no prefix has to fit one task; its pairs, which then
lie in several buckets, are added up afterwards.

Two passes before keep the tries small without changing a count: a phrase that
stands ``least`` times has words and neighbouring pairs that do so, too. Words are
counted exactly; pairs of such words are counted by a hash. What reaches ``least`` is
set in a bitmap of fixed size (8 and 16 MiB). Windows end before a word or pair that
isn't in it. Two hashes that meet let more through, never less.

Cases: null texts are empty, a null lang is ``und``; an empty table gives no rows.
Rows that repeat an id, or have none, are texts of their own: doc_id isn't read.
Extra columns are dropped. A text is read as a whole; in memory are pieces of about
``SLICE`` bytes, and a longer one only if it has no mark that ends a piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neurotab.llm.common import LOWER, UPPER, Scratch, ship

BURST, DEPTH, ENTRIES, VOCABULARY = 512, 3, 400_000, 500_000  # entries of a container, levels of nodes, entries and words of a task
SLICE, PAIRS = 1 << 20, 1 << 22
WHOLE = -1  # the bucket of a subtree that isn't cut
WORD_BITS, PAIR_BITS = 26, 27
MASK = (1 << 63) - 1
MARKS = bytes(ord(".") if chr(i) in ".,;:!?\n\v\f\r" else i for i in range(256))


def slices(batches):
    """(lang, tokens) of parts of the texts; the token ``.`` stands between pieces and never is a word."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= SLICE:
                yield from _tokens(lang, held.pop(lang))
                sizes[lang] = 0
        for lang, texts in held.items():
            yield from _tokens(lang, texts)


def _tokens(lang: str, texts: list[bytes]):
    whole = b".".join(texts).lower().translate(MARKS)  # lower() of bytes changes A-Z only
    at = 0
    while at < len(whole):
        end = len(whole) if len(whole) - at <= 2 * SLICE else whole.find(b".", at + SLICE)
        end = len(whole) if end < 0 else end
        yield lang, whole[at:end].replace(b".", b" . ").split()
        at = end


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def key_of(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word) & MASK


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, key (a hash of both), n: occurrences of every word."""

    def run(batches):
        seen: dict[str, dict[bytes, int]] = {}

        def out():
            for lang, counts in seen.items():
                rows = list(counts.items())
                for i in range(0, len(rows), 20_000):
                    part = rows[i : i + 20_000]
                    columns = [pa.array([lang] * len(part)), pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([key_of(lang, w) for w, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "key", "n"])
            seen.clear()

        for lang, tokens in slices(batches):
            counts = seen.setdefault(lang, {})
            get = counts.get
            for t in tokens:
                counts[t] = get(t, 0) + 1
            counts.pop(b".", None)
            if sum(map(len, seen.values())) > VOCABULARY:
                yield from out()
        yield from out()

    return _texts(docs).mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap of 2^bits places with the low bits of each key set; its size doesn't depend on the number of keys."""
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    one = F.call_function("shiftleft", F.expr("1L"), low.bitwiseAND(63).cast("int"))
    words = keys.select(F.shiftright(low, 6).alias("at"), one.alias("one")).groupBy("at").agg(F.bit_or("one").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint8)


def within(map_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & (len(map_) * 8 - 1)
    return map_[low >> 3] >> (low & 7).astype(np.uint8) & 1 > 0


class Words(dict):
    """Ids of the frequent words of one language, from 1; 0 for all others and for the end of a piece."""

    def __init__(self, lang: str, frequent: np.ndarray, table: Table):
        super().__init__({b".": 0})
        self.lang, self.frequent, self.table = lang, frequent, table

    def __missing__(self, word: bytes) -> int:
        key = key_of(self.lang, word)
        low = key & (len(self.frequent) * 8 - 1)
        found = self[word] = self.table.add(self.lang, word, key) if self.frequent[low >> 3] >> (low & 7) & 1 else 0
        return found


class Table:
    """Words of a task by id, with their languages and keys."""

    def __init__(self, frequent: np.ndarray):
        self.frequent, self.langs, self.words, self.keys, self.by_lang = frequent, [""], [b""], np.zeros(1024, np.int64), {}

    def add(self, lang: str, word: bytes, key: int) -> int:
        at = len(self.words)
        if at == len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros(at, np.int64)])
        self.keys[at] = key
        self.langs.append(lang)
        # words are joined by a zero byte in runs, so that the windows of a prefix stand together in byte order
        self.words.append(word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1"))
        return at

    def ids(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        words = self.by_lang.setdefault(lang, Words(lang, self.frequent, self))
        return np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))

    def size(self) -> int:
        return sum(map(len, self.by_lang.values()))


def pair_keys(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of all neighbouring pairs; -1 where one of the two isn't a frequent word."""
    k = keys[ids].view(np.uint64)
    mixed = (k[:-1] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + (k[1:] ^ k[1:] >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return np.where((ids[:-1] > 0) & (ids[1:] > 0), (mixed >> np.uint64(1)).view(np.int64), -1)


def count_pairs(docs: DataFrame, frequent) -> DataFrame:
    """key, n: occurrences of the pairs of frequent words, by hash."""

    def run(batches):
        table, held, size = Table(frequent.value), [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["key", "n"])

        for lang, tokens in slices(batches):
            ids = table.ids(lang, tokens)
            keys = pair_keys(table.keys, ids)
            held.append(keys[keys >= 0])
            size += len(held[-1])
            if size > PAIRS:
                yield from out()
                held, size = [], 0
            if table.size() > VOCABULARY:
                table = Table(frequent.value)
        if size:
            yield from out()

    return _texts(docs).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Node(dict):
    """Children by word id: nodes or containers (plain dicts of remaining ids to counts); under 0 the container of what ends here."""


class PhraseTrie:
    """Counts of sequences of word ids: nodes above, hash containers below, which burst when full."""

    def __init__(self):
        self.root, self.size = Node(), 0

    def add(self, ids: tuple[int, ...], n: int) -> None:
        node, at = self.root, 0
        while True:
            head = ids[at] if at < len(ids) else 0
            at += 1
            child = node.get(head)
            if child is None:
                child = node[head] = {}
            if type(child) is not Node:
                break
            node = child
        tail = ids[at:]
        before = len(child)
        child[tail] = child.get(tail, 0) + n
        self.size += len(child) - before
        if len(child) > BURST and at < DEPTH and head:
            node[head] = self.burst(child)

    @staticmethod
    def burst(container: dict) -> Node:
        node = Node()
        for tail, n in container.items():
            node.setdefault(tail[0] if tail else 0, {})[tail[1:]] = n
        return node

    def entries(self, child: dict, before: tuple[int, ...]):
        """(ids, count) of a subtree."""
        if type(child) is Node:
            for head, below in child.items():
                yield from self.entries(below, (*before, head) if head else before)
        else:
            for tail, n in child.items():
                yield before + tail, n

    def spill(self, share: float):
        """Takes the largest subtrees of the root out, whole, until the share of entries is gone; yields each as a list of entries."""
        trees = sorted(((sum(1 for _ in self.entries(c, ())), h) for h, c in self.root.items()), reverse=True)
        left = self.size * (1 - share)
        for size, head in trees:
            if self.size <= left:
                break
            yield list(self.entries(self.root.pop(head), (head,)))
            self.size -= size


def windows(ids: np.ndarray, linked: np.ndarray, longest: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of two words or more as rows of ids (0 behind the end), and how often each stands."""
    at = np.flatnonzero(linked)
    w = np.zeros((len(at), longest), np.int32)
    w[:, 0], w[:, 1] = ids[at], ids[at + 1]
    on = np.ones(len(at), bool)
    for k in range(2, longest):
        there = at + k - 1 < len(linked)
        on &= there & linked[np.where(there, at + k - 1, 0)]
        w[on, k] = ids[at[on] + k]
    h = np.zeros(len(at), np.uint64)
    for k in range(longest):
        h = (h ^ keys[w[:, k]].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if not np.array_equal(w, w[first][which]):  # two windows of one hash
        return np.unique(w, axis=0, return_counts=True)
    return w[first], n


def crowded(often: DataFrame, words: DataFrame) -> dict[int, int]:
    """By key, into how many buckets the windows that begin with a very frequent word are dealt: no bucket holds much more than an eighth of a task's share."""
    parts = 8 * max(int(often.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    total = words.agg(F.sum("n")).first()[0] or 0
    return {r.key: -(-r.n * parts // total) for r in often.where(F.col("n") * parts > total).select("key", "n").collect()}  # fewer than parts rows


def runs(docs: DataFrame, frequent, pairs, buckets, longest: int) -> DataFrame:
    """lang, first, bucket, tails, counts: subtrees of the tasks' tries, each a sorted run of what follows the first word."""

    def run(batches):
        table, trie = Table(frequent.value), PhraseTrie()

        def rows(share):
            for tree in trie.spill(share):
                head = tree[0][0][0]
                split = buckets.value.get(int(table.keys[head]), 1)
                dealt: dict[int, list] = {}
                for ids, n in tree:
                    bucket = (int(table.keys[ids[1]]) + (3 * int(table.keys[ids[2]]) if len(ids) > 2 else 0)) % split if split > 1 else WHOLE
                    dealt.setdefault(bucket, []).append((b"\0".join([table.words[x] for x in ids[1:]]), n))
                for bucket, entries in dealt.items():
                    entries.sort()
                    yield table.langs[head], table.words[head], bucket, entries

        def out(share):
            held, size = [], 0
            for row in rows(share):
                held.append(row)
                size += len(row[3])
                if size > 50_000:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

        def batch(held):
            offsets = pa.array(np.cumsum([0, *(len(r[3]) for r in held)]), pa.int32())
            tails = pa.array([k for r in held for k, _ in r[3]], pa.binary()).cast(pa.string())
            counts = pa.array([n for r in held for _, n in r[3]], pa.int64())
            columns = [pa.array([r[0] for r in held]), pa.array([r[1] for r in held], pa.binary()).cast(pa.string()), pa.array([r[2] for r in held], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, tails), pa.ListArray.from_arrays(offsets, counts)], ["lang", "first", "bucket", "tails", "counts"])

        for lang, tokens in slices(batches):
            ids = table.ids(lang, tokens)
            keys = pair_keys(table.keys, ids)
            found, counts = windows(ids, (keys >= 0) & within(pairs.value, keys), longest, table.keys)
            for row, n in zip(found.tolist(), counts.tolist()):
                trie.add(tuple(row[: row.index(0)] if row[-1] == 0 else row), n)
            if trie.size > ENTRIES:
                yield from out(0.5)
            if table.size() > VOCABULARY:
                yield from out(1.0)
                table = Table(frequent.value)
        yield from out(1.0)

    return _texts(docs).mapInArrow(run, "lang string, first string, bucket int, tails array<string>, counts array<long>")


def prefixes(entries: list[tuple[bytes, int]], least: int, part: bool):
    """(beginning, count) of all beginnings of sorted windows that stand least times, and of part of a subtree those of one word anyhow, as it goes on elsewhere."""
    path: list[bytes] = []
    sums: list[int] = []
    for window, n in [*entries, (None, 0)]:
        words = window.split(b"\0") if window is not None else []
        same = 0
        while same < len(path) and same < len(words) and path[same] == words[same]:
            same += 1
        while len(path) > same:
            count = sums.pop()
            if count >= least or (part and len(path) == 1):
                yield b" ".join(path), count
            path.pop()
        for k in range(same):
            sums[k] += n
        path.extend(words[same:])
        sums.extend([n] * (len(words) - same))


def merge(spilled: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n of all phrases of two words or more that stand least times: the runs of a prefix partition are merged in order."""
    parts = max(int(spilled.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        at, held, found = None, [], []

        def close():
            if at is not None:
                held.sort()  # merges sorted runs
                plain = lambda w: w.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1")
                found.extend((at[0], plain(at[1] + b" " + phrase), n) for phrase, n in prefixes(held, least, at[2] != WHOLE))
                held.clear()

        def out():
            columns = [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.binary()).cast(pa.string()), pa.array([r[2] for r in found], pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

        for b in batches:
            tails, counts = b.column("tails"), b.column("counts")
            keys = zip(b.column("lang").to_pylist(), b.column("first").cast(pa.binary()).to_pylist(), b.column("bucket").to_pylist())
            for i, key in enumerate(keys):
                if key != at:
                    close()
                    at = key
                held.extend(zip(tails[i].values.cast(pa.binary()).to_pylist(), counts[i].values.to_pylist()))
            if len(found) > 10_000:
                yield out()
        close()
        yield out()

    by = ["lang", "first", "bucket"]
    found = spilled.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mine(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the top phrases of each language of rows of (text, lang).

    A phrase is cut into two parts where a * n / (l * r) is smallest. Phrases inside
    longer ones that stand ``share`` percent as often or more are left out.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "phrases")
    words = scratch.cut(count_words(docs))
    totals = scratch.cut(words.groupBy("lang").agg(F.sum("n").alias("total")))
    often = scratch.cut(words.where(F.col("n") >= least))
    frequent = spark.sparkContext.broadcast(bitmap(often, WORD_BITS))
    pairs = spark.sparkContext.broadcast(bitmap(count_pairs(docs, frequent).where(F.col("n") >= least), PAIR_BITS))
    buckets = spark.sparkContext.broadcast(crowded(often, words))
    spilled = scratch.cut(runs(docs, frequent, pairs, buckets, longest))
    long_ = scratch.cut(merge(spilled, least))
    scratch.drop(words, spilled)

    counts = often.select("lang", F.col("word").alias("phrase"), "n").union(long_)
    split = long_.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    both = cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("cast(1000 as decimal(4, 0)) * (cast(a as decimal(16, 0)) * cast(total as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "total")).alias("m"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: F.array_join(F.slice("w", s, m), " "))))
    inside = split.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.lit(100) * F.col("outer") < F.lit(share) * F.col("a")))
    rows = scratch.cut(kept.select("lang", "phrase", "a", "m.l", "m.r", F.col("m.total").alias("n"), "m.score"))
    scratch.drop(often, long_, totals)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    some = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> str:
    """The same in SQL."""
    return rf"""
WITH t AS (SELECT row_number() OVER () d, coalesce(lang,'und') lang, translate(coalesce(text,''),'{UPPER}','{LOWER}') t FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM p),
e AS (SELECT lang, w, unnest(range(1, len(w)+1)) i FROM w WHERE len(w)>0),
g AS (SELECT lang, m, list_slice(w, i, i+m-1) g FROM e, range(1, {longest + 1}) r(m) WHERE i+m-1<=len(w)),
c AS MATERIALIZED (SELECT lang, m, g, count(*)::bigint n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::bigint n FROM c WHERE m=1 GROUP BY lang),
f AS MATERIALIZED (SELECT * FROM c WHERE n>={least}),
k AS (SELECT lang, g, n a, unnest(range(1, m)) k FROM f WHERE m>1),
s AS (SELECT k.lang, k.g, k.a, k.k, x.n l, y.n r, total.n, ((1000::hugeint*k.a*total.n)//(x.n::hugeint*y.n))::bigint score
  FROM k JOIN f x ON x.lang=k.lang AND x.g=list_slice(k.g,1,k.k) JOIN f y ON y.lang=k.lang AND y.g=list_slice(k.g,k.k+1,len(k.g)) JOIN total ON total.lang=k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k)=1),
o AS (SELECT DISTINCT x.lang, y.g FROM f x JOIN f y ON x.lang=y.lang AND y.m>1 AND x.m>y.m AND 100*x.n>={share}*y.n
  AND len(list_filter(range(1, x.m-y.m+2), lambda i: list_slice(x.g, i, i+y.m-1)=y.g))>0)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g,' ')) AS rank, array_to_string(g,' ') phrase, a, l, r, n, score
FROM b ANTI JOIN o USING (lang, g) QUALIFY rank<={top}"""
