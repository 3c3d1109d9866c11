"""SentencePiece encoding and decoding by suffix-array matching.

Handled are BPE models with byte fallback, an identity normalizer and a dummy
prefix, in whose pieces the blank mark stands in front only. Then a text falls
into units, a run of marks and what follows it, that are encoded on their own. The
units of a batch that are new are joined to one byte text; its suffixes are sorted
by doubling, every piece of the vocabulary finds the range of suffixes that begin
with it by binary search, and each occurrence is an edge. Edges are sorted by
position and relaxed: a place is reached by the one edge whose piece may follow
the piece by which its start was reached, where a piece may follow another if the
two together are encoded as just these two. That is what merging the best pair
again and again gives, because a merge across the border of two final pieces would
also happen with the two alone.

Cases: null counts as empty, and an empty text has no ids. Characters outside the
vocabulary become the ids of their bytes. The blank mark itself in a text is
encoded as a blank, and so decoded as one. Repeated rows each get a result.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from neurotab.llm.common import ship
from neurotab.llm.tokens import grouped

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` bytes or more."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1])).astype(np.uint64) + np.uint64(1)
        after = np.zeros(n, np.uint64)
        after[: max(n - have, 0)] = rank[have:]
        key, have = rank << np.uint64(32) | after, have * 2


class Model:
    """A model's pieces, and the units that were encoded before (at most ``most``)."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = sp.get_piece_size()
        name = [sp.id_to_piece(i) for i in range(self.n)]
        plain = [i for i in range(self.n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in name[i].lstrip(MARK) for i in plain) or not any(sp.is_byte(i) for i in range(self.n)):
            raise ValueError("only models with byte fallback whose pieces have blank marks in front are handled")
        self.byte = {int(name[i][3:5], 16): i for i in range(self.n) if sp.is_byte(i)}
        self.id = {name[i]: i for i in plain}
        self.name, self.score = name, {name[i]: sp.get_score(i) for i in plain}
        self.out = [bytes([int(name[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else name[i].encode() for i in range(self.n)]
        self.single = {p for p in self.id if len(p) == 1}
        self.outside = re.compile("([^" + re.escape("".join(sorted(self.single))) + "]+)")
        raw = [self._bytes(name[i]) for i in plain]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        self.sorted_ids, self.lengths = np.array([plain[i] for i in order]), np.array([len(raw[i]) for i in order])
        self.depth = int(self.lengths.max())
        self.words = -(-self.depth // 8)
        table = np.zeros((len(raw), self.words * 8), np.uint8)
        for k, i in enumerate(order):
            table[k, : len(raw[i])] = np.frombuffer(raw[i], np.uint8)
        self.table = table.view(">u8").astype(np.uint64)
        mask = np.where(np.arange(self.words * 8) < self.lengths[:, None], np.uint8(255), np.uint8(0))
        self.mask = np.ascontiguousarray(mask).view(">u8").astype(np.uint64)
        self.follows: dict[int, bool] = {}
        self.pair, self.verdict = np.full(1 << 20, np.iinfo(np.int64).min), np.zeros(1 << 20, bool)
        self.known: dict[str, bytes] = {}
        self.most = most

    @staticmethod
    def _bytes(text: str) -> bytes:
        return text.replace(MARK, " ").encode()  # no blank is left where marks stand for them

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, the first of equals, again and again."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: int, piece: int) -> bool:
        """Whether piece may stand after last, or, where that is -1, begin a unit."""
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        t = [self.name[piece]] if last < 0 else [self.name[last], self.name[piece]]
        out = self.follows[last * self.n + piece] = self.merged("".join(t)) == t
        return out

    def edges(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place of the end in its unit, start, end and id of every occurrence of every piece, sorted by the first; starts: of the units."""
        order = suffix_array(data, self.depth)
        padded = np.concatenate([data, np.zeros(self.words * 8 + 8, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(data) + self.words * 8, np.uint64)
        for i in range(8):
            word = word << np.uint64(8) | padded[i : i + len(word)]

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(self.table), np.int64), np.full(len(self.table), len(order), np.int64)
            while (low < high).any():
                mid = (low + high) // 2
                at = order[np.minimum(mid, len(order) - 1)]
                less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for w in range(self.words):
                    s = word[at + 8 * w] & self.mask[:, w]
                    less |= equal & (s < self.table[:, w])
                    equal &= s == self.table[:, w]
                right = (less | (equal & upper)) & (low < high)
                low, high = np.where(right, mid + 1, low), np.where(right | (low >= high), high, mid)
            return low

        first, last = bound(False), bound(True)
        n = last - first
        k = np.repeat(np.arange(len(n)), n)
        start = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)]
        end = start + self.lengths[k]
        unit = np.zeros(len(data), np.int64)
        unit[starts] = np.diff(starts, prepend=0)
        level = end - np.cumsum(unit)[start]
        if len(level) and level.max() < 1 << 16:
            level = level.astype(np.uint16)  # sorts in linear time
        by = np.argsort(level, kind="stable")
        return level[by].astype(np.int64), start[by], end[by], self.sorted_ids[k][by]

    def chosen(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """may_follow of many pairs, by a table of the pairs met before; pairs of one slot take turns in it."""
        key = last * self.n + piece
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        ok, miss = self.verdict[slot], np.flatnonzero(self.pair[slot] != key)
        if len(miss):
            every, back = np.unique(key[miss], return_inverse=True)
            find = self.follows.get
            got = np.array([self.may_follow(*divmod(k, self.n)) if (f := find(k)) is None else f for k in every.tolist()])
            ok[miss] = got[back]
            self.pair[slot[miss]], self.verdict[slot[miss]] = key[miss], ok[miss]
        return ok

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids, as bytes of int32, of units all of whose characters are pieces. Edges are relaxed by their end, in all units side by side."""
        raw = [self._bytes(u) for u in units]
        data = np.frombuffer(b"\xff" + b"\xff".join(raw) + b"\xff", np.uint8)
        size = np.array([len(r) for r in raw])
        starts = np.cumsum(size + 1) - size
        last, back = np.full(len(data), -2), np.zeros(len(data), np.int64)  # -2: not reached
        last[starts] = -1
        level, start, end, piece = self.edges(data, starts)
        border = np.flatnonzero(np.diff(level, prepend=-1, append=-1))
        for i, j in zip(border.tolist(), border[1:].tolist()):
            before = last[start[i:j]]
            k = np.flatnonzero(before > -2)
            k = k[self.chosen(before[k], piece[i + k])] + i
            last[end[k]], back[end[k]] = piece[k], start[k]
        n, place, open_ = np.zeros(len(units), np.int64), starts + size, np.arange(len(units))
        found = []
        while len(open_):
            found.append((open_, last[place[open_]]))
            n[open_] += 1
            place[open_] = back[place[open_]]
            open_ = open_[place[open_] > starts[open_]]
        cut = np.cumsum(n)
        ids, at = np.empty(cut[-1] if len(cut) else 0, np.int32), cut.copy()
        for of, p in found:  # from the end of a unit to its begin
            at[of] -= 1
            ids[at[of]] = p
        whole, cut = ids.tobytes(), (cut * 4).tolist()
        return [whole[x:y] for x, y in zip([0, *cut], cut)]

    def learn(self, units: set[str], span: int = 1 << 20) -> dict[str, bytes]:
        """Ids, as bytes of int32, of units."""
        odd = {u: [p for p in self.outside.split(u) if p] for u in units if self.outside.search(u)}
        plain = sorted({*units.difference(odd), *(p for ps in odd.values() for p in ps if p[0] in self.single)})
        ids: dict[str, bytes] = {}
        for part in grouped(plain, span):
            ids.update(zip(plain[part], self.encode_units(plain[part])))
        # what is outside the vocabulary goes byte by byte
        take = lambda p: ids[p] if p in ids else array("i", [self.byte[b] for b in p.encode()]).tobytes()
        ids.update([(u, b"".join(map(take, ps))) for u, ps in odd.items()])
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {u for us in units for u in us if u not in self.known}
        known = self.known
        if new:
            if len(known) + len(new) > self.most:
                # the known units of this batch stay in use through a copy
                known = {u: known[u] for us in units for u in us if u in known}
                self.known = {}
            got = self.learn(new)
            known.update(got)
            if known is not self.known and len(known) <= self.most:
                self.known = known
        find = known.__getitem__
        return [np.frombuffer(b"".join(map(find, us)), np.int32) for us in units]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding gives the text again) of each document; ``path`` is the .model file on every machine."""
    ship(docs.sparkSession)

    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in grouped(texts, 1 << 22):
                ids = m.encode(texts[s])
                same = [m.decode(i.tolist()) == t.replace(MARK, " ") for i, t in zip(ids, texts[s])]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The other columns of rows, and ``text`` decoded from its ids; null ids give null."""
    ship(rows.sparkSession)
    from pyspark.sql.types import StringType, StructField, StructType

    others = [f for f in rows.schema.fields if f.name not in (ids, "text")]

    def run(batches):
        m = model(path)
        for batch in batches:
            got = [None if x is None else m.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(f.name)) for f in others), pa.array(got, pa.string())], [*(f.name for f in others), "text"])

    return rows.select(*(f.name for f in others), ids).mapInArrow(run, StructType([*others, StructField("text", StringType())]))
