"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic transducers stand for the tokenizer:

* The splitter reads character classes (with one or two characters of look-ahead
  folded into the class) and marks where a word of the tokenizer's pattern
  begins. It has eight states, so any chunk of text is a map of eight states to
  eight states. Chunks are mapped side by side, the maps compose by a parallel
  prefix scan, and a second pass from the known states gives the marks.
* The counter reads the bytes of a word. After any prefix it knows how many
  tokens the prefix has, because BPE tokens of a longer prefix are those of a
  shorter one and one more: the one that can stand after the last token there. A
  state keeps only the places from which a vocabulary entry can still grow, with
  the last token before each and the count since; each transition is annotated
  with the number of tokens it adds. Transitions are compiled when first needed
  and kept in a table of bounded size.

Cases: null counts as empty; an empty text has no bytes and no tokens. Special
strings inside a text count as one token and split it. Repeated rows each get
their result, extra columns are dropped, and texts of any length are read whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from neurotab.llm.common import ship

FRESH, LETTER, NUMBER, OTHER, BLANK, PREFIX, ONE, TWO = range(8)
#: Symbols: letter, number, other, apostrophe before one or two letters of a contraction, space before text, other blank before text, blank before blank or end, end of a text.
L, N, O, A1, A2, S, B, M, END = range(9)
BIAS, SHIFT = 40, 6  # a table entry is next state << SHIFT | tokens added + BIAS


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark by symbol * 8 + state."""
    fresh = {L: LETTER, N: NUMBER, O: OTHER, A1: ONE, A2: TWO, S: PREFIX, B: FRESH, M: BLANK, END: FRESH}
    goes_on = {LETTER: {L: LETTER}, NUMBER: {N: NUMBER}, OTHER: {O: OTHER, A1: OTHER, A2: OTHER}, BLANK: {M: BLANK}, PREFIX: {L: LETTER, N: NUMBER, O: OTHER, A1: OTHER, A2: OTHER}, ONE: {L: FRESH}, TWO: {L: ONE}}
    to, mark = np.zeros(72, np.uint8), np.zeros(72, bool)
    for sym in range(9):
        for state in range(8):
            on = goes_on.get(state, {}).get(sym)
            to[sym * 8 + state], mark[sym * 8 + state] = (fresh[sym], sym != END) if on is None else (on, False)
    return to, mark


TO, MARK = _splitter()


class _Classes:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 space, 4 other blank; 5 at 0x110000, the end of a text.

    What is a letter is asked of the tokenizer library itself, whose tables of
    characters are of another Unicode version than Python's, plane by plane as
    texts need it.
    """

    def __init__(self):
        self.of, self.known = np.full(0x110001, 2, np.uint8), set()
        self.of[0x110000] = 5

    def __call__(self, cp: np.ndarray) -> np.ndarray:
        for plane in set(np.flatnonzero(np.bincount(cp >> 16, minlength=17)[:17]).tolist()) - self.known:
            self.learn(plane)
        return self.of[cp]

    def learn(self, plane: int) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        cps = np.array([c for c in range(plane << 16, plane + 1 << 16) if not 0xD800 <= c < 0xE000])
        every = "".join(map(chr, cps.tolist()))
        for value, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (4, r"\s+")):
            inside = np.ones(len(cps), bool)
            for _, (start, end) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
                inside[start:end] = False
            self.of[cps[inside]] = value
        self.of[0x20] = 3
        self.known.add(plane)


classes = _Classes()


def symbols(cp: np.ndarray) -> np.ndarray:
    """The splitter's symbols of code points in which 0x110000 ends each text."""
    cls = classes(cp)
    after = np.append(cls[1:], 5)
    text_next = after < 3
    sym = np.choose(cls, [L, N, O, S, B, END]).astype(np.uint8)
    sym[((cls == 3) | (cls == 4)) & ~text_next] = M
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        padded = np.append(cp, [0x110000, 0x110000])
        x, y = padded[at + 1], padded[at + 2]
        sym[at[np.isin(x, [ord(c) for c in "stmd"])]] = A1
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        sym[at[two]] = A2
    return sym


def marks(sym: np.ndarray, size: int = 256) -> np.ndarray:
    """Where words begin: chunk maps of the splitter, composed by prefix scan, then a pass from known states."""
    n, c = len(sym), -(-len(sym) // size)
    by_step = np.full(c * size, END, np.uint8)
    by_step[:n] = sym
    by_step = np.ascontiguousarray(by_step.reshape(c, size).T).astype(np.intp) * 8
    maps = np.tile(np.arange(8, dtype=np.uint8), (c, 1))
    for row in by_step:
        maps = TO[row[:, None] + maps]
    d = 1
    while d < c:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
        d *= 2
    state = np.append(np.uint8(FRESH), maps[:-1, FRESH])
    out = np.empty((size, c), bool)
    for i, row in enumerate(by_step):
        k = row + state
        out[i], state = MARK[k], TO[k]
    return out.T.ravel()[:n]


class _Full(Exception):
    pass


class Counter:
    """The counting transducer of one tokenizer file; at most ``most`` states are kept."""

    def __init__(self, path: str, most: int = 200_000):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE files without normalizer and prefix space are handled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.child: dict[tuple[int, int], int] = {}
        self.token: list[bytes | None] = [None]
        self.grows = [True]
        for t in model["vocab"]:
            if t in self.special:
                continue
            node, b = 0, raw(t)
            for x in b:
                self.grows[node] = True
                if (node, x) not in self.child:
                    self.child[node, x] = len(self.token)
                    self.token.append(None)
                    self.grows.append(False)
                node = self.child[node, x]
            self.token[node] = b
        self.follows: dict[tuple[bytes | None, bytes], bool] = {}
        self.most = most
        self.reset()

    def reset(self) -> None:
        start = ((0, None, 0),)
        self.states, self.ids = [start], {start: 0}
        self.column, self.used = np.full(256, -1, np.int64), 0  # bytes get columns as they turn up
        self.table = np.full((1 << 12, 128), -1, np.int32)

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens of a short text by merging the pair of least rank again and again."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: bytes | None, t: bytes) -> bool:
        if (last, t) not in self.follows:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[last, t] = self.merged((last or b"") + t) == ([t] if last is None else [last, t])
        return self.follows[last, t]

    def step(self, chain: tuple, b: int) -> tuple[tuple, int]:
        """The state after one more byte, and the tokens that it adds. chain: (trie node, last token before it, tokens since), longest first."""
        grown = [(self.child.get((node, b)), last, since) for node, last, since in chain]
        for node, last, since in grown:
            if node is not None and self.token[node] is not None and self.may_follow(last, self.token[node]):
                new, added = self.token[node], 1 - since
                return (*((n, x, s + added) for n, x, s in grown if n is not None and self.grows[n]), (0, new, 0)), added
        raise ValueError("no token of the vocabulary ends here")

    def compile(self, state: int, b: int) -> int:
        chain, added = self.step(self.states[state], b)
        if chain not in self.ids:
            if len(self.states) >= self.most:
                raise _Full
            if len(self.states) == len(self.table):
                self.table = np.concatenate([self.table, np.full((min(len(self.table), self.most - len(self.table)), self.table.shape[1]), -1, np.int32)])
            self.ids[chain] = len(self.states)
            self.states.append(chain)
        self.table[state, self.column[b]] = out = self.ids[chain] << SHIFT | added + BIAS
        return out

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start : start + length]; all words step together."""
        try:
            return self._together(data, start, length)
        except _Full:
            self.reset()
            if len(start) > 1:
                h = len(start) // 2
                return np.concatenate([self.count(data, start[:h], length[:h]), self.count(data, start[h:], length[h:])])
            chain, n = self.states[0], 0
            for b in data[start[0] : start[0] + length[0]].tolist():
                chain, added = self.step(chain, b)
                n += added
            return np.array([n])

    def _together(self, data, start, length):
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)):
            if self.used == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], 1)
            self.column[b], self.used = self.used, self.used + 1
        wide, at = self.table.shape[1], self.column[data].astype(np.uint8)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, n, most = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), int(length[0]) if len(length) else 0
        active = len(start) - np.searchsorted(length[::-1], np.arange(most), side="right")
        k = 0
        while k < most and active[k] > 8:
            a = active[k]
            key = state[:a] * wide + at[start[:a] + k]
            got = self.table.ravel()[key]
            if got.min() < 0:
                missing = np.flatnonzero(got < 0)
                for i in missing[np.unique(key[missing], return_index=True)[1]].tolist():
                    self.compile(int(state[i]), int(data[start[i] + k]))
                got = self.table.ravel()[key]
            n[:a] += (got & 63) - BIAS
            state[:a] = got >> SHIFT
            k += 1
        for i in range(int(active[k]) if k < most else 0):  # the few longest, one by one
            s, total = int(state[i]), 0
            for b in data[start[i] + k : start[i] + length[i]].tolist():
                e = self.table.item(s, int(self.column[b]))
                e = self.compile(s, b) if e < 0 else e
                s, total = e >> SHIFT, total + (e & 63) - BIAS
            n[i] += total
        out = np.empty_like(n)
        out[order] = n
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    c, total, parts, owner = counter(path), np.zeros(len(texts), np.int64), [], []
    for i, t in enumerate(texts):
        pieces = [t]
        for s in c.special:
            if s in t:
                total[i] += t.count(s)
                pieces = [q for p in pieces for q in p.split(s)]
        parts += pieces
        owner += [i] * len(pieces)
    end = b"\x00\x00\x11\x00"
    cp = np.frombuffer(b"".join(x for p in parts for x in (p.encode("utf-32-le"), end)), np.uint32)
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    at_end = cp == 0x110000
    begins = marks(symbols(cp))
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    width[at_end] = 0
    byte_at = np.cumsum(width) - width
    cuts = np.flatnonzero(begins | at_end)
    where = byte_at[cuts]
    is_word = begins[cuts]
    words, length = where[is_word], np.append(np.diff(where), 0)[is_word]
    doc = np.asarray(owner)[(np.cumsum(at_end) - at_end)[cuts[is_word]]] if len(words) else np.zeros(0, int)
    return total + np.bincount(doc, c.count(data, words, length), len(texts)).astype(np.int64)


def grouped(texts: list[str], most: int = 1 << 20):
    """Slices of texts of about ``most`` characters; one longer text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document; ``path`` is the tokenizer's .json file on every machine."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.concatenate([np.zeros(0, np.int64), *(count_texts(texts[s], path) for s in grouped(texts))])
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
