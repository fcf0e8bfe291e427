"""Byte-level BPE encoding and decoding with an existing table of ranks.

A text is split by a pattern; each match is encoded by itself. A first tier looks up whole matches in a minimal
perfect hash of the vocabulary, many at a time: one that is a token is done. The others go to the second tier, where their
bytes are a linked list and the pairs of neighbours wait in a heap by rank, then place, until no pair is a token.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, slices

#: Part of the environment, not of this repository; any file of ranks with all 256 bytes will do.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that goes with these ranks (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Matches of up to so many characters that are no token are remembered by a worker, and of these twice so many at most and those of one batch.
_SHORT, _CACHED = 64, 200_000
#: Texts go through the pattern in parts of about so many characters.
PART = 1 << 20
#: A blank between two other characters: every match that begins there begins there whatever comes before.
CUT = re.compile(r"(?<=\S) (?=\S)")
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that can be encoded one by one: each but the first begins with a blank at a CUT."""
    at = 0
    while len(text) - at > size and (found := CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def load_ranks(path: str) -> list[bytes]:
    """The tokens by rank, of a file with a line of base64 and rank for each, or of a JSON file whose merges are in the order of ids."""
    with open(path, "rb") as file:
        if path.endswith(".json"):
            model = json.load(file)["model"]
            # the alphabet of these files: printable bytes are their own characters, the others follow from U+0100 on
            plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            other = [b for b in range(256) if b not in set(plain)]
            byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            if [model["vocab"][a + b] for a, b in merges] != list(range(256, 256 + len(merges))):
                raise ValueError(f"{path}: merges are not in the order of ids")
            known = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
        else:
            known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    tokens = sorted(known, key=known.get)
    if [known[t] for t in tokens] != list(range(len(tokens))) or len({t for t in tokens if len(t) == 1}) < 256:
        raise ValueError(f"{path}: ranks must count from 0 and hold all 256 bytes")
    return tokens


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x stirs all bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """Words of some bytes as columns of eight bytes, and their 64-bit hashes."""

    def __init__(self, words: list[bytes], width: int, seed: int):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.columns = np.array(words, f"S{8 * width}").view("<u8").reshape(len(words), width) if words else np.zeros((0, width), np.uint64)
        self.hash = _mixed(self.length.astype(np.uint64) + np.uint64(seed))
        for c in range(width):  # columns beyond the word leave its hash alone, so that it does not depend on width
            self.hash = np.where(self.length > 8 * c, _mixed(self.hash ^ self.columns[:, c]), self.hash)


@dataclass
class PerfectHash:
    """n words in n slots. A word's bucket names the displacement that takes it to its slot, or, below zero, the slot itself."""

    seed: int
    shift: np.ndarray
    length: np.ndarray
    columns: np.ndarray
    number: np.ndarray  # which word stands in a slot

    #: Mean words a bucket.
    LOAD = 3

    @staticmethod
    def _slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (_mixed(h + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, words: list[bytes]) -> PerfectHash:
        n, width = len(words), -(-max(map(len, words)) // 8)
        seed, own = 0, _Words(words, width, 0)
        while len(np.unique(own.hash)) < n:
            seed, own = seed + 1, _Words(words, width, seed + 1)
        n_buckets = n // cls.LOAD + 1
        bucket = (own.hash >> np.uint64(32)).astype(np.int64) % n_buckets
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=n_buckets)
        begin = np.cumsum(size) - size
        shift, number, used = np.zeros(n_buckets, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
        for b in np.argsort(-size, kind="stable")[: np.count_nonzero(size > 1)].tolist():
            members = order[begin[b] : begin[b] + size[b]]
            h, tried = own.hash[members], 0
            while True:  # the first displacement that takes all of the bucket to free slots of their own
                step = np.arange(tried, tried + 128)
                slot = np.sort(cls._slots(h[None, :], step[:, None], n), axis=1)
                fits = ~used[slot].any(axis=1) & (slot[:, 1:] != slot[:, :-1]).all(axis=1)
                if fits.any():
                    break
                tried += 128
            shift[b] = tried + int(fits.argmax())
            slot = cls._slots(h, np.full(len(h), shift[b]), n)
            used[slot], number[slot] = True, members
        lone = np.flatnonzero(size == 1)
        free = np.flatnonzero(~used)
        shift[lone], number[free] = -1 - free, order[begin[lone]]
        return cls(seed, shift, own.length[number], own.columns[number], number)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words, -1 for others."""
        n, out = len(self.number), np.full(len(words), -1, np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width_of = np.minimum(-(-lengths // 8), self.columns.shape[1] + 1)
        for width in np.unique(width_of).tolist():
            if width in (0, self.columns.shape[1] + 1):
                continue
            at = np.flatnonzero(width_of == width)
            some = _Words([words[i] for i in at.tolist()], width, self.seed)
            shift = self.shift[(some.hash >> np.uint64(32)).astype(np.int64) % len(self.shift)]
            slot = np.where(shift < 0, -1 - shift, self._slots(some.hash, np.maximum(shift, 0), n))
            same = (self.length[slot] == some.length) & (self.columns[slot, :width] == some.columns).all(axis=1)
            out[at[same]] = self.number[slot[same]]
        return out


class Merges:
    """The second tier: merges, each time, the pair of neighbours of least rank, the first of them in a tie."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)])
        #: Of two tokens, left << 32 | right, whose bytes together are a token: that token.
        self.pairs = {rank[t[:k]] << 32 | rank[t[k:]]: i for t, i in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        self.first = np.array([[self.pairs.get(a << 32 | b, -1) for b in self.byte.tolist()] for a in self.byte.tolist()]).ravel()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Of each word the ids, as 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        pair = np.append(self.first[raw[:-1] << 8 | raw[1:]], -1) if len(raw) else raw
        pair[ends - 1] = -1
        place = np.arange(len(raw)) - np.repeat(ends - size, size)
        waiting = np.flatnonzero(pair >= 0)
        keys, cuts = (pair[waiting] << 32 | place[waiting]).tolist(), np.searchsorted(waiting, ends).tolist()
        pair, byte = pair.tolist(), self.byte[raw].tolist()
        out, at, done = [], 0, 0
        for end, cut in zip(ends.tolist(), cuts, strict=True):
            out.append(self._one(byte[at:end], pair[at:end], keys[done:cut]))
            at, done = end, cut
        return out

    def _one(self, token: list[int], pair: list[int], heap: list[int]) -> bytes:
        """token: the bytes' tokens; pair: what each makes with the next one, or -1; heap: pair << 32 | place of those that make one."""
        n, get = len(token), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, new = top & 0xFFFFFFFF, top >> 32
            if pair[i] != new:
                continue  # one of the two has grown since
            gone = after[i]
            follows = after[i] = after[gone]
            token[i], token[gone], pair[gone] = new, -1, -1
            if follows < n:
                before[follows] = i
                pair[i] = more = get(new << 32 | token[follows], -1)
                if more >= 0:
                    heappush(heap, more << 32 | i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = more = get(token[left] << 32 | new, -1)
                if more >= 0:
                    heappush(heap, more << 32 | left)
        return array("i", [t for t in token if t >= 0]).tobytes()


def spelt_out(pattern: str) -> tuple[str, str]:
    """The pattern with its letters, numbers and white space as ranges of characters, taken from the tables of the tiktoken library: first without
    those beyond U+FFFF, for texts that have none, then with them.

    Libraries differ in their edition of these tables, and plain ranges need none.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}

    def ranges(kind: str, end: int) -> str:
        chars = bytes(tiktoken.Encoding("characters", pat_str=f"{kind}+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        at = np.array([c for c in map(ord, chars) if c < end])
        cuts = np.flatnonzero(np.diff(at) > 1)
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(at[np.r_[0, cuts + 1]].tolist(), at[np.r_[cuts, len(at) - 1]].tolist(), strict=True))

    out = []
    for end in (0x10000, 0x110000):
        now = pattern
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            # inside a class the ranges alone, elsewhere a class of them
            now = re.sub(rf"(\[[^\]]*)?{re.escape(kind)}", lambda m, r=ranges(kind, end): f"{m[1]}{r}" if m[1] else f"[{r}]", now)
            if kind == r"\s":
                now = now.replace(r"\S", f"[^{ranges(kind, end)}]")
        out.append(now)
    return tuple(out)


@dataclass
class Tokens:
    """What the workers need: tokens by rank, the hash of them, and the patterns."""

    tokens: list[bytes]
    hash: PerfectHash
    narrow: str
    wide: str

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> Tokens:
        tokens = load_ranks(path)
        return cls(tokens, PerfectHash.build(tokens), *spelt_out(pattern))


class Coder:
    """Encodes and decodes; remembers words that are no token, up to a number."""

    def __init__(self, tokens: Tokens, cached: int = _CACHED):
        self.tokens, self.hash, self.cached = tokens.tokens, tokens.hash, cached
        self.merges = Merges(tokens.tokens)
        self.narrow, self.wide = re.compile(tokens.narrow).findall, re.compile(tokens.wide).findall
        self.met: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return (self.wide if _BEYOND(text) else self.narrow)(text)

    def second_tier(self, words: list[str], raw: list[bytes]) -> list[bytes]:
        """Ids of words that are no token; those met before come from memory, the oldest half of which is forgotten when it is full."""
        met, before = self.met, self.before
        found = [met.get(w) for w in words]
        missed = [i for i, ids in enumerate(found) if ids is None]
        fresh = [i for i in missed if words[i] not in before]
        fresh_ids = dict(zip(fresh, self.merges.ids([raw[i] for i in fresh]), strict=True))
        for i in missed:
            ids = found[i] = fresh_ids[i] if i in fresh_ids else before[words[i]]
            if len(words[i]) <= _SHORT:
                met[words[i]] = ids
        if len(met) > self.cached:
            self.before, self.met = met, {}
        return found

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words in some order; where in them each word begins, and how many it has."""
        raw = [w.encode() for w in words]
        begin, count = np.arange(len(words)), np.ones(len(words), np.int64)
        whole = self.hash.find(raw)
        rest = np.flatnonzero(whole < 0)
        found = self.second_tier([words[i] for i in rest.tolist()], [raw[i] for i in rest.tolist()])
        times = np.fromiter(map(len, found), np.int64, len(rest)) // 4
        count[rest], begin[rest] = times, len(words) + np.cumsum(times) - times
        return np.concatenate([whole, np.frombuffer(b"".join(found), np.int32)]), begin, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        if any(len(t) > PART for t in texts):
            each = [[self._encode([p]) for p in parts(t)] for t in texts]
            return np.concatenate([np.zeros(0, np.int32), *(p[0] for e in each for p in e)]), np.array([sum(len(p[0]) for p in e) for e in each], np.int64)
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.words(t) for t in texts]
        place = {w: i for i, w in enumerate(set().union(*lists))}
        flat, begin, count = self.cut(list(place))
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        times = count[at]
        total = np.concatenate([[0], np.cumsum(times)])
        out = flat[np.arange(total[-1]) + np.repeat(begin[at] - total[:-1], times)]
        return out, np.diff(total[np.concatenate([[0], np.cumsum(n)])])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def shared_tokens(docs: DataFrame, ranks: str) -> Broadcast:
    """The vocabulary, whose size the file fixes, on every executor."""
    return docs.sparkSession.sparkContext.broadcast(Tokens.load(ranks))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks: str = RANKS, packed_col: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """docs with a column of token ids (array of int); columns of the names given are replaced, others, whatever their names, are carried along.

    A null text has null ids, an empty text has none. There are no special tokens: their strings are text like any other. Ids
    depend on the text alone, so repeated rows have equal ids. packed_col adds the ids as unsigned 32-bit
    integers, least byte first, in one binary; decoded_col adds the bytes that the ids stand for. Memory grows with some megabytes of text at a time, and
    with the longest run of characters without a blank.
    """
    shared = shared_tokens(docs, ranks)
    more = [c for c in (packed_col, decoded_col) if c]
    own = docs.drop(ids_col, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(shared, Coder)
        for part in slices(batches, 4096):
            texts = part.column(text_col)
            null = texts.is_null()
            flat, counts = coder.encode([t or "" for t in texts.to_pylist()])
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=null)]
            pieces = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            missing = null.to_numpy(zero_copy_only=False)
            if packed_col:
                low = flat.astype("<u4").tobytes()
                columns.append(pa.array([low[4 * a : 4 * b] for a, b in pieces], pa.binary(), mask=missing))
            if decoded_col:
                columns.append(pa.array([coder.decode(flat[a:b].tolist()) for a, b in pieces], pa.binary(), mask=missing))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, ids_col, *more])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *(T.StructField(c, T.BinaryType()) for c in more)]))


def decode(rows: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """rows with a column of the bytes of token ids; null ids: null, no ids: no bytes. A null or an id outside the vocabulary is an error.

    What was encoded comes back byte for byte; ids from elsewhere may give bytes that are no UTF-8.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(ranks))
    own = rows.drop(decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value

        def one(ids: list[int]) -> bytes:
            if any(i is None or not 0 <= i < len(tokens) for i in ids):
                raise ValueError("an id is outside the vocabulary")
            return b"".join(map(tokens.__getitem__, ids))

        for part in slices(batches):
            raw = [None if i is None else one(i) for i in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, decoded_col])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(decoded_col, T.BinaryType())]))
