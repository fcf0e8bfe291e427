"""Links between the tokens that two tokenizers make of the same text.

Token A[i] and token B[j] are linked if their byte ranges overlap. With the incidence of tokens and bytes as sparse matrices in
compressed rows, the links are the entries of A x B-transposed, made row by row (Gustavson's product). Bytes at which
tokens of both end cut the text into groups; the incidence of tokens and groups gives, by the same product, the links inside groups.

Neither tokenizer makes a token across a blank that stands between two other characters (byte_bpe.CUT), so texts are
aligned by units between such blanks, and a worker remembers units that it has met. How many documents hold a pair of ids linked is counted in a
first pass; the most frequent pairs, a bounded number, are broadcast, and the links of all others meet their counts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import CUT, PART, Coder, Tokens, parts
from .common import kept, slices, staged
from .pieces import MODEL

#: Part of the environment, not of this repository; a JSON file of merges over bytes, and a SentencePiece model.
MERGES = "/opt/tokenizers/byte_bpe_50k.json"
#: At most so many pairs of ids are broadcast with their counts (16 bytes each).
HEAD = 1 << 20
#: A worker remembers so many units, and those of one batch.
_CACHED = 300_000
#: Products are made for so many entries at a time, counts of a task are emitted beyond so many pairs.
_CHUNK = 1 << 20


@dataclass
class Rows:
    """A sparse matrix of ones or counts in compressed rows: row i has the columns index[start[i] : start[i + 1]]."""

    start: np.ndarray
    index: np.ndarray

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Rows:
        """Row i has the next lengths[i] columns: tokens over the bytes that they cover, groups over the tokens that they hold."""
        start = np.concatenate([[0], np.cumsum(lengths)])
        return cls(start, np.arange(start[-1]))

    def transposed(self, n_columns: int) -> Rows:
        order = np.argsort(self.index, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.index, minlength=n_columns))]), row[order])

    def __matmul__(self, other: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product, some rows at a time: row, column and value of its entries, in order of row, then column.

        Row i is the sum of the rows of other that row i names; equal columns of a row are added up.
        """
        size = np.diff(other.start)
        work = np.concatenate([[0], np.cumsum(size[self.index])])[self.start]
        n, done = len(self.start) - 1, 0
        while done < n:
            upto = max(done + 1, int(np.searchsorted(work, work[done] + _CHUNK, "right")) - 1)
            named = self.index[self.start[done] : self.start[upto]]
            times = size[named]
            row = np.repeat(np.repeat(np.arange(done, upto), np.diff(self.start[done : upto + 1])), times)
            before = np.cumsum(times) - times
            column = other.index[np.arange(len(row)) + np.repeat(other.start[named] - before, times)]
            key = row << 32 | column
            if (key[1:] < key[:-1]).any():
                key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            yield key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))
            done = upto


def overlaps(bytes_a: np.ndarray, bytes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of tokens with these byte lengths, over the same bytes: A's number, B's number and shared bytes."""
    a, b = Rows.of_lengths(bytes_a), Rows.of_lengths(bytes_b)
    found = list(a @ b.transposed(len(b.index)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def groups(bytes_a: np.ndarray, bytes_b: np.ndarray) -> tuple[Rows, Rows]:
    """The groups over A's tokens and over B's tokens."""
    ends_a, ends_b = np.cumsum(bytes_a), np.cumsum(bytes_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)

    def held(ends: np.ndarray) -> Rows:
        return Rows.of_lengths(np.diff(np.searchsorted(ends, cuts, "right"), prepend=0))

    return held(ends_a), held(ends_b)


def shared_links(group_a: Rows, group_b: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All A-B pairs inside groups, some A tokens at a time. Their number is that of groups' sizes multiplied; see n_shared for the number alone."""
    return group_a.transposed(len(group_a.index)) @ group_b


@dataclass
class Pair:
    """Two tokenizers, as the workers need them."""

    a: Tokens
    model_b: bytes
    bytes_b: list[bytes]

    @classmethod
    def load(cls, merges: str = MERGES, model: str = MODEL) -> Pair:
        import sentencepiece

        with open(model, "rb") as file:
            raw = file.read()
        b = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(b.vocab_size())
        if any("▁" in b.id_to_piece(i).lstrip("▁") for i in ids):
            raise ValueError(f"{model}: a piece reaches over a blank")
        return cls(Tokens.load(merges), raw, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids])


#: What a unit or text has, in this order: tokens of A and B, groups, links, shared links (pairs inside groups).
_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


class Aligner:
    """Aligns units and texts; remembers the units that it has met, up to a number."""

    def __init__(self, pair: Pair, cached: int = _CACHED):
        import sentencepiece

        self.cached = cached
        self.coder, self.b = Coder(pair.a), sentencepiece.SentencePieceProcessor(model_proto=pair.model_b)
        self.bytes_b = pair.bytes_b
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (pair.a.tokens, pair.bytes_b))
        self.name = list(map(str, range(max(len(pair.a.tokens), len(pair.bytes_b)))))
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.same, self.numbers, self.text = np.zeros(0, bool), np.zeros((0, len(_NAMES)), np.int64), []
        # of unit u the distinct links pairs[begin[u] : begin[u + 1]], and how often it has each
        self.begin, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, units: list[str]) -> None:
        """Align new units, each with a blank before it. Those whose bytes are not the bytes of B's tokens have nothing."""
        raw = [f" {u}".encode() for u in units]
        ids_b, shown = self.b.encode(units, num_threads=1), self.bytes_b.__getitem__
        same = np.fromiter((b"".join(map(shown, ids)) == r for ids, r in zip(ids_b, raw, strict=True)), bool, len(units))
        if not same.all():
            ids_b = [ids if s else [] for ids, s in zip(ids_b, same.tolist(), strict=True)]
        ids_a, n_a = self.coder.encode([f" {u}" if s else "" for u, s in zip(units, same.tolist(), strict=True)])
        ids_a, n_b = ids_a.astype(np.int64), np.fromiter(map(len, ids_b), np.int64, len(units))
        ids_b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        # the units stand one after another, so every unit's end is an end of both and no link or group reaches over it
        bytes_a, bytes_b = self.length_a[ids_a], self.length_b[ids_b]
        end_a = np.cumsum(n_a)
        i, j, _ = overlaps(bytes_a, bytes_b)
        link_end = np.searchsorted(i, end_a)
        group_a, group_b = groups(bytes_a, bytes_b)
        group_end = np.searchsorted(group_a.start[1:], end_a, "right")
        n_shared = np.diff(np.concatenate([[0], np.cumsum(np.diff(group_a.start) * np.diff(group_b.start))])[group_end], prepend=0)
        numbers = np.stack([n_a, n_b, np.diff(group_end, prepend=0), np.diff(link_end, prepend=0), n_shared], axis=1)
        # links by unit, equal ones together
        unit, pair = np.repeat(np.arange(len(units)), numbers[:, 3]), ids_a[i] << 32 | ids_b[j]
        order = np.lexsort((pair, unit))
        unit, pair = unit[order], pair[order]
        first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])][: len(pair)])
        a, b = group_a.start.tolist(), group_b.start.tolist()
        name_a, name_b = ([self.name[t] for t in ids.tolist()] for ids in (ids_a, ids_b))
        text = [f"{name_a[p] if p + 1 == q else ','.join(name_a[p:q])}|{name_b[r] if r + 1 == t else ','.join(name_b[r:t])}" for p, q, r, t in zip(a[:-1], a[1:], b[:-1], b[1:], strict=True)]
        ends = group_end.tolist()
        self.place.update(zip(units, range(len(self.text), len(self.text) + len(units)), strict=True))
        self.text += [";".join(text[p:q]) for p, q in zip([0, *ends[:-1]], ends, strict=True)]
        self.same, self.numbers = np.concatenate([self.same, same]), np.concatenate([self.numbers, numbers])
        self.begin = np.concatenate([self.begin, len(self.pairs) + np.searchsorted(unit[first], np.arange(1, len(units) + 1))])
        self.pairs, self.times = np.concatenate([self.pairs, pair[first]]), np.concatenate([self.times, np.diff(np.append(first, len(pair)))])

    def batch(self, lists: list[list[str]]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lists of units: their groups as text, their numbers, and one after another their links (none twice) with the list that each belongs to and how
        often it is there. A list with a unit whose bytes differ has None and nothing else: B's bytes are only ever fewer, so those of the whole differ too."""
        if len(self.place) > self.cached:
            self._forget()
        some, size = [], 0
        for unit in set().union(*lists).difference(self.place):  # so many characters at a time
            some.append(unit)
            size += len(unit)
            if size > _CHUNK // 2:
                self.meet(some)
                some, size = [], 0
        if some:
            self.meet(some)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        owner, ends = np.repeat(np.arange(len(lists)), n), np.concatenate([[0], np.cumsum(n)])
        good = np.bincount(owner, ~self.same[at], len(lists)) == 0
        numbers = np.diff(np.concatenate([np.zeros((1, len(_NAMES)), np.int64), np.cumsum(self.numbers[at], axis=0)])[ends], axis=0) * good[:, None]
        cuts, texts = ends.tolist(), list(map(self.text.__getitem__, at.tolist()))
        joined = [";".join(texts[a:b]) if g else None for a, b, g in zip(cuts[:-1], cuts[1:], good.tolist(), strict=True)]
        at, owner = at[good[owner]], owner[good[owner]]
        count = self.begin[at + 1] - self.begin[at]
        take = np.arange(int(count.sum())) + np.repeat(self.begin[at] - (np.cumsum(count) - count), count)
        # a short name for each pair among those of the batch, so that list and pair are one number
        distinct, short = np.unique(self.pairs, return_inverse=True)
        key, times = _added([np.repeat(owner, count) << 32 | short[take]], [self.times[take]])
        return joined, numbers, key >> 32, distinct[key & 0xFFFFFFFF], times

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: hashes of their groups ('' without tokens), their numbers, and their links as batch() gives them."""
        if all(len(t or "") <= PART for t in texts):
            joined, *rest = self.batch([CUT.split(t) if t else [] for t in texts])
            return ["" if g is None or not t else sha256(g.encode()).hexdigest() for g, t in zip(joined, texts, strict=True)], *rest
        done = [self.texts([t]) if len(t or "") <= PART else self._long(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(d[2]) for d in done])
        return [d[0][0] for d in done], np.concatenate([d[1] for d in done]), owner, *(np.concatenate([d[k] for d in done]) for k in (3, 4))

    def _long(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A text in parts; the blank at which one begins belongs to its first unit."""
        digest, numbers, pair, times = sha256(), np.zeros((1, len(_NAMES)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, part in enumerate(parts(text)):
            joined, own, _, own_pair, own_times = self.batch([CUT.split(part[1:] if k else part)])
            if joined[0] is None:
                return [""], np.zeros((1, len(_NAMES)), np.int64), *(np.zeros(0, np.int64),) * 3
            digest.update((";" * (k > 0) + joined[0]).encode())
            numbers = numbers + own
            pair, times = _added([pair, own_pair], [times, own_times])
        return [digest.hexdigest()], numbers, np.zeros(len(pair), np.int64), pair, times


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)


def aligned(docs: DataFrame, pair: Pair, text_col: str) -> DataFrame:
    """docs without the text, but with the columns of _NAMES, groups_sha256 and the links of each row, none twice: pair (A's id << 32 | B's id) and times."""
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    own = docs.drop(text_col).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(shared, Aligner)
        for part in slices(batches, 4096, 1 << 21):
            digest, numbers, owner, pairs, times = aligner.texts(part.column(text_col).to_pylist())
            ends = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
            rest = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != text_col]
            more = [*(pa.array(numbers[:, k]) for k in range(len(_NAMES))), pa.array(digest, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(times))]
            yield pa.RecordBatch.from_arrays([*rest, *more], names=[*own.names, *_NAMES, "groups_sha256", "pairs", "times"])

    fields = [f"{c} long" for c in _NAMES] + ["groups_sha256 string", "pairs array<long>", "times array<long>"]
    return docs.mapInArrow(run, T.StructType([*own.fields, *T.StructType.fromDDL(", ".join(fields)).fields]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows (pair, n): how many rows hold a pair in their column pairs. Added up in each task before they are dealt by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy()
            keys.append(pairs)
            counts.append(np.ones(len(pairs), np.int64))
            waiting += len(pairs)
            if waiting > 4 * _CHUNK:
                key, n = _added(keys, counts)
                keys, counts, waiting = [key], [n], len(key)
                if len(key) > _CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                    keys, counts, waiting = [], [], 0
        if keys:
            key, n = _added(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_head(rows: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """rows with n_best and count_sum by the counts of the head (pairs in order, their counts, the highest count of each A id), and the links outside it."""
    shared = rows.sparkSession.sparkContext.broadcast(head)
    own = rows.drop("pairs", "times").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for part in slices(batches, 4096):
            lists = part.column("pairs")
            pairs, times = lists.flatten().to_numpy(), part.column("times").flatten().to_numpy()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = np.searchsorted(known, pairs)
            place[place == len(known)] = 0
            inside = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            count = np.where(inside, n[place], 0) if len(known) else np.zeros(len(pairs), np.int64)

            def summed(values, ends=ends):
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[ends]))

            outside = np.flatnonzero(~inside)
            rest = pa.StructArray.from_arrays([pa.array(pairs[outside]), pa.array(times[outside])], ["pair", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(outside, ends).astype(np.int32)), rest)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own.names), summed(times * (inside & (count == best[pairs >> 32]))), summed(times * count), rest], names=[*own.names, "n_best", "count_sum", "rest"])

    return rows.mapInArrow(run, T.StructType([*own.fields, *T.StructType.fromDDL("n_best long, count_sum long, rest array<struct<pair: long, times: long>>").fields]))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", merges: str = MERGES, model: str = MODEL, head: int = HEAD) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_shared (pairs inside groups), n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer on a blank and the text, B the SentencePiece model on the text, to which it adds the blank. A pair's count is the number of
    rows of docs that hold it linked; n_best counts links whose count is the highest of their A id, ties included, count_sum adds up the counts of all links. groups_sha256 is
    the hash of the ids of all groups in order ("a1,a2|b1;a3|b2,b3").
    A null or empty text, and one that B does not give back byte for byte (U+2581 in it), has no tokens: zeros and an empty groups_sha256.
    Repeated rows each count and each have a row; ids may be null; other columns are not looked at.
    """
    spark, pair = docs.sparkSession, Pair.load(merges, model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(aligned(own, pair, "text").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(rows), "pairs")
    # one number for each token of A: as many as the file has
    best = np.zeros(len(pair.a.tokens), np.int64)
    for a, n in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect():
        best[a] = n
    # the most frequent pairs, by the number of binary digits of their counts, as many digits down as fit
    digits = F.length(F.bin("n"))
    classes = {r.c: r.k for r in counts.groupBy(digits.alias("c")).agg(F.count("*").alias("k")).collect()}
    least, total = 64, 0
    while least > 1 and total + classes.get(least - 1, 0) <= head:
        least -= 1
        total += classes.get(least, 0)
    known = counts.where(digits >= least).toArrow().sort_by("pair")
    out = with_head(rows, (*(known.column(c).to_numpy() for c in ("pair", "n")), best))
    shown = ["doc_id", *_NAMES, "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return out.select(*shown)
    out = staged(out, "aligned")
    # the other pairs are each in fewer than 2 ** (least - 1) rows, so no key of this join is hot
    others = out.select("row", F.inline("rest")).join(counts.where(digits < least).hint("merge"), "pair")
    highest = F.broadcast(spark.createDataFrame(enumerate(best.tolist()), "a long, highest long"))
    late = others.join(highest, F.shiftright("pair", 32) == F.col("a")).groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("late_best"), F.sum(F.col("times") * F.col("n")).alias("late_sum"))
    added = {"n_best": "late_best", "count_sum": "late_sum"}
    return out.join(late.hint("merge"), "row", "left").select(*((F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else c for c in shown))
