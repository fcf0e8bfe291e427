"""SentencePiece encoding and decoding with an existing vocabulary.

Encoding finds the unigram segmentation of the highest total log score (Viterbi over a double-array trie).
A blank becomes the marker U+2581 and a text starts with one. A character outside the vocabulary becomes the pieces of its
UTF-8 bytes. As no piece reaches over the beginning of a word, the best cut of a text is that of its
words one after another, so each worker looks up words that it has met and searches only for new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, slices
from .lattice import LONG, MARK, Lattice, Vocabulary, best_of_long, in_batches

#: Part of the environment, not of this repository; any SentencePiece model file with byte pieces will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of up to so many bytes are remembered by a worker, and of these so many at most (a little more until it starts anew).
_SHORT, _CACHED = 64, 100_000


class Encoder:
    """Encodes texts; remembers the words it has met, up to a number."""

    def __init__(self, vocabulary: Vocabulary, cached: int = _CACHED):
        self.vocabulary, self.cached = vocabulary, cached
        units = (f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if vocabulary.splits_lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if vocabulary.splits_words else ".+"
        self.units = re.compile(units, re.DOTALL).findall
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begin = self.count = np.zeros(0, np.int64)

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of the words in some order; where in them each word begins, and how many it has."""
        v, done = self.vocabulary, 0
        begin, count, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))).difference(short):
            found = [p for piece, a, b in best_of_long(v, words[i]) for p in ([piece] if piece >= 0 else v.byte_ids[np.frombuffer(words[i][a:b], np.uint8)].tolist())]
            begin[i], count[i], done = done, len(found), done + len(found)
            ids.append(np.array(found, np.int32))
        for places, part in in_batches([words[i] for i in short]):
            places = np.array(short)[places]
            lattice = Lattice.over(v.trie, part)
            weight = np.where(lattice.piece < 0, v.unknown_score, v.scores[lattice.piece])
            edges, _ = lattice.best(weight)
            piece, word = lattice.piece[edges], lattice.word[edges]
            src = lattice.src[edges] - word
            times = np.where(piece < 0, lattice.tgt[edges] - lattice.src[edges], 1)
            whole = np.repeat(piece, times)
            step = np.arange(len(whole)) - np.repeat(np.cumsum(times) - times, times)
            lone = whole < 0
            whole[lone] = v.byte_ids[lattice.buffer[(np.repeat(src, times) + step)[lone]]]
            counts = np.bincount(np.repeat(word, times), minlength=len(part))
            count[places] = counts
            begin[places] = done + np.cumsum(counts) - counts
            done += len(whole)
            ids.append(whole)
        return np.concatenate(ids), begin, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the texts one after another, and how many each has."""
        units = [self.units(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.place) > self.cached:
            self._forget()
        fresh = sorted(set().union(*units).difference(self.place), key=len)
        known, flat, begin, count = len(self.place), self.flat, self.begin, self.count
        if fresh:
            ids, start, n = self.cut([u.encode() for u in fresh])
            begin, count, flat = np.concatenate([begin, len(flat) + start]), np.concatenate([count, n]), np.concatenate([flat, ids])
        now = dict(zip(fresh, range(known, known + len(fresh)), strict=True))
        per_text = np.fromiter(map(len, units), np.int64, len(units))
        old = self.place.get
        at = np.fromiter((now[u] if (k := old(u)) is None else k for u in chain.from_iterable(units)), np.int64, int(per_text.sum()))
        begin_at, times = begin[at], count[at]
        total = np.concatenate([[0], np.cumsum(times)])
        out = flat[np.arange(total[-1]) + np.repeat(begin_at - total[:-1], times)]
        # short words stay: they come first in fresh, and so do their ids if no long one is among them
        few = sum(len(u) <= _SHORT for u in fresh)
        if few == len(fresh):
            self.place.update(now)
            self.begin, self.count, self.flat = begin, count, flat
        elif few:
            ids, start, n = self.cut([u.encode() for u in fresh[:few]])
            self.place.update(zip(fresh[:few], range(known, known + few), strict=True))
            self.begin, self.count, self.flat = np.concatenate([self.begin, len(self.flat) + start]), np.concatenate([self.count, n]), np.concatenate([self.flat, ids])
        ends = total[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(ends)


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of piece ids; the blank that the text was given at its start goes. Wrong UTF-8 shows as U+FFFD."""
    raw = b"".join(map(vocabulary.surface.__getitem__, ids))
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def _shared(docs: DataFrame, model: str) -> Broadcast:
    """The vocabulary, whose size the model file fixes, on every executor."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, decoded_col: str | None = None) -> DataFrame:
    """docs with a column of piece ids (array of int); a column of that name is replaced.

    A null text has null ids, an empty text has none. Ids depend on the text alone. Memory grows with
    some megabytes of text at a time, and slowly with the longest run of characters without a blank or newline. With decoded_col, what decode()
    makes of the ids comes along in the same pass.
    """
    shared = _shared(docs, model)
    own = docs.drop(ids_col, *([decoded_col] if decoded_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(shared, Encoder)
        for part in slices(batches):
            texts = part.column(text_col)
            flat, counts = encoder.encode([t or "" for t in texts.to_pylist()])
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns, names = [*part.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=texts.is_null())], [*part.schema.names, ids_col]
            if decoded_col:
                back = [decode_ids(encoder.vocabulary, flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns.append(pa.array(back, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False)))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *more]))


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with a column of the text of piece ids (null ids: null). It is what was encoded, but for U+2581 in
    the text, which comes back as a blank."""
    shared = _shared(rows, model)
    own = rows.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for part in slices(batches):
            texts = [None if i is None else decode_ids(vocabulary, i) for i in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(text_col, T.StringType())]))
