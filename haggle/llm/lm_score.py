"""Log probability of texts under a subword model that sums over all segmentations.

A text is a sequence of sentences of words, and an end. A word is spelt piece by piece over an existing vocabulary: a first
piece (they begin with the marker), then after every piece the word stops or another piece follows. The
probability of a word is the sum over all ways to spell it, found by a forward recursion in log space over the lattice of
its pieces. The vocabulary's own scores are the prior of the pieces' probabilities; these are then fitted to
the distinct words of the training documents by expectation maximisation. Two longer edges lie over the pieces. A word
of the training documents has an edge from its begin to its end, which carries its discounted frequency; what the
discounts leave is the weight of spelling. A sentence of LEAST words or more that a training document holds has an edge over all its words, in the same
way. So a passage that the corpus repeats scores high. The tokens alone say where sentences end, so the score does not depend on layout, and
the probabilities of all sequences of tokens sum to one at most. There is one model: equal texts score equal, training documents or not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, unstage
from .lattice import LONG, MARK, Lattice, Vocabulary, in_batches, parts_of
from .pieces import MODEL

#: Rounds of fitting, and the number of counts that the prior weighs.
ROUNDS, PRIOR = 2, 2000.0
#: The most frequent words and sentences, at most so many, have their scores sent to every worker; others are joined.
HEAD = 200_000
#: Words of more bytes are never among these and are joined by a hash; for fitting, longer ones are cut.
SHORT, FITTED = 64, 1024
#: Words in a sentence that has an edge.
LEAST = 3
_FLUSH, _FLUSH_BYTES = 200_000, 1 << 25
#: Words up to one that ends with a sign, or up to the end.
_SENTENCE = re.compile(rb"\S.*?[.!?](?=\s|\Z)|\S.*", re.DOTALL)
FIRST, NEXT, LAST = 0, 1, 2
LN10 = float(np.log(10))


@dataclass
class SpellingModel:
    """Natural logs by piece (the last place: an unknown character): first, next, stop and go on after it."""

    vocabulary: Vocabulary
    first: np.ndarray
    next: np.ndarray
    stop: np.ndarray
    go: np.ndarray

    @classmethod
    def of(cls, vocabulary: Vocabulary, counts: np.ndarray | None = None) -> SpellingModel:
        """counts (3, pieces + 1): expected numbers of first pieces, next pieces and last pieces of words."""
        n = len(vocabulary.scores)
        marked = np.array([s.startswith(b" ") for s in vocabulary.surface] + [False])
        usable = np.isin(np.arange(n), vocabulary.trie.value)
        prior = np.append(np.where(usable, np.exp(vocabulary.scores), 0.0), np.exp(vocabulary.scores[usable]).sum() * 1e-4)
        counts = np.zeros((3, n + 1)) if counts is None else counts

        def share(c, p):
            p = c + PRIOR * p / p.sum()
            with np.errstate(divide="ignore"):
                return np.log(p / p.sum())

        stop = (counts[LAST] + 1) / (counts[FIRST] + counts[NEXT] + 2)
        return cls(vocabulary, share(counts[FIRST], prior * marked), share(counts[NEXT], prior), np.log(stop), np.log1p(-stop))

    def weights(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The log weight of each edge, its piece with unknown last, and which edges are first and last of their word."""
        piece = np.where(lattice.piece < 0, len(self.first) - 1, lattice.piece)
        first = lattice.src == lattice.begin[lattice.word]
        last = lattice.tgt == lattice.end[lattice.word]
        weight = np.where(first, self.first[piece], self.next[piece]) + np.where(last, self.stop[piece], self.go[piece])
        weight -= np.where(lattice.piece < 0, (lattice.tgt - lattice.src) * np.log(256.0), 0.0)
        return weight, piece, first, last

    def _long(self, word: bytes) -> float:
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = 0.0
        for a, lattice in parts_of(self.vocabulary, word):
            # of the part's lattice only its first and last place may be those of the word
            here = Lattice(lattice.buffer, lattice.begin if not a else lattice.begin - 1, lattice.end if a + lattice.end[0] == len(word) else lattice.end + 1, lattice.src, lattice.tgt, lattice.piece, lattice.word, lattice.n_nodes)
            weight = self.weights(here)[0]
            lattice.forward(weight, alpha[a : a + lattice.n_nodes])
        return float(alpha[-1])

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word, given that the text goes on."""
        out, mark = np.zeros(len(words)), MARK.encode()
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))).difference(short):
            out[i] = self._long(mark + words[i])
        for places, part in in_batches([words[i] for i in short]):
            places = np.array(short)[places]
            lattice = Lattice.over(self.vocabulary.trie, [mark + w for w in part])
            out[places] = lattice.forward(self.weights(lattice)[0])[lattice.end]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected counts (3, pieces + 1) over words that occur so many times."""
        n, mark = len(self.first), MARK.encode()
        out = np.zeros((3, n))
        for places, part in in_batches(words):
            lattice = Lattice.over(self.vocabulary.trie, [mark + w for w in part])
            weight, piece, first, last = self.weights(lattice)
            share = lattice.posterior(weight)[0] * times[places][lattice.word]
            out[FIRST] += np.bincount(piece[first], share[first], n)
            out[NEXT] += np.bincount(piece[~first], share[~first], n)
            out[LAST] += np.bincount(piece[last], share[last], n)
        return out


def trains() -> F.Column:
    """Rows that the model learns from: crc32 of the id as text leaves no 1 by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence of a text, A-Z lower-cased; together they are the words of the text."""
    return [words for part in _SENTENCE.findall(text.lower()) if (words := part.split())]


def has_edge(words: list[bytes]) -> bool:
    """Whether a sentence may have an edge: one that the end of the text cuts off has none, as where it ends is not its own."""
    return len(words) >= LEAST and words[-1].endswith((b".", b"!", b"?"))


def sentence_key(words: list[bytes]) -> bytes:
    """No word begins with a blank, so keys of sentences, long words and documents are apart from words."""
    return b" s" + xxhash.xxh3_128_digest(b" ".join(words))


def word_key(word: bytes) -> bytes:
    return word if len(word) <= SHORT else b" w" + xxhash.xxh3_128_digest(word)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c, n) summed over a stretch of a partition: a word or the key of a sentence, how often in training rows, and in all."""
    words, sents = (Counter(), Counter()), (Counter(), Counter())
    size = 0

    def flush(counts):
        for learns, c in enumerate(counts):
            if c:
                n = pa.array(c.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), n if learns else pa.array(np.zeros(len(c), np.int64)), n], names=["key", "c", "n"])
            c.clear()

    for batch in batches:
        for body, learns in zip(batch.column("body"), batch.column("trains").to_pylist(), strict=True):
            text = body.as_py().lower()
            size += len(text)
            words[learns].update(text.split())
            sents[learns].update(sentence_key(s) for s in sentences(text) if has_edge(s))
            if size > _FLUSH_BYTES or len(words[0]) + len(words[1]) > _FLUSH:
                yield from flush(words)
                size = 0
            if len(sents[0]) + len(sents[1]) > _FLUSH:
                yield from flush(sents)
    yield from flush(words)
    yield from flush(sents)


def fit(types: DataFrame, model: str = MODEL, rounds: int = ROUNDS) -> SpellingModel:
    """The spelling model of types (key binary: a word, c long: how often in training rows)."""
    vocabulary = Vocabulary.load(model)
    spelling = SpellingModel.of(vocabulary)
    n = len(spelling.first)
    for _ in range(rounds):
        shared = types.sparkSession.sparkContext.broadcast(spelling)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, n))
            for batch in batches:
                words = [w[a : a + FITTED] for w in batch.column("key").to_pylist() for a in range(0, len(w), FITTED)]
                total += shared.value.expected(words, np.ones(len(words)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "x"])

        sums = types.where("c > 0").select("key").mapInArrow(expect, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(3 * n)
        for r in sums:
            counts[r["at"]] = r["x"]
        spelling = SpellingModel.of(vocabulary, counts.reshape(3, n))
    return spelling


def lm_score(docs: DataFrame, text_col: str = "text", model: str = MODEL, head: int = HEAD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty; an empty text is its end alone. Tokens are words between blanks, A-Z lower-cased,
    then one end. base_score: the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))); score: log10 of the
    text's probability under the model. Rows are scored one by one, repeated ids included; a
    row without an id counts as a training row. With no training row at all, the prior alone scores. Other columns
    are not looked at. Memory grows with the length of single texts only.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), trains().alias("trains"), body.alias("body"))
    counted = rows.select("body", "trains").mapInArrow(_counts, "key binary, c long, n long")
    is_word = F.substring("key", 1, 1) != F.lit(b" ")
    types = staged(counted.groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).withColumn("is_word", is_word), "words")
    ends = rows.where("trains").count()
    seen = types.agg(
        *(F.coalesce(F.sum(F.when(F.col("is_word") == w, F.col("c"))), F.lit(0)).alias(f"n_{w}") for w in (True, False)),
        *(F.count(F.when((F.col("is_word") == w) & F.expr(x), 1)).alias(f"{k}_{w}") for w in (True, False) for k, x in (("v", "c > 0"), ("once", "c = 1"), ("twice", "c = 2"))),
    ).first()
    seen_words, seen_sentences, v = seen.n_True, seen.n_False, seen.v_True

    def discount(once: int, twice: int) -> float:
        """Of absolute discounting, strictly between 0 and 1."""
        return (once + 1) / (once + 2 * twice + 2)

    off, off_s = discount(seen.once_True, seen.twice_True), discount(seen.once_False, seen.twice_False)
    left = (off * v + 1) / (seen_words + 1)
    log_left = np.log10((off_s * seen.v_False + 1) / (seen_sentences + 1))
    total, distinct = seen_words + ends, v + (ends > 0)
    floor = np.log10(total + 0.5 * (distinct + 1))
    spelling = spark.sparkContext.broadcast(fit(types.where("is_word"), model))
    log_end, log_on = np.log10((ends + 0.5) / (total + 1)), np.log10((seen_words + 0.5) / (total + 1))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, keys = batch.column("c").to_numpy(), batch.column("key").to_pylist()
            at = np.flatnonzero(batch.column("is_word").to_numpy(zero_copy_only=False))
            words = [keys[i] for i in at]
            base, score = np.full(len(c), np.nan), np.full(len(c), np.nan)
            with np.errstate(divide="ignore"):
                seen_whole = np.log(np.maximum(c[at] - off, 0) / (seen_words + 1))
            score[at] = np.logaddexp(seen_whole, spelling.value.log_probs(words) + np.log(left)) / LN10 + log_on
            base[at] = np.log10(c[at] + 0.5) - floor
            for i, w in zip(at, words, strict=True):
                if len(w) > SHORT:
                    keys[i] = word_key(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("c"), batch.column("n"), pa.array(base, from_pandas=True), pa.array(score, from_pandas=True)], names=["key", "c", "n", "base", "score"])

    # a sentence that occurs once needs no join: the one document that holds it knows whether it is a training document
    scored = staged(types.where("is_word or n > 1").mapInArrow(spell, "key binary, c long, n long, base double, score double"), "words")
    unstage(types)
    # whole classes of frequency, most frequent first, as long as they are no more than head; a key is SHORT bytes at most
    rank = F.floor(8 * F.log2(F.col("n") + 1))
    classes = sorted(scored.where("n > 1").groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).collect(), reverse=True)
    sizes = np.cumsum([r.n for r in classes])
    whole = [r["rank"] for r, size in zip(classes, sizes, strict=True) if size <= head]
    top = scored.where((F.col("n") > 1) & (rank >= whole[-1])).collect() if whole else []
    # the last row is for what is not frequent
    shared = spark.sparkContext.broadcast(
        ({bytes(r.key): i for i, r in enumerate(top)}, np.array([(r.c > 0, r.base or 0.0, r.score or 0.0) for r in top] + [(0, 0, 0)], np.float64), np.array([r.c for r in top] + [0], np.int64))
    )
    end = np.array([ends > 0, np.log10(ends + 0.5) - floor, log_end])
    kinds = {"row_id": pa.int64(), "sentence": pa.int32(), "doc_id": pa.int64(), "held_out": pa.bool_(), "key": pa.binary(), "times": pa.int64(), "repeats": pa.int64(), "least": pa.int64(), "known": pa.float64(), "base": pa.float64(), "score": pa.float64()}

    def edge(repeats: np.ndarray) -> np.ndarray:
        """log10 of the weight of the edge of a sentence that training documents hold so often."""
        with np.errstate(divide="ignore"):
            return log_on + np.log10(np.maximum(repeats - off_s, 0) / (seen_sentences + 1))

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(columns["row_id"])
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if (x := columns.get(c)) is None else x if isinstance(x, pa.Array) else pa.array(x, t) for c, t in kinds.items()], names=list(kinds))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (sentence -1) with the sums over what is frequent, one for each sentence that is not
        settled, with the score of its frequent words, and one for each rare word in it."""
        place, values, counts = shared.value
        for batch in slices(batches):
            row_id, held = batch.column("row_id").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False)
            texts = [sentences(t) for t in batch.column("body").to_pylist()]
            doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            parts = [s for t in texts for s in t]
            size = np.array([len(s) for s in parts], np.int64)
            begin = np.cumsum(size) - size
            n_tokens = np.bincount(doc, size, len(texts)).astype(np.int64) + 1
            words = [w for s in parts for w in s]
            found = np.fromiter((place.get(w if len(w) <= SHORT else word_key(w), -1) for w in words), np.int64, len(words))
            sums = np.add.reduceat(values[found], begin, axis=0) if len(parts) else np.zeros((0, 3))
            sums[:, 2] += log_left
            rare = np.flatnonzero(found < 0)
            of = np.searchsorted(begin, rare, "right") - 1
            keys = [sentence_key(s) if has_edge(s) else None for s in parts]
            at = np.array([-1 if k is None else place.get(k, -1) for k in keys], np.int64)
            repeats = counts[at]
            told = (at >= 0) | np.array([k is None for k in keys], bool)  # nothing is to be learnt of the sentence itself
            settled = told & (np.bincount(of, minlength=len(parts)) == 0)
            score = np.where(settled & (repeats > 0), np.logaddexp(sums[:, 2] * LN10, edge(repeats) * LN10) / LN10, sums[:, 2])
            docs_sums = np.tile(end, (len(texts), 1))
            for j, x in enumerate((sums[:, 0], sums[:, 1], np.where(settled, score, 0.0))):
                docs_sums[:, j] += np.bincount(doc, x, len(texts))
            nothing = [b" %d" % i for i in row_id.tolist()]  # these keys match nothing and spread over all partitions
            yield rows_of(row_id=row_id, sentence=np.full(len(texts), -1), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), key=nothing, times=n_tokens, known=docs_sums[:, 0], base=docs_sums[:, 1], score=docs_sums[:, 2])
            open_ = np.flatnonzero(~settled)
            yield rows_of(
                row_id=row_id[doc[open_]], sentence=number[open_], key=[nothing[doc[i]] if told[i] else keys[i] for i in open_.tolist()],
                repeats=pa.array(repeats[open_], pa.int64(), mask=~told[open_]), least=1 - held[doc[open_]].astype(np.int64), score=score[open_],
            )
            yield rows_of(row_id=row_id[doc[of]], sentence=number[of], key=[word_key(words[i]) for i in rare.tolist()], times=np.ones(len(rare), np.int64))

    found = rows.select("row_id", "doc_id", (~F.col("trains")).alias("held_out"), "body").mapInArrow(look_up, "row_id long, sentence int, doc_id long, held_out boolean, key binary, times long, repeats long, least long, known double, base double, score double")
    rare = scored.select("key", F.col("c").alias("its_c"), F.col("base").alias("its_base"), F.col("score").alias("its_score")).hint("merge")
    joined = found.join(rare, "key", "left").repartition("row_id")
    whole_doc, rare_word = F.col("sentence") == -1, F.col("times").isNotNull() & (F.col("sentence") >= 0)
    by_sentence = joined.groupBy("row_id", "sentence").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max(F.when(whole_doc, F.col("times"))).alias("n_tokens"),
        F.sum(F.when(rare_word, F.col("times") * (F.col("its_c") > 0).cast("double")).otherwise(F.col("known"))).alias("known"),
        F.sum(F.when(rare_word, F.col("times") * F.col("its_base")).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(rare_word, F.col("times") * F.col("its_score")).otherwise(F.col("score"))).alias("words"),
        F.max(F.when(~rare_word & ~whole_doc, F.coalesce(F.col("repeats"), F.col("its_c"), F.col("least")))).alias("repeats"),
    )
    over = log_on + F.log10((F.col("repeats") - off_s) / (seen_sentences + 1))
    both = F.greatest("words", over) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(F.col("words") - over)))
    by_sentence = by_sentence.withColumn("score", F.when(F.col("repeats") > 0, both).otherwise(F.col("words")))
    return (
        by_sentence.groupBy("row_id")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("known", "base", "score")))
        .select("doc_id", "held_out", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    )
