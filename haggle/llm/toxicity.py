"""Toxicity of texts by a small bidirectional gated recurrent network with attention pooling.

A word's input is the sum of its own vector and those of its first characters, beside the mean of the vectors of its character trigrams. A network of gated
recurrent units reads a window of words in both directions, attention pools its states, and a logistic
unit scores the window. A text is scored over all overlapping windows; its score is that of the worst window.
Everything is trained here, in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

#: Windows overlap by 40 words, so every passage of up to 41 words lies whole in one.
WINDOW, STRIDE = 64, 24
WORD_DIM, CHAR_DIM, HIDDEN = 6, 10, 8
CHAR_BUCKETS = 8192
#: Bytes of the beginnings of a word that have a vector beside its own.
BEGINNINGS = (4, 6)
#: Labelled rows that the network is trained on at most; a larger set is sampled evenly by a hash of the id. Their texts have
#: TRAINING_CHARS characters at most, so that the sample is bounded in bytes too; longer ones teach nothing.
TRAINING_ROWS, TRAINING_CHARS = 2000, 200_000
#: Windows in a step of training.
BATCH = 64
#: Words of up to so many bytes are remembered by a worker, and of these so many at most (a little more until it starts anew).
_SHORT, _CACHED = 64, 100_000
_STRIP = b".,;:!?\"'()[]{}<>*#%&$|-_=+/\\~^`@"


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of words, one word after another, and how many each has.

    A word is marked at its begin and twice at its end, so that each has one trigram or more.
    """
    raw = np.frombuffer(b"".join([b"^%b$$" % w for w in words]), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 3
    code = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16) * np.uint32(2654435761) >> np.uint32(8) if len(raw) else raw
    inside = np.ones(len(raw), bool)
    ends = np.cumsum(size)
    inside[ends - 1] = inside[ends - 2] = False
    return (code[inside[: len(code)]] % CHAR_BUCKETS).astype(np.int64), size - 2


def named(word: bytes) -> list[bytes]:
    """What may have a vector of its own: the word and its beginnings."""
    return [word, *(b"^" + word[:n] for n in BEGINNINGS)]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words: every STRIDE words, and a last whole window that ends with the text."""
    last = max(0, n - WINDOW)
    return [*range(0, last, STRIDE), last]


@dataclass
class Network:
    """Parameters by name; vocabulary: training words, and beginnings of words after a ^, with a vector of their own."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def normal(scale, *shape):
            return rng.normal(0, scale, shape).astype(np.float32)

        p = {"word": normal(0.1, len(vocabulary) + 1, WORD_DIM), "char": normal(0.3, CHAR_BUCKETS, CHAR_DIM)}
        p["word"][0] = 0
        for side in "fb":
            p |= {f"W{side}": normal(0.4, d, 3 * h), f"U{side}": normal(0.3, h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        p |= {"att": normal(0.3, 2 * h), "out": normal(0.3, 2 * h), "bias": np.full(1, -1, np.float32)}
        return cls(vocabulary, p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: the ids of their own vectors and of their beginnings, and their trigrams one after another with counts."""
        bare = [w.strip(_STRIP) for w in words]
        own = np.array([[self.vocabulary.get(x, 0) for x in named(b)] for b in bare], np.int64).reshape(-1, 1 + len(BEGINNINGS))
        return own, *trigrams(bare)

    def vectors(self, own: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        begin = np.cumsum(counts) - counts
        chars = np.add.reduceat(self.p["char"][grams], begin, axis=0) / counts[:, None] if len(counts) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][own].sum(axis=1), chars.astype(np.float32)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru(xs: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (time, batch, HIDDEN) over input projections xs (time, batch, 3 HIDDEN: update, reset, candidate).

    Where mask is 0 the state stays. keep: returns also what the backward pass needs.
    """
    h = HIDDEN
    state = np.zeros((xs.shape[1], h), np.float32)
    states = np.empty((len(xs), xs.shape[1], h), np.float32)
    saved = []
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
    for t in range(len(xs)):
        gates = state @ u_gates
        gates += xs[t, :, : 2 * h]
        np.clip(gates, -30, 30, out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :h] * mask[t][:, None], gates[:, h:]
        new = np.tanh((r * state) @ u_new + xs[t, :, 2 * h :])
        if keep:
            saved.append((state, z, r, new, gates[:, :h]))
        state = state + z * (new - state)
        states[t] = state
    return (states, saved) if keep else states


def gru_back(d_states: np.ndarray, saved, u: np.ndarray, mask: np.ndarray):
    """Gradients of the input projections and of u, given those of the states."""
    h = HIDDEN
    d_xs = np.empty((len(saved), d_states.shape[1], 3 * h), np.float32)
    d_u = np.zeros_like(u)
    d = np.zeros_like(d_states[0])
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, new, zz = saved[t]
        d = d + d_states[t]
        d_new = d * z * (1 - new * new)
        d_z = d * (new - state) * mask[t][:, None] * zz * (1 - zz)
        back = d_new @ u[:, 2 * h :].T
        d_r = back * state * r * (1 - r)
        d_gates = np.concatenate([d_z, d_r], axis=1)
        d_xs[t, :, : 2 * h], d_xs[t, :, 2 * h :] = d_gates, d_new
        d_u[:, : 2 * h] += state.T @ d_gates
        d_u[:, 2 * h :] += (r * state).T @ d_new
        d = d * (1 - z) + back * r + d_gates @ u[:, : 2 * h].T
    return d_xs, d_u


def pooled(forward: np.ndarray, backward: np.ndarray, att: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of both directions, attention weights and the pooled state. Windows without a word pool to zero."""
    states = np.concatenate([forward, backward], axis=2)
    logit = np.where(mask > 0, states @ att, -1e9)
    weight = np.exp(logit - logit.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    return states, weight, np.einsum("tb,tbh->bh", weight, states)


def score_windows(net: Network, table_f: np.ndarray, table_b: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows; ids (time, batch) are rows of the tables of input projections."""
    forward = gru(table_f[ids], net.p["Uf"], mask)
    backward = gru(table_b[ids[::-1]], net.p["Ub"], mask[::-1])[::-1]
    return pooled(forward, backward, net.p["att"], mask)[2] @ net.p["out"] + net.p["bias"][0]


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def loss_and_gradients(net: Network, own, grams, counts, ids, mask, target, weight):
    """Logistic loss over windows and its gradients by parameter. ids: (time, batch) places among the distinct words."""
    p, h = net.p, HIDDEN
    x = net.vectors(own, grams, counts)
    fs, keep_f = gru((x @ p["Wf"] + p["cf"])[ids], p["Uf"], mask, True)
    bs, keep_b = gru((x @ p["Wb"] + p["cb"])[ids[::-1]], p["Ub"], mask[::-1], True)
    states, att, pool = pooled(fs, bs[::-1], p["att"], mask)
    logit = pool @ p["out"] + p["bias"][0]
    prob = _sigmoid(np.clip(logit, -30, 30))
    loss = -np.sum(weight * (target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9)))
    d_logit = (weight * (prob - target)).astype(np.float32)
    g = {"bias": np.array([d_logit.sum()], np.float32), "out": pool.T @ d_logit}
    d_pool = d_logit[:, None] * p["out"]
    d_att = np.einsum("tbh,bh->tb", states, d_pool)
    d_score = att * (d_att - (att * d_att).sum(axis=0))
    g["att"] = np.einsum("tb,tbh->h", d_score, states)
    d_states = att[:, :, None] * d_pool + d_score[:, :, None] * p["att"]
    d_x = np.zeros_like(x)
    for side, back, saved, flow, which in (("f", False, keep_f, d_states[:, :, :h], ids), ("b", True, keep_b, d_states[::-1, :, h:], ids[::-1])):
        d_xs, g[f"U{side}"] = gru_back(np.ascontiguousarray(flow), saved, p[f"U{side}"], mask[::-1] if back else mask)
        flat = d_xs.reshape(-1, 3 * h)
        g[f"c{side}"] = flat.sum(axis=0)
        d_proj = np.stack([np.bincount(which.ravel(), flat[:, k], len(x)) for k in range(3 * h)], axis=1).astype(np.float32)
        g[f"W{side}"] = x.T @ d_proj
        d_x += d_proj @ p[f"W{side}"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], own, d_x[:, None, :WORD_DIM])
    g["word"][0] = 0
    share = np.repeat(d_x[:, WORD_DIM:] / counts[:, None], counts, axis=0)
    g["char"] = np.stack([np.bincount(grams, share[:, k], CHAR_BUCKETS) for k in range(CHAR_DIM)], axis=1).astype(np.float32)
    return float(loss), g


def _batch(windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.zeros((WINDOW, len(windows)), np.int64)
    mask = np.zeros((WINDOW, len(windows)), np.float32)
    for k, w in enumerate(windows):
        ids[: len(w), k] = w
        mask[: len(w), k] = 1
    return ids, mask


def train(texts: list[str], labels: list[int], epochs: int = 5, least_steps: int = 500, seed: int = 7, by_odds: bool = True) -> Network:
    """A network fitted to texts with labels 0 and 1.

    The label is that of the text, not of a window, so now and then all windows are scored anew and a
    toxic text learns from its worst window, a clean one from all of a sample and its worst. A first round
    picks the windows by the log odds of their words. Few texts are gone over more often, for least_steps
    steps or more. Without texts of both labels, the network keeps to its prior. by_odds: whether log odds pick the
    first windows and start the vectors of trigrams; without it both are random.
    """
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    bare = [[w.strip(_STRIP) for w in ws] for ws in split]
    seen = Counter(chain.from_iterable({x for w in set(ws) for x in named(w)} for ws in bare))
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in seen.items() if c >= 3))}
    net = Network.fresh(vocabulary, seed)
    if not len(y) or y.min() == y.max():
        net.p["bias"][:] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        net.p["out"][:] = 0
        return net
    distinct = sorted(set(chain.from_iterable(split)))
    place = {w: i for i, w in enumerate(distinct)}
    own, grams, counts = net.inputs(distinct)
    texts_ids = [[place[w] for w in ws] for ws in split]
    windows, of = [], []
    for t, ids in enumerate(texts_ids):
        for a in window_starts(len(ids)):
            windows.append(ids[a : a + WINDOW])
            of.append(t)
    of = np.array(of)
    begin = np.concatenate([[0], np.cumsum(counts)])

    # the first choice of windows: log odds of trigrams over texts
    grams_of = [grams[begin[i] : begin[i + 1]] for i in range(len(distinct))]
    hits = np.ones((2, CHAR_BUCKETS))
    for ids, label in zip(texts_ids, labels, strict=True):
        if ids:
            hits[int(label)][np.unique(np.concatenate([grams_of[i] for i in set(ids)]))] += 1
    totals = np.bincount(y.astype(int), minlength=2) + 2.0
    odds = np.log(hits[1] / totals[1]) - np.log(hits[0] / totals[0])
    word_odds = np.array([np.sort(odds[g])[-2:].mean() for g in grams_of])
    rank = np.array([word_odds[w].max() if w else -9.0 for w in windows])
    if by_odds:
        net.p["char"][:, 0] = np.clip(odds, -2, 4)
    else:
        rank = rng.random(len(windows))

    adam = _Adam(net.p, 0.01)
    share = y.mean()
    size = BATCH
    epochs = max(epochs, -(-least_steps * size // (2 * len(texts))))
    for epoch in range(epochs):
        if epoch in (1, 3, epochs // 2):
            rank = np.concatenate([_logits(net, own, grams, counts, windows[a : a + 2048]) for a in range(0, len(windows), 2048)])
        order = np.lexsort((-rank, of))
        worst = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        extra = rng.permutation(np.flatnonzero(y[of] == 0))[: len(worst)]
        chosen = rng.permutation(np.unique(np.concatenate([worst, extra])))
        for a in range(0, len(chosen), size):
            part = chosen[a : a + size]
            some = [windows[i] for i in part]
            ids, mask = _batch(some)
            used, inverse = np.unique(ids, return_inverse=True)
            sub_grams = np.concatenate([grams_of[i] for i in used])
            target = y[of[part]]
            weight = np.where(target > 0, 0.5 / max(share, 0.05), 1.0).astype(np.float32) / len(part)
            _, grads = loss_and_gradients(net, own[used], sub_grams, counts[used], inverse.reshape(ids.shape), mask, target, weight)
            adam.step(grads)
        adam.rate *= 0.1 ** (1 / epochs)
    return net


def _logits(net: Network, own, grams, counts, windows: list[list[int]]) -> np.ndarray:
    ids, mask = _batch(windows)
    used, inverse = np.unique(ids, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(counts)])
    x = net.vectors(own[used], np.concatenate([grams[begin[i] : begin[i + 1]] for i in used]), counts[used])
    return score_windows(net, x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"], inverse.reshape(ids.shape), mask)


class Scorer:
    """Scores texts; remembers the input projections of the words it has met, up to a number."""

    def __init__(self, net: Network, cached: int = _CACHED):
        self.net, self.cached = net, cached
        self._forget()

    def _forget(self):
        self.place: dict[bytes, int] = {}
        self.f = np.zeros((0, 3 * HIDDEN), np.float32)
        self.b = np.zeros((0, 3 * HIDDEN), np.float32)

    def _ids(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of all words one after another, and the tables of input projections that these are rows of."""
        if len(self.place) > self.cached:
            self._forget()
        fresh = sorted(set().union(*split).difference(self.place), key=len)
        n, f, b = len(self.place), self.f, self.b
        if fresh:
            x = self.net.vectors(*self.net.inputs(fresh))
            f = np.concatenate([f, x @ self.net.p["Wf"] + self.net.p["cf"]])
            b = np.concatenate([b, x @ self.net.p["Wb"] + self.net.p["cb"]])
        now, old = dict(zip(fresh, range(n, n + len(fresh)), strict=True)), self.place.get
        ids = np.fromiter((now[w] if (k := old(w)) is None else k for w in chain.from_iterable(split)), np.int32, sum(map(len, split)))
        few = sum(len(w) <= _SHORT for w in fresh)  # these come first
        self.place.update(zip(fresh[:few], range(n, n + few), strict=True))
        self.f, self.b = (f, b) if few == len(fresh) else (f[: n + few].copy(), b[: n + few].copy())
        return ids, f, b

    def scores(self, texts: list[str]) -> np.ndarray:
        """The largest window probability of each text."""
        split = [words_of(t) for t in texts]
        ids, table_f, table_b = self._ids(split)
        if not len(table_f):
            table_f = table_b = np.zeros((1, 3 * HIDDEN), np.float32)
        lens = np.fromiter(map(len, split), np.int64, len(split))
        offs = np.cumsum(lens) - lens
        last = np.maximum(0, lens - WINDOW)
        times = -(-last // STRIDE) + 1
        text = np.repeat(np.arange(len(split)), times)
        start = np.minimum((np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)) * STRIDE, last[text])
        size = np.minimum(WINDOW, lens[text] - start)
        best = np.full(len(split), -np.inf)
        order = np.argsort(size, kind="stable")
        step = np.arange(WINDOW)[:, None]
        for a in range(0, len(order), 1024):
            w = order[a : a + 1024]
            longest = max(1, int(size[w[-1]]))
            inside = step[:longest] < size[w]
            at = np.where(inside, (offs[text[w]] + start[w]) + step[:longest], 0)
            rows = ids[at] if len(ids) else np.zeros(at.shape, np.int32)
            logit = score_windows(self.net, table_f, table_b, rows, inside.astype(np.float32))
            np.maximum.at(best, text[w], logit)
        return _sigmoid(np.clip(best, -30, 30))


def held_out() -> F.Column:
    """Rows that learn nothing: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Network:
    """A network trained on labelled documents outside the held-out fifth.

    At most training_rows of them, those with the smallest hash of their id, of TRAINING_CHARS characters at most, are brought to the
    driver. Rows without an id, label or text teach nothing; repeated rows all count, within that number.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(training_rows)
    given = docs.where(F.length("text") <= TRAINING_CHARS).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = given.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(training_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    return train([r.text for r in rows], [int(r.toxic) for r in rows])


def toxicity(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text; a column of that name is replaced.

    A null or empty text is one window without words. Texts alone decide: equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    own = docs.drop(score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(shared, Scorer)
        for part in slices(batches):
            found = scorer.scores([t or "" for t in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, score_col])

    return own.mapInArrow(run, own.select("*", F.lit(0.0).alias(score_col)).schema)
