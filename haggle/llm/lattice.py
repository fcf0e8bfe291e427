"""The lattice of all ways to cut words into pieces of an existing vocabulary, many words at a time.

Pieces stand in a double-array trie over their UTF-8 bytes. All positions of a batch of words walk the trie
together; every match is an edge of the lattice. Both the best path and the sum over paths then go through
the positions of all words at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MARK = "▁"
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0


def log_scores(scores: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Scores of a model file as natural logs of probabilities.

    Those of a unigram model are logs already. Those of a BPE model are places in the order of its merges, whole numbers from 0 down;
    piece number r then counts as 1 / (1 + r), over the sum of these for all usable pieces: Zipf's law.
    """
    if not (scores == np.round(scores)).all():
        return scores
    weight = 1 / (1 + scores[usable].max(initial=0) - scores)
    return np.log(weight / weight[usable].sum())


@dataclass
class DoubleArray:
    """node s has the child over byte b at t = base[s] + b + 1 if check[t] == s; value[t] is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for piece, i in pieces.items():
            at = root
            for byte in piece:
                at = at.setdefault(byte, {})
            at[-1] = i
        size = 1 << 14
        base, check, value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        check[0] = 0
        free, high, waiting = 1, 1, [(root, 0)]
        for node, s in waiting:  # grows while it is read: breadth first
            value[s] = node.get(-1, -1)
            children = np.array(sorted(b for b in node if b >= 0), np.int64)
            if not len(children):
                continue
            # the first place where all children fall on free slots
            at, width = max(0, free - int(children[0]) - 1), 1 << 10
            while True:
                if at + width + 300 > size:
                    base, check, value = (np.concatenate([x, np.full(size, e, np.int32)]) for x, e in ((base, 0), (check, -1), (value, -1)))
                    size *= 2
                fits = check[at + children[0] + 1 : at + children[0] + 1 + width] < 0
                for c in children[1:]:
                    fits &= check[at + c + 1 : at + c + 1 + width] < 0
                if fits.any():
                    break
                at, width = at + width, width * 2
            b = at + int(fits.argmax())
            base[s] = b
            slots = b + children + 1
            check[slots] = s
            high = max(high, int(slots[-1]))
            waiting += [(node[c], t) for c, t in zip(children.tolist(), slots.tolist(), strict=True)]
            while check[free] >= 0:
                free += 1
        return cls(base[: high + 1].copy(), check[: high + 1].copy(), value[: high + 1].copy())


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model with their scores, and ids of the byte pieces."""

    trie: DoubleArray
    scores: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    unknown_score: float
    longest: int  # bytes of the longest piece
    #: Whether a cut before a marker that follows another character loses nothing, and the same for newlines.
    splits_words: bool = field(default=True)
    splits_lines: bool = field(default=True)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], byte_ids: list[int], surface: list[bytes] | None = None) -> Vocabulary:
        """pieces[i] of None takes no part in matching (control and byte pieces)."""
        known = {p.encode(): i for i, p in enumerate(pieces) if p}
        own = [p for p in pieces if p]
        across = any(MARK in p.lstrip(MARK) for p in own)
        lowest = min((scores[i] for i, p in enumerate(pieces) if p), default=0.0)
        shown = surface or [(p or "").replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            shown[i] = bytes([b])
        return cls(DoubleArray.build(known), np.array(scores, np.float64), shown, np.array(byte_ids, np.int32), lowest - UNKNOWN_PENALTY, max(map(len, known), default=1), not across, not any("\n" in p for p in own))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = log_scores(np.array([model.get_score(i) for i in ids]), ~np.array(special))
        return cls.of([None if special[i] else model.id_to_piece(i) for i in ids], scores.tolist(), byte_ids)


@dataclass
class Lattice:
    """Edges src -> tgt (nodes: byte offset plus number of the word) over piece (-1: unknown character)."""

    buffer: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    src: np.ndarray
    tgt: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    n_nodes: int

    @classmethod
    def over(cls, trie: DoubleArray, words: list[bytes]) -> Lattice:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        offs = np.concatenate([[0], np.cumsum(lens)])
        buffer = np.frombuffer(b"".join(words), np.uint8)
        word_of = np.repeat(np.arange(len(words)), lens)
        stop = offs[1:][word_of] if len(buffer) else np.zeros(0, np.int64)
        starts = np.flatnonzero((buffer & 0xC0) != 0x80)
        width = np.diff(np.append(starts, len(buffer)))
        known = np.zeros(len(buffer) + 1, bool)
        char_end = np.zeros(len(buffer) + 1, np.int64)
        char_end[starts] = starts + width
        at, state, p = starts, np.zeros(len(starts), np.int64), starts
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = len(trie.base)
        while len(at):
            inside = p < stop[at]
            at, state, p = at[inside], state[inside], p[inside]
            to = trie.base[state] + buffer[p].astype(np.int64) + 1
            ok = to < size
            ok[ok] = trie.check[to[ok]] == state[ok]
            at, state, p = at[ok], to[ok], p[ok] + 1
            ids = trie.value[state]
            hit = ids >= 0
            if hit.any():
                found.append((at[hit], p[hit], ids[hit]))
                single = hit & (p == char_end[at])
                known[at[single]] = True
        lone = starts[~known[starts]]
        found.append((lone, char_end[lone], np.full(len(lone), -1, np.int32)))
        a, b, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        word = word_of[a] if len(a) else a
        order = np.lexsort((a, b, b - offs[word]))
        a, b, ids, word = a[order], b[order], ids[order], word[order]
        n = np.arange(len(words))
        return cls(buffer, offs[:-1] + n, offs[1:] + n, a + word, b + word, ids, word, len(buffer) + len(words))

    def _steps(self, where: np.ndarray, descending: bool = False):
        """Slices of edges whose node in `where` stands at the same place of its word, and the runs of equal nodes in them."""
        place = where - self.begin[self.word]
        cuts = np.flatnonzero(np.diff(place)) + 1
        bounds = list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(place)].tolist(), strict=True)) if len(place) else []
        for a, b in bounds:
            node = where[a:b]
            yield a, b, np.flatnonzero(np.r_[True, node[1:] != node[:-1]])

    def best(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges of the heaviest path of every word, word by word in order of text; the weights of the paths.

        Of equal paths the one with the longer last piece wins.
        """
        top = np.full(self.n_nodes, -np.inf)
        top[self.begin] = 0.0
        back = np.full(self.n_nodes, -1, np.int64)
        for a, b, runs in self._steps(self.tgt):
            to = self.tgt[a:b]
            reach = top[self.src[a:b]] + weight[a:b]
            most = np.maximum.reduceat(reach, runs)
            equal = np.flatnonzero(reach == np.repeat(most, np.diff(np.r_[runs, b - a])))
            first = equal[np.r_[True, to[equal][1:] != to[equal][:-1]]]
            top[to[first]] = reach[first]
            back[to[first]] = a + first
        at, taken = self.end[self.end > self.begin], []
        while len(at):
            edge = back[at]
            taken.append(edge)
            at = self.src[edge]
            at = at[at != self.begin[self.word[edge]]]
        edges = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        return edges[np.argsort(self.src[edges], kind="stable")], top[self.end]

    def forward(self, weight: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
        """For every node the log of the summed weight (natural logs) of all paths from its word's begin.

        alpha: what other paths have brought to the nodes so far.
        """
        if alpha is None:
            alpha = np.full(self.n_nodes, -np.inf)
            alpha[self.begin] = 0.0
        for a, b, runs in self._steps(self.tgt):
            reach = alpha[self.src[a:b]] + weight[a:b]
            most = np.maximum.reduceat(reach, runs)
            most = np.where(np.isfinite(most), most, 0.0)
            to = self.tgt[a:b][runs]
            with np.errstate(divide="ignore"):
                alpha[to] = np.logaddexp(alpha[to], most + np.log(np.add.reduceat(np.exp(reach - np.repeat(most, np.diff(np.r_[runs, b - a]))), runs)))
        return alpha

    def posterior(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each edge given its word, and the log weight of every word."""
        alpha = self.forward(weight)
        order = np.lexsort((self.src, -(self.src - self.begin[self.word])))
        turned = Lattice(self.buffer, self.begin, self.end, self.src[order], self.tgt[order], self.piece[order], self.word[order], self.n_nodes)
        w = weight[order]
        beta = np.full(self.n_nodes, -np.inf)
        beta[self.end] = 0.0
        for a, b, runs in turned._steps(turned.src):
            reach = beta[turned.tgt[a:b]] + w[a:b]
            most = np.maximum.reduceat(reach, runs)
            most = np.where(np.isfinite(most), most, 0.0)
            with np.errstate(divide="ignore"):
                beta[turned.src[a:b][runs]] = most + np.log(np.add.reduceat(np.exp(reach - np.repeat(most, np.diff(np.r_[runs, b - a]))), runs))
        whole = alpha[self.end]
        return np.exp(alpha[self.src] + weight + beta[self.tgt] - whole[self.word]), whole


#: Words of more bytes go through the lattice in parts.
LONG = 1 << 16


def parts_of(vocabulary: Vocabulary, word: bytes, part: int = 1 << 14):
    """The lattice of a long word in parts: (offset, lattice), each with the edges that begin in a part; memory grows with the part."""
    a = 0
    while a < len(word):
        b = min(len(word), a + part)
        while b < len(word) and word[b] & 0xC0 == 0x80:
            b += 1
        end = min(len(word), b + vocabulary.longest)
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end += 1
        whole = Lattice.over(vocabulary.trie, [word[a:end]])
        own = whole.src < b - a
        yield a, Lattice(whole.buffer, whole.begin, whole.end, whole.src[own], whole.tgt[own], whole.piece[own], whole.word[own], whole.n_nodes)
        a = b


def best_of_long(vocabulary: Vocabulary, word: bytes) -> list[tuple[int, int, int]]:
    """(piece, begin, end) along the heaviest path of a long word; ties as in Lattice.best."""
    top = np.full(len(word) + 1, -np.inf)
    top[0] = 0.0
    source, taken = np.zeros(len(word) + 1, np.int64), np.zeros(len(word) + 1, np.int64)
    for a, lattice in parts_of(vocabulary, word):
        weight = np.where(lattice.piece < 0, vocabulary.unknown_score, vocabulary.scores[lattice.piece])
        for i, j, piece, w in zip((lattice.src + a).tolist(), (lattice.tgt + a).tolist(), lattice.piece.tolist(), weight.tolist(), strict=True):
            if top[i] + w > top[j]:
                top[j], source[j], taken[j] = top[i] + w, i, piece
    out, at = [], len(word)
    while at:
        out.append((int(taken[at]), int(source[at]), at))
        at = int(source[at])
    return out[::-1]


def in_batches(words: list[bytes], most_bytes: int = 1 << 18):
    """Ranges of words, shorter first, of about most_bytes bytes at a time: (places, words)."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    part, size = [], 0
    for i in order:
        part.append(i)
        size += len(words[i]) + 8
        if size >= most_bytes:
            yield part, [words[j] for j in part]
            part, size = [], 0
    if part:
        yield part, [words[j] for j in part]
