"""A linear-chain conditional random field over numpy batches of sequences.

Sequences of all lengths run side by side, one time step after the other: they are ordered by
length, so the ones still running are always the first rows. Scores of a token are sums of
hashed feature weights; transitions between labels are learned with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from .memo import grown


def hashed(features: list[str], width: int) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) % width for f in features]


class Steps:
    """Where each token of sequences of the given lengths lies when ordered by time step."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        longest = int(lengths.max()) if len(lengths) else 0
        ended = np.bincount(lengths, minlength=longest + 1)
        #: Sequences that have a token at each step.
        self.running = (len(lengths) - np.cumsum(ended))[:longest]
        self.first = np.concatenate([[0], np.cumsum(self.running)])
        total = int(lengths.sum())
        time = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.at = self.first[time] + np.repeat(rank, lengths)

    def __iter__(self):
        return zip(self.first[:-1].tolist(), self.running.tolist())


def _exponent(x: np.ndarray) -> np.ndarray:
    return np.exp(x - x.max(axis=1, keepdims=True))


#: Sequences of more than LONG tokens are worked on in chunks of CHUNK tokens, side by side.
LONG, CHUNK = 4096, 256


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def long_forward_backward(scores: np.ndarray, transitions: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Label probabilities of one long sequence, exact: what each chunk does to the forward and backward values is one
    matrix, a product over its tokens; carried from chunk to chunk these give the values at the chunks' ends, and
    then all chunks are gone through side by side."""
    n, labels = scores.shape
    chunks, tail = -(-n // chunk), n % chunk or chunk
    p = np.ones((chunks * chunk, labels))
    p[:n] = _exponent(scores)
    p = p.reshape(chunks, chunk, labels)
    move = np.exp(transitions)
    does = np.broadcast_to(np.eye(labels), (chunks, labels, labels))
    for k in range(chunk):
        on = chunks if k < tail else chunks - 1  # only the last chunk may be shorter
        does = np.concatenate([_scaled((does[:on] @ move) * p[:on, k, None, :]), does[on:]])
    # Values before each chunk, and after it. The sequence's first token has none before it.
    first = p[0, 0]
    for k in range(1, chunk if chunks > 1 else tail):
        first = (first @ move) * p[0, k]
        first = first / first.sum()
    before, after = np.ones((chunks, labels)), np.ones((chunks, labels))
    end = first
    for c in range(1, chunks):
        before[c] = end
        end = end @ does[c]
        end = end / end.sum()
    for c in range(chunks - 2, -1, -1):
        b = does[c + 1] @ after[c + 1]
        after[c] = b / b.sum()
    del does
    out = np.empty_like(p)
    a = before @ move
    a[0] = 1.0
    for k in range(chunk):
        a = _scaled(a * p[:, k])
        out[:, k] = a
        a = a @ move
    b = after
    for k in range(chunk - 1, -1, -1):
        on = slice(None) if k < tail else slice(0, chunks - 1)
        out[on, k] *= b[on]
        if k:
            b[on] = _scaled((p[on, k] * b[on]) @ move.T)
    out = out.reshape(-1, labels)[:n]
    out /= out.sum(axis=1, keepdims=True)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Label probabilities of each token; with pairs also the expected count of each transition."""
    lengths = np.asarray(lengths, np.int64)
    if not pairs and len(lengths) and lengths.max() > LONG:
        ends = np.cumsum(lengths)
        long_ = np.repeat(lengths > LONG, lengths)
        out = np.empty((len(scores), len(transitions)))
        out[~long_] = forward_backward(scores[~long_], lengths[lengths <= LONG], transitions)
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[ends[k] - lengths[k] : ends[k]] = long_forward_backward(scores[ends[k] - lengths[k] : ends[k]].astype(np.float64), transitions)
        return out
    steps = Steps(lengths)
    p = np.empty_like(scores, dtype=np.float64)
    p[steps.at] = _exponent(scores.astype(np.float64))
    move = np.exp(transitions)
    alpha = np.empty_like(p)
    spans = list(steps)
    for k, (first, n) in enumerate(spans):
        a = p[first : first + n]
        if k:
            a = a * (alpha[spans[k - 1][0] : spans[k - 1][0] + n] @ move)
        alpha[first : first + n] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(move)
    beta = np.ones((spans[-1][1] if spans else 0, len(move)))
    for k in range(len(spans) - 1, -1, -1):
        first, n = spans[k]
        here = alpha[first : first + n]
        if k:
            prior, before = spans[k - 1]
            ahead = p[first : first + n] * beta
            b = ahead @ move.T
            if pairs:
                last = alpha[prior : prior + n]
                expected += move * ((last / (last * b).sum(axis=1, keepdims=True)).T @ ahead)
        here *= beta  # the label probabilities take the place of the forward values
        here /= here.sum(axis=1, keepdims=True)
        if k:
            beta = np.ones((before, len(move)))
            beta[:n] = b / b.sum(axis=1, keepdims=True)
    return (alpha[steps.at], expected) if pairs else alpha[steps.at]


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The most probable label of each token, sequence by sequence; ties go to the first label."""
    steps = Steps(lengths)
    e = np.empty_like(scores, dtype=np.float64)
    e[steps.at] = scores
    spans, labels = list(steps), scores.shape[1]
    back = np.zeros(e.shape, np.int8)
    best = e
    for k in range(1, len(spans)):
        (prior, _), (first, n) = spans[k - 1], spans[k]
        for label in range(labels):
            way = best[prior : prior + n] + transitions[:, label]
            back[first : first + n, label] = way.argmax(axis=1)
            best[first : first + n, label] += way.max(axis=1)
    path = np.zeros(len(e), np.int8)
    for k in range(len(spans) - 1, -1, -1):
        first, n = spans[k]
        on = spans[k + 1][1] if k + 1 < len(spans) else 0
        path[first + on : first + n] = best[first + on : first + n].argmax(axis=1)
        if on:
            ahead = spans[k + 1][0]
            path[first : first + on] = back[np.arange(ahead, ahead + on), path[ahead : ahead + on]]
    return path[steps.at]


class Features:
    """The hashed features of distinct tokens, as flat arrays."""

    def __init__(self, lists: list[list[int]]):
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.fromiter((i for x in lists for i in x), np.int64, int(self.sizes.sum()))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.flat], self.starts, axis=0)

    def gather(self, by_token: np.ndarray, width: int) -> np.ndarray:
        return np.stack([np.bincount(self.flat, np.repeat(g, self.sizes), width) for g in by_token.T], axis=1)


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, v, n) for v in values.T], axis=1)


def train(
    views: list[tuple[Features, np.ndarray]], gold: np.ndarray, lengths: np.ndarray, labels: int, width: int, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, labels) and transitions, by Adam on the regularised log-likelihood.

    Each view is the features of distinct values and the value's number at each token (-1: none);
    a token's score is the sum over views. Every value must have a feature.
    """
    weights, moves = np.zeros((width, labels)), np.zeros((labels, labels))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    n = max(1, len(gold))
    firsts = np.zeros(n, bool)
    firsts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    inner = np.flatnonzero(~firsts)
    seen = np.bincount(gold[inner - 1] * labels + gold[inner], minlength=labels * labels).reshape(labels, labels)
    target = np.eye(labels)[gold]
    for k in range(1, rounds + 1):
        scores = np.zeros((len(gold), labels))
        for features, at in views:
            by_value = np.vstack([features.scores(weights), np.zeros((1, labels))])
            scores += by_value[at]
        gamma, expected = forward_backward(scores, lengths, moves, pairs=True)
        error = (gamma - target) / n
        slope = ridge * weights
        for features, at in views:
            held = at >= 0
            slope += features.gather(sums(at[held], error[held], len(features.sizes)), width)
        for x, g, m, v in ((weights, slope, state[0], state[1]), (moves, (expected - seen) / n + ridge * moves, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return weights, moves


class Scored:
    """Scores of tokens by their number; each feature function gives its columns, side by side.

    Tokens with equal key(token) must have equal features, which are then worked out once.
    """

    def __init__(self, features: list[Callable[[str], list[str]]], weights: np.ndarray, key: Callable[[str], object] | None = None):
        self.features, self.weights, self.key = features, weights, key
        self.table = np.zeros((1 << 12, len(features) * weights.shape[1]), np.float32)
        self.known: dict[object, np.ndarray] = {}

    def _scores(self, tokens: list[str]) -> np.ndarray:
        width = len(self.weights)
        return np.hstack([Features([hashed(f(t), width) for t in tokens]).scores(self.weights) for f in self.features]).astype(np.float32)

    def learn(self, tokens: list[str], first: int) -> None:
        self.table = grown(self.table, first + len(tokens))
        if self.key is None:
            self.table[first : first + len(tokens)] = self._scores(tokens)
            return
        keys = [self.key(t) for t in tokens]
        fresh = {k: t for k, t in zip(keys, tokens) if k not in self.known}
        if fresh:
            self.known.update(zip(fresh, self._scores(list(fresh.values()))))
        self.table[first : first + len(tokens)] = [self.known[k] for k in keys]
        if len(self.known) > 200_000:
            self.known = {}
