"""A linear-chain conditional random field over token types, trained and decoded in numpy batches.

A token's label score is the sum, over the tokens from REACH before to REACH after it, of a weight vector for each
feature of that token at that distance; neighbouring labels add a transition score. As features depend on the token
alone, each distinct token costs its feature sums once, and decoding gathers them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

REACH = 4


class Crf:
    """features(token) gives the feature strings of a token."""

    def __init__(self, labels: list[str], features: Callable[[str], list[str]]):
        self.labels, self.features = labels, features
        self.index: dict[str, int] = {}
        self.offsets = 2 * REACH + 1
        self.bias = np.zeros(len(labels))  # added to the labels' scores when decoding
        self.forget()

    def forget(self) -> None:
        self.types: dict[str, int] = {"": 0}
        self.scores: list[np.ndarray] = []

    # training -----------------------------------------------------------------------------------------------------

    def fit(self, sentences: list[list[str]], tags: list[list[int]], epochs: int = 8, batch: int = 64, rate: float = 0.25, decay: float = 1e-5, seed: int = 1) -> Crf:
        """Maximum likelihood by AdaGrad over shuffled batches; deterministic for a seed."""
        rng = np.random.default_rng(seed)
        numbers: dict[str, int] = {"": 0}
        for s in sentences:
            for t in s:
                numbers.setdefault(t, len(numbers))
        feats = [[]] + [[self.index.setdefault(f, len(self.index) + 1) for f in self.features(t)] for t in list(numbers)[1:]]
        most = max(map(len, feats))
        table = np.zeros((len(feats), most), np.int64)
        for i, f in enumerate(feats):
            table[i, : len(f)] = f
        n = len(self.labels)
        self.weights = np.zeros((self.offsets, len(self.index) + 1, n))
        self.moves, self.first = np.zeros((n, n)), np.zeros(n)
        square = [np.full_like(w, 1e-6) for w in (self.weights, self.moves, self.first)]
        rows = [np.array([numbers[t] for t in s]) for s in sentences]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            order = order[np.argsort([len(rows[i]) // 8 for i in order], kind="stable")]  # like lengths together
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for g in rng.permutation(len(groups)):
                self._step([rows[i] for i in groups[g]], [tags[i] for i in groups[g]], table, square, rate, decay)
        self.forget()
        return self

    def _step(self, rows, tags, table, square, rate, decay) -> None:
        b, width, n = len(rows), max(map(len, rows)), len(self.labels)
        ids = np.zeros((b, width + 2 * REACH), np.int64)
        gold = np.full((b, width), -1)
        for i, (r, t) in enumerate(zip(rows, tags)):
            ids[i, REACH : REACH + len(r)] = r
            gold[i, : len(r)] = t
        used, inverse = np.unique(ids, return_inverse=True)
        inverse = inverse.reshape(ids.shape)
        own = table[used]
        emission = np.zeros((b, width, n))
        for o in range(self.offsets):
            emission += self.weights[o][own].sum(axis=1)[inverse[:, o : o + width]]
        real = gold >= 0
        # forward and backward in probabilities scaled at each token; padding passes the state on unchanged
        local = np.exp(emission - emission.max(axis=2, keepdims=True))
        top = self.moves.max()
        jump = np.exp(self.moves - top)
        alpha, beta, scale = np.zeros((b, width, n)), np.ones((b, width, n)), np.ones((b, width))
        now = local[:, 0] * np.exp(self.first - self.first.max())
        for t in range(width):
            if t:
                now = np.where(real[:, t, None], (alpha[:, t - 1] @ jump) * local[:, t], alpha[:, t - 1])
            scale[:, t] = np.where(real[:, t], now.sum(axis=1), 1)
            alpha[:, t] = now / scale[:, t, None]
        for t in range(width - 2, -1, -1):
            step = (local[:, t + 1] * beta[:, t + 1]) @ jump.T / scale[:, t + 1, None]
            beta[:, t] = np.where(real[:, t + 1, None], step, 1)
        wrong = alpha * beta * real[:, :, None]
        at = np.nonzero(real)
        wrong[at[0], at[1], gold[at]] -= 1
        on = real[:, 1:]
        after = (local[:, 1:] * beta[:, 1:] / scale[:, 1:, None])[on]
        moves = jump * (alpha[:, :-1][on].T @ after)
        np.add.at(moves, (gold[:, :-1][on], gold[:, 1:][on]), -1)
        flat = np.ascontiguousarray(wrong.reshape(-1, n).T)
        some, own_at = np.unique(own, return_inverse=True)  # the features of this batch; feature 0 is none
        own_at = own_at.ravel()
        grad = np.zeros((self.offsets, len(some), n))
        for o in range(self.offsets):
            where = inverse[:, o : o + width].ravel()
            for c in range(n):
                by_type = np.bincount(where, flat[c], len(used))
                grad[o, :, c] = np.bincount(own_at, np.repeat(by_type, own.shape[1]), len(some))
        held = self.weights[:, some]
        grad = grad / b + decay * held
        grad[:, some == 0] = 0
        seen = square[0][:, some] + grad * grad
        square[0][:, some] = seen
        self.weights[:, some] = held - rate * grad / np.sqrt(seen)
        for w, g, s in ((self.moves, moves / b, square[1]), (self.first, wrong[:, 0].sum(axis=0) / b, square[2])):
            s += g * g
            w -= rate * g / np.sqrt(s)

    # decoding -----------------------------------------------------------------------------------------------------

    def _number(self, token: str) -> int:
        number = self.types.get(token)
        if number is None:
            number = self.types[token] = len(self.types)
            own = [i for f in self.features(token) if (i := self.index.get(f))]
            self.scores.append(self.weights[:, own].sum(axis=1) if own else np.zeros((self.offsets, len(self.labels))))
        return number

    def decode(self, sentences: list[list[str]], most_types: int = 200_000) -> list[np.ndarray]:
        """The labels of each sentence by Viterbi, in batches of like length."""
        if len(self.types) > most_types:
            self.forget()
        if not self.scores:
            self.scores.append(np.zeros((self.offsets, len(self.labels))))
        rows = [np.array([self._number(t) for t in s], np.int64) for s in sentences]
        if isinstance(self.scores, list) and len(self.scores) != getattr(self, "_stacked_at", 0):
            self._stacked, self._stacked_at = np.stack(self.scores), len(self.scores)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        for begin in range(0, len(order), 256):
            own = order[begin : begin + 256]
            for i, path in zip(own, self._viterbi([rows[i] for i in own])):
                out[i] = path
        return out

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        b, width = len(rows), max(map(len, rows))
        ids = np.zeros((b, width + 2 * REACH), np.int64)
        lengths = np.array([len(r) for r in rows])
        for i, r in enumerate(rows):
            ids[i, REACH : REACH + len(r)] = r
        emission = sum(self._stacked[ids[:, o : o + width], o] for o in range(self.offsets)) + self.bias
        score = emission[:, 0] + self.first
        back = np.zeros((b, width, len(self.labels)), np.int16)
        for t in range(1, width):
            step = score[:, :, None] + self.moves
            best = step.argmax(axis=1)
            on = (t < lengths)[:, None]
            back[:, t] = np.where(on, best, np.arange(len(self.labels)))
            score = np.where(on, np.take_along_axis(step, best[:, None, :], 1)[:, 0] + emission[:, t], score)
        path = np.zeros((b, width), np.int64)
        path[:, -1] = score.argmax(axis=1)
        line = np.arange(b)
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = back[line, t, path[:, t]]
        return [path[i, : lengths[i]] for i in range(b)]
