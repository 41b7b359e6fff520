"""Skip-chain conditional random field over token sequences, in numpy.

Emission scores are sums of weights of hashed token features at offsets -2 to +2 and of the shapes
of three neighbouring tokens; neighbours share a transition matrix; distant tied tokens share a skip
potential. Inference is loopy belief propagation: exact forward-backward along the chain, then
messages over the skip edges, repeated. Sequences without skip edges take one exact pass, and one
whose every other labelling together is proved to weigh less than half takes none.

Fitting climbs the likelihood of what is known (AdaGrad): a position may have one label, several
allowed ones, or any. Emissions, transitions and the skip potential all take the gradient
"expected under what is known less expected", the latter two sums under the same propagation.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np

OFFSETS = (-2, -1, 0, 1, 2)
EDGE = 2
SHAPES = 16
NEVER = np.float32(-60)
Edges = list[tuple[int, int]]


def hashed(names: Sequence[str], size: int) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % size for n in names]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Numbers(dict):
    """Token to number; a new token is entered with its features."""

    def __init__(self, field: SkipChain):
        super().__init__({"": 0})
        self.field = field

    def __missing__(self, token: str) -> int:
        told = self.field.canonical(token)
        return self.field._enter(token) if told == token else self[told]


class SkipChain:
    """``shape`` gives 1 to 15 for a token, ``allowed`` the labels it may have (None: all), ``canonical`` the token it is alike to."""

    def __init__(self, labels: Sequence[str], features: Callable[[str], list[str]], shape: Callable[[str], int] = lambda t: 1, allowed: Callable[[str], Sequence[int] | None] = lambda t: None, canonical: Callable[[str], str] = lambda t: t, size: int = 1 << 15):
        self.labels, self.features, self.shape, self.allowed, self.canonical, self.size = list(labels), features, shape, allowed, canonical, size
        n = len(self.labels)
        self.weights = np.zeros((len(OFFSETS), size + 1, n), np.float32)  # the last row is the edge of the sequence
        self.shapes = np.zeros((3, SHAPES**3, n), np.float32)
        self.moves, self.begin, self.skip = np.zeros((n, n), np.float32), np.zeros(n, np.float32), np.zeros((n, n), np.float32)
        self.forget(-1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget(-1)

    def forget(self, most: int = 150_000) -> None:
        """Bounds the memo of token features."""
        if most < 0 or len(self._ids) > most:
            self._numbers = _Numbers(self)
            self._ids: list[list[int]] = [[self.size]]
            self._shape_ids, self._masks = [0], [np.zeros(len(self.labels), np.float32)]
            self._scores: np.ndarray | None = None
            self._arrays = (np.zeros(0, np.int64), np.zeros((0, len(self.labels)), np.float32))

    def _of_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Shapes and masks of all tokens entered."""
        if len(self._arrays[0]) < len(self._ids):
            self._arrays = (np.array(self._shape_ids, np.int64), np.array(self._masks, np.float32))
        return self._arrays

    def _enter(self, token: str) -> int:
        n = self._numbers[token] = len(self._ids)
        self._ids.append(hashed(self.features(token), self.size) or [self.size])
        self._shape_ids.append(self.shape(token))
        mask, may = np.zeros(len(self.labels), np.float32), self.allowed(token)
        if may is not None:
            mask[[k for k in range(len(mask)) if k not in may]] = NEVER
        self._masks.append(mask)
        return n

    def _layout(self, sequences: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all tokens with EDGE empty places around every sequence, starts, sizes)."""
        number, told, size = self._numbers.__getitem__, [0] * EDGE, []
        for s in sequences:
            told += map(number, s)
            told += (0,) * EDGE
            size.append(len(s))
        sizes = np.array(size, np.int64)
        return np.array(told, np.int64), np.cumsum(sizes + EDGE) - sizes, sizes

    def _token_scores(self) -> np.ndarray:
        """(offset, token, label); only tokens not scored yet are added."""
        done = 0 if self._scores is None else self._scores.shape[1]
        if done < len(self._ids):
            rows = self._ids[done:]
            ids, firsts = np.concatenate(rows), np.cumsum([0] + [len(r) for r in rows[:-1]])
            fresh = np.stack([np.add.reduceat(w[ids], firsts, axis=0) for w in self.weights])
            self._scores = fresh if done == 0 else np.concatenate([self._scores, fresh], axis=1)
        return self._scores

    def _triples(self, flat: np.ndarray) -> list[np.ndarray]:
        s = self._of_tokens()[0][flat]
        last = len(flat) - EDGE
        at = lambda k: s[EDGE + k : last + k]
        return [(at(a) * SHAPES + at(b)) * SHAPES + at(c) for a, b, c in ((-2, -1, 0), (-1, 0, 1), (0, 1, 2))]

    def _emissions(self, flat: np.ndarray) -> np.ndarray:
        """Scores of every place from EDGE to the end less EDGE."""
        scores, last = self._token_scores(), len(flat) - EDGE
        out = self._of_tokens()[1][flat[EDGE:last]]
        for k, off in enumerate(OFFSETS):
            out += scores[k][flat[EDGE + off : last + off]]
        for table, where in zip(self.shapes, self._triples(flat), strict=True):
            out += table[where]
        return out

    def _chain(self, emit: np.ndarray, size: np.ndarray, pairs: bool = False):
        """Marginals (and summed expected transitions) by forward-backward, rescaled at every step; emit: (sequence, place, label)."""
        count, length, n = emit.shape
        e = np.ascontiguousarray(np.exp(emit - emit.max(2, keepdims=True)).transpose(1, 0, 2))
        move = np.exp(self.moves)
        alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((length, count, 1), e.dtype)
        alpha[0] = e[0] * np.exp(self.begin)
        scale[0] = alpha[0].sum(1, keepdims=True)
        alpha[0] /= scale[0]
        for t in range(1, length):
            np.multiply(alpha[t - 1] @ move, e[t], out=alpha[t])
            alpha[t].sum(1, keepdims=True, out=scale[t])
            alpha[t] /= scale[t]
        beta[-1] = 1
        back = np.ascontiguousarray(move.T)
        shortest = int(size.min())
        for t in range(length - 2, -1, -1):
            step = (e[t + 1] * beta[t + 1] / scale[t + 1]) @ back
            beta[t] = step if t + 1 < shortest else np.where((t + 1 < size)[:, None], step, 1)
        marginal = alpha * beta
        marginal /= marginal.sum(2, keepdims=True)
        marginal = marginal.transpose(1, 0, 2)
        if not pairs:
            return marginal, None
        joint = np.zeros((n, n))
        for t in range(1, length):
            use = t < size
            joint += move * (alpha[t - 1][use].T @ (e[t] * beta[t] / scale[t])[use])
        return marginal, joint

    def _infer(self, emit: np.ndarray, size: np.ndarray, edges: Sequence[Edges], pairs: bool = False, rounds: int = 3):
        """(marginals, summed transitions, summed label pairs at skip edges) of sequences with and without skip edges."""
        tied = [(k, a, b) for k, s in enumerate(edges) for a, b in s]
        if not tied:
            return *self._chain(emit, size, pairs), np.zeros((len(self.labels),) * 2)
        k, a, b = np.array(tied).T
        row, src, dst = np.concatenate([k, k]), np.concatenate([a, b]), np.concatenate([b, a])
        m = len(k)
        other = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, len(self.labels)), np.float32)
        for _ in range(rounds):
            told = emit.copy()
            np.add.at(told, (row, dst), message)
            belief = np.log(self._chain(told, size)[0] + np.float32(1e-9))
            send = belief[row, src] - message[other]
            message = _lse(send[:, :, None] + self.skip, 1)
            message -= _lse(message, 1)[:, None]
        told = emit.copy()
        np.add.at(told, (row, dst), message)
        marginal, joint = self._chain(told, size, pairs)
        met = np.zeros((len(self.labels),) * 2)
        if pairs:
            own = np.log(marginal + np.float32(1e-9))[row, src] - message[other]  # belief without what came over the edge itself
            p = np.exp(own[:m, :, None] + own[m:, None, :] + self.skip)
            p /= p.sum((1, 2), keepdims=True)
            met = p.sum(0)
        return marginal, joint, met

    def fit(self, sequences: list[list[str]], known: list[list], rounds: int = 10, batch: int = 64, rate: float = 0.3, seed: int = 7, skips: Callable[[list[str]], Edges] | None = None, decay: float = 1e-4) -> SkipChain:
        """``known``: for each place a label, a tuple of allowed labels, or None."""
        n = len(self.labels)
        order = sorted(range(len(sequences)), key=lambda i: (any(not isinstance(y, (int, np.integer)) for y in known[i]), len(sequences[i])))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        prepared = [self._prepare([sequences[i] for i in g], [known[i] for i in g], [skips(sequences[i]) if skips else [] for i in g]) for g in groups]
        parts = [self.weights, self.shapes, self.moves, self.begin, self.skip]
        squares = [np.full_like(x, 1e-6) for x in parts]
        kept = [np.zeros_like(x) for x in parts]
        rng, late = np.random.default_rng(seed), rounds // 2
        for turn in range(rounds):
            for g in rng.permutation(len(groups)):
                p = prepared[g]
                words, shapes, *rest = self._gradients(p, n)
                for k, grad in enumerate(words):
                    grad -= decay * self.weights[k][p["place"]]
                    squares[0][k][p["place"]] += grad**2
                    self.weights[k][p["place"]] += rate * grad / np.sqrt(squares[0][k][p["place"]])
                for k, (where, grad) in enumerate(shapes):
                    grad -= decay * self.shapes[k][where]
                    squares[1][k][where] += grad**2
                    self.shapes[k][where] += rate * grad / np.sqrt(squares[1][k][where])
                for what, grad, sq in zip(parts[2:], rest, squares[2:], strict=True):
                    sq += grad**2
                    what += (rate * (grad - decay * what) / np.sqrt(sq)).astype(np.float32)
            if turn >= late:  # the mean of the later rounds stays
                for x, y in zip(kept, parts, strict=True):
                    x += y / (rounds - late)
        self.weights, self.shapes, self.moves, self.begin, self.skip = kept
        self._scores = None
        return self

    def _prepare(self, sequences: list[list[str]], known: list[list], edges: list[Edges]) -> dict:
        """What doesn't change from round to round: places of tokens and features of one batch."""
        flat, start, size = self._layout(sequences)
        grid = start[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)  # places beyond the end repeat the last
        inside = np.arange(grid.shape[1]) < size[:, None]
        used, local = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(used)), [len(self._ids[u]) for u in used])
        ids = np.concatenate([self._ids[u] for u in used])
        place, where = np.unique(ids, return_inverse=True)
        may = np.zeros((*grid.shape, len(self.labels)), np.float32)
        free = False
        for i, labels in enumerate(known):
            for t, y in enumerate(labels):
                if y is not None:
                    may[i, t] = NEVER
                    may[i, t, list(y) if isinstance(y, tuple) else y] = 0
                free |= y is None or isinstance(y, tuple)
        firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        told = None
        if not free:
            right, moved, met = np.zeros_like(may), np.zeros_like(self.moves, np.float64), np.zeros_like(self.moves, np.float64)
            for i, (y, ties) in enumerate(zip(known, edges, strict=True)):
                right[i, np.arange(len(y)), y] = 1
                np.add.at(moved, (y[:-1], y[1:]), 1)
                for a, b in ties:
                    met[y[a], y[b]] += 1
            told = right, moved, met
        return {"told": told, "flat": flat, "local": local, "size": size, "grid": grid, "inside": inside, "owner": owner, "ids": ids, "firsts": firsts, "place": place, "where": where, "may": may, "free": free, "edges": edges, "shape": self._triples(flat), "count": len(used)}

    def _gradients(self, p: dict, n: int) -> tuple:
        """Of the mean likelihood: by feature place at each offset, by shape triples, of transitions, begin and skip."""
        score = [np.add.reduceat(w[p["ids"]], p["firsts"], axis=0) for w in self.weights]
        last = len(p["flat"]) - EDGE
        emit = self._of_tokens()[1][p["flat"][EDGE:last]]
        for k, off in enumerate(OFFSETS):
            emit += score[k][p["local"][EDGE + off : last + off]]
        for table, where in zip(self.shapes, p["shape"], strict=True):
            emit += table[where]
        at = p["grid"] - EDGE
        emit = emit[at]
        guess, moved, met = self._infer(emit, p["size"], p["edges"], True)
        right, right_moved, right_met = self._infer(emit + p["may"], p["size"], p["edges"], True) if p["free"] else p["told"]
        count = len(p["size"])
        gap = ((right - guess)[p["inside"]] / count).astype(np.float64)
        where = p["grid"][p["inside"]]

        def gathered(of: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
            return np.stack([np.bincount(of, values[:, j], rows) for j in range(n)], 1)

        words = [gathered(p["where"], gathered(p["local"][where + off], gap, p["count"])[p["owner"]], len(p["place"])) for off in OFFSETS]
        shapes = []
        for triple in p["shape"]:
            used, local = np.unique(triple[where - EDGE], return_inverse=True)
            shapes.append((used, gathered(local, gap, len(used))))
        tie = (right_met - met) / count
        return words, shapes, (right_moved - moved) / count, (right[:, 0] - guess[:, 0]).mean(0), (tie + tie.T) / 2

    def _quiet(self, emit: np.ndarray, start: np.ndarray, size: np.ndarray, rest: int) -> np.ndarray:
        """Sequences in which every place surely has label ``rest``: all other labellings together weigh less than half.

        Against the labelling ``rest`` throughout, one with others at some places gains at most the product over
        these places of exp(emission gap + best transitions into and out of the label, at least those of ``rest``).
        """
        flat = np.exp(np.minimum(emit - emit[:, rest : rest + 1], 30))
        own = self.moves[rest, rest]
        into = np.maximum(np.maximum(self.moves.max(0), self.begin - self.begin[rest] + own) - own, 0)
        out = np.maximum(self.moves.max(1) - own, 0)
        gain = np.exp(into + out)
        gain[rest] = 0
        share = flat @ gain.astype(np.float32)
        total = np.concatenate([[0], np.cumsum(share, dtype=np.float64)])
        return total[start + size] - total[start] < np.log(2)

    def marginals(self, sequences: list[list[str]], edges: list[Edges] | None = None, rest: int | None = None, cells: int = 40_000) -> list[np.ndarray | None]:
        """Label probabilities of every token of every sequence; with ``rest``, None where that label is proved to lead everywhere."""
        out: list[np.ndarray | None] = [np.zeros((0, len(self.labels)))] * len(sequences)
        flat, start, size = self._layout(sequences)
        if not len(sequences):
            return out
        emit = self._emissions(flat)
        at = start - EDGE
        ties = edges or [[]] * len(sequences)
        alive = size > 0
        if rest is not None:
            quiet = self._quiet(emit, at, size, rest) & alive & np.array([not t for t in ties])
            for i in np.flatnonzero(quiet):
                out[i] = None
            alive &= ~quiet
        order = sorted(np.flatnonzero(alive).tolist(), key=lambda i: (bool(ties[i]), size[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and bool(ties[order[hi]]) == bool(ties[order[lo]]) and (hi + 1 - lo) * size[order[hi]] <= cells:
                hi += 1
            some = order[lo:hi]
            places = at[some][:, None] + np.minimum(np.arange(size[some].max()), size[some][:, None] - 1)
            marginal, _, _ = self._infer(emit[places], size[some], [ties[i] for i in some])
            for k, i in enumerate(some):
                out[i] = marginal[k, : size[i]]
            lo = hi
        return out
