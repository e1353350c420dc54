"""Hashed word and character n-grams of whole Arrow batches, and a small logistic regression over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from korpusflow.llm.common import coded, hashes, mix, words

#: Buckets of the hashed weight vector; its size does not depend on the data.
BITS = 18
CHAR_SIZES = (3, 4, 5)


def bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def char_grams(distinct: list[str], sizes=CHAR_SIZES, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (or whole 64-bit hashes) of the character n-grams of each word (with a space at either end), and where
    each word's begin and end."""
    if not distinct:
        return np.zeros(0, np.uint64 if whole else np.int64), np.zeros(1, np.int64)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    chars = np.frombuffer((" " + "  ".join(distinct) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(distinct)), lengths)
    left = ends[owner + 1] - np.arange(len(chars))  # characters from here to the word's end
    found, owners = [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + chars[at + k]
            found.append(mix(h) if whole else bucket(mix(h)))
            owners.append(owner[at])
    if len(sizes) == 1:
        return found[0], np.concatenate([[0], np.cumsum(np.bincount(owners[0], minlength=len(distinct)))])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(distinct))
    return found[order], np.concatenate([[0], np.cumsum(counts)])


def best_piece(distinct: list[str], sizes, value_of) -> np.ndarray:
    """The largest value of each word's character n-grams (0 without any), one size at a time."""
    best = np.zeros(len(distinct))
    for n in sizes:
        pieces, ends = char_grams(distinct, (n,), whole=True)
        some = np.diff(ends) > 0
        if some.any():
            best[some] = np.maximum(best[some], np.maximum.reduceat(value_of(pieces), ends[:-1][some]))
    return best


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


class Grams:
    """The n-grams of a batch of texts."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        flat, self.ends = words(texts, lower)
        self.codes, self.distinct = coded(flat)
        h = hashes(self.distinct)
        self.word = bucket(h)
        with np.errstate(over="ignore"):
            of_token = h[self.codes] if len(h) else h
            self.pairs = bucket(mix(of_token[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + of_token[1:]))
        self.paired = np.ones(len(self.pairs), bool)  # no pair reaches over the end of a text
        last = self.ends[1:] - 1
        last = last[(last >= 0) & (last < len(self.pairs))]
        self.paired[last] = False

    def sparse(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Buckets and values of each text: counts over the number of its words."""
        out, (chars, char_ends) = [], char_grams(self.distinct)
        for a, b in zip(self.ends, self.ends[1:]):
            codes = self.codes[a:b]
            parts = [self.word[codes], self.pairs[a : max(a, b - 1)][self.paired[a : max(a, b - 1)]]]
            parts += [chars[char_ends[c] : char_ends[c + 1]] for c in codes]
            at, counts = np.unique(np.concatenate(parts), return_counts=True)
            out.append((at, counts / max(1, b - a)))
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Weights times the values of sparse(), without making them."""
        if not len(self.codes):
            return np.zeros(len(self.ends) - 1)
        per_word = weights[self.word].astype(np.float64)
        for n in CHAR_SIZES:  # one size at a time bounds what is held
            chars, char_ends = char_grams(self.distinct, (n,))
            per_word += sums(weights[chars], char_ends)
        total = sums(per_word[self.codes], self.ends)
        pairs = np.where(self.paired, weights[self.pairs], 0.0) if len(self.pairs) else np.zeros(0)
        total += sums(np.append(pairs, 0.0), self.ends)
        return total / np.maximum(1, np.diff(self.ends))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150, ridge: float = 1e-4, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression (Adam over all rows, classes weighted to the same total)."""
    size = 1 << BITS
    w, bias = np.zeros(size), 0.0
    if not len(rows) or labels.min() == labels.max():
        return w, 0.0 if not len(rows) else (4.0 if labels[0] else -4.0)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    col = np.concatenate([r[0] for r in rows]).astype(np.int32)
    used = np.flatnonzero(np.bincount(col, minlength=size))
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    col = place[col]
    val = np.concatenate([r[1] for r in rows]).astype(np.float32)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    u, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * u[col], len(rows)) + u[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share
        g = np.append(np.bincount(col, val * err[row], len(used)) + ridge * u[:-1] / len(labels), err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        u -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w[used], bias = u[:-1], float(u[-1])
    return w, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, with smoothed targets (Newton steps)."""
    if not len(labels) or labels.min() == labels.max():
        return 1.0, 0.0
    n1 = labels.sum()
    n0 = len(labels) - n1
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
