"""Logistic regression on hashed features, trained in numpy: on the driver from a bounded sample (``train``), or on a part of all rows for several folds at once (``train_folds``)."""

from __future__ import annotations

import zlib

import numpy as np

BITS = 18


def slot(feature: str, bits: int = BITS) -> int:
    return zlib.crc32(feature.encode()) & ((1 << bits) - 1)


class Rows:
    """Sparse 0/1 rows: slots of all rows one after the other, and where each row starts. Every row has a slot at least."""

    def __init__(self, rows: list[list[int]] | None = None, slots: np.ndarray | None = None, n: np.ndarray | None = None):
        self.n = np.array([len(r) for r in rows], np.int64) if n is None else n
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.slots = np.fromiter((x for r in rows for x in r), np.int64, self.start[-1]) if slots is None else slots

    def __len__(self) -> int:
        return len(self.n)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, row number in ``at``) of the rows."""
        n = self.n[at]
        row = np.repeat(np.arange(len(at)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.slots[np.repeat(self.start[at], n) + offset], row


def score(weights: np.ndarray, rows: Rows) -> np.ndarray:
    """Log-odds of each row; ``weights`` is (slots,) or (slots, classes)."""
    if not len(rows):
        return np.zeros((0, *weights.shape[1:]))
    out = np.empty((len(rows), *weights.shape[1:]))
    for a in range(0, len(rows), 20_000):
        b = min(a + 20_000, len(rows))
        out[a:b] = np.add.reduceat(weights[rows.slots[rows.start[a] : rows.start[b]]], rows.start[a:b] - rows.start[a], axis=0)
    return out


def train(rows: Rows, labels: np.ndarray, weight: np.ndarray | None = None, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, bits: int = BITS, seed: int = 11, use: np.ndarray | None = None) -> np.ndarray:
    """Weights by minibatch AdaGrad. ``labels``: (n,) or (n, classes) of 0..1; one-versus-rest for several classes. ``use``: the rows to train on."""
    y = labels.reshape(len(rows), -1).astype(np.float64)
    k = y.shape[1]
    seen, place = np.unique(rows.slots, return_inverse=True)
    own_rows = Rows(slots=place, n=rows.n)
    w, g2 = np.zeros((len(seen), k)), np.full((len(seen), k), 1e-8)
    own = np.ones(len(rows)) if weight is None else weight
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(np.arange(len(rows)) if use is None else use)
        for at in np.array_split(order, max(1, len(order) // 512)):
            if not len(at):
                continue
            slots, row = own_rows.take(at)
            n = own_rows.n[at]
            z = np.add.reduceat(w[slots], np.cumsum(n) - n, axis=0)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * own[at, None]
            by = np.argsort(slots, kind="stable")
            used, first = np.unique(slots[by], return_index=True)
            g = np.add.reduceat(error[row[by]], first, axis=0) + l2 * w[used]
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
    out = np.zeros((1 << bits, k))
    out[seen] = w
    return out[:, 0] if labels.ndim == 1 else out


def train_folds(rows: Rows, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray, folds: int, epochs: int, rate: float, l2: float, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``train`` for each of several folds on the rows of the others, or on all rows for one; the minibatches stay the same, their order changes.

    Returns the slots that any row has, for each fold how many of its rows have each, and its weights: (slots,), (folds, slots), (folds, slots, classes).
    """
    k = labels.shape[1]
    has = np.zeros(1 << bits, bool)
    has[rows.slots] = True
    seen = np.flatnonzero(has)
    local = np.cumsum(has) - 1
    owned = Rows(slots=local[rows.slots], n=rows.n)
    keep = (fold[:, None] != np.arange(folds)) | (folds == 1)
    times = np.stack([np.bincount(owned.slots, np.repeat(keep[:, f], rows.n), len(seen)) for f in range(folds)])
    rng = np.random.default_rng(seed)
    lots, place = [], np.zeros(len(seen), np.intp)
    for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
        slots, row = owned.take(at)
        by = np.sort(slots << 10 | row)  # fewer than 1024 rows
        first = np.flatnonzero(np.diff(by >> 10, prepend=-1))
        used = by[first] >> 10
        place[used] = np.arange(len(used))
        n = owned.n[at]
        lots.append((at, used, place[slots], np.cumsum(n) - n, by & 1023, first))
    w, g2 = np.zeros((len(seen), folds * k), np.float32), np.full((len(seen), folds * k), 1e-8, np.float32)
    y, own = labels.astype(np.float32), (keep * weight[:, None]).astype(np.float32)
    for _ in range(epochs if len(rows) else 0):
        for i in rng.permutation(len(lots)):
            at, used, slots, start, row, first = lots[i]
            now = w[used]
            z = np.add.reduceat(now.take(slots, 0), start, axis=0).reshape(len(at), folds, k)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at, None]) * own[at, :, None]
            g = np.add.reduceat(error.reshape(len(at), -1).take(row, 0), first, axis=0) + np.float32(l2) * now
            past = g2[used] + g * g
            g2[used] = past
            w[used] = now - np.float32(rate) * g / np.sqrt(past)
    return seen, times, w.reshape(len(seen), folds, k).transpose(1, 0, 2)
