"""Exact nearest neighbours of many queries: what could be near is told by matrix products, and measured as SQL does.

Chunks are read in the order that ties are broken by, so that a later one never takes the place of an equal one. Each task keeps
the k best of each query, whatever number of chunks it reads."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 9
#: Pairs that are looked at together, which bounds a worker's memory.
PAIRS = 1 << 20
ROWS = 2048
#: Ranks behind all numbers, as NaN does, and before none.
MISSING = 2


def matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors as rows, their lengths (-1: missing, or with a missing number), and which have only finite numbers. Short ones are filled up with zeros."""
    flat = vectors.flatten().cast(pa.float64())
    size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), dtype=np.int64)
    ends = np.cumsum(size)
    values = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
    lost = np.asarray(pc.is_null(flat), dtype=bool)
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        out = values.reshape(len(size), width)
        gone = lost.reshape(len(size), width).any(axis=1) if lost.any() else np.zeros(len(size), bool)
    else:
        out = np.zeros((len(size), width))
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(values)) - np.repeat(ends - size, size)] = values
        gone = np.bincount(row[lost], minlength=len(size)) > 0
    length = np.where(gone | np.asarray(pc.is_null(vectors), dtype=bool), -1, size)
    return out, length, np.isfinite(out).all(axis=1)


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.hstack([m, np.zeros((len(m), width - m.shape[1]))])


def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of columns of a and b, summed from the first dimension to the last, as a fold does."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        d = x - y
        total += d * d
    return np.sqrt(total)


def rounded(d: np.ndarray) -> np.ndarray:
    """As SQL rounds to DIGITS: halves of the shortest decimal form go up."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = d * 10.0**DIGITS
        out = np.floor(scaled + 0.5) / 10.0**DIGITS
        near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    for i in np.flatnonzero(np.isfinite(d) & (near | (d > 1e4))):
        out[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) if d[i] < 1e15 else d[i]
    out[~np.isfinite(d)] = d[~np.isfinite(d)]
    return out


class Best:
    """The k best rows of each query so far, in order, by kind and key; of equal ones the first seen."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.kind = np.full((n, k), MISSING + 1, np.int8)  # 0: a number, 1: NaN, MISSING, beyond: no row
        self.key = np.full((n, k), np.inf)
        self.d = np.full((n, k), np.nan)
        self.row = np.full((n, k), -1, np.int64)
        self.seen = 0
        self.kept, self.keys = np.zeros(0, np.int64), None

    rounded = staticmethod(rounded)

    def merge(self, i: np.ndarray, j: np.ndarray, kind: np.ndarray, key: np.ndarray, d: np.ndarray) -> None:
        """Row j of those that come after the seen ones is of this key for query i."""
        last_kind, last = self.kind[i, -1], self.key[i, -1]
        better = (kind < last_kind) | ((kind == last_kind) & (key < last))
        i, j, d, kind, key = i[better], j[better], d[better], kind[better], key[better]
        if not len(i):
            return
        at, k = np.unique(i), self.k
        who = np.concatenate([np.repeat(at, k), i])
        kinds, keys = np.concatenate([self.kind[at].ravel(), kind]), np.concatenate([self.key[at].ravel(), key])
        ds, rows = np.concatenate([self.d[at].ravel(), d]), np.concatenate([self.row[at].ravel(), self.seen + j])
        order = np.lexsort((rows, keys, kinds, who))
        begins = np.searchsorted(who[order], at)
        take = order[(begins[:, None] + np.arange(k)).ravel()]
        self.kind[at], self.key[at] = kinds[take].reshape(-1, k), keys[take].reshape(-1, k)
        self.d[at], self.row[at] = ds[take].reshape(-1, k), rows[take].reshape(-1, k)

    def end(self, part: pa.RecordBatch) -> None:
        """The rows of part are seen: the keys of those that are among the best of any query are kept."""
        new = np.unique(self.row[self.row >= self.seen])
        keys = pa.Table.from_batches([part.select(["note_path", "ordinal"])]).take(pa.array(new - self.seen))
        self.seen += part.num_rows
        self.kept, self.keys = np.concatenate([self.kept, new]), keys if self.keys is None else pa.concat_tables([self.keys, keys])
        if len(self.kept) > 2 * self.row.size + ROWS:
            stay = np.isin(self.kept, self.row)
            self.kept, self.keys = self.kept[stay], self.keys.filter(pa.array(stay)).combine_chunks()

    def rows(self, ids: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        of, place = np.nonzero(self.row >= 0)
        for a in range(0, len(of), 1 << 17):
            q, p = of[a : a + (1 << 17)], place[a : a + (1 << 17)]
            keys = self.keys.take(pa.array(np.searchsorted(self.kept, self.row[q, p]))).combine_chunks()
            d = pa.array(self.d[q, p], mask=self.kind[q, p] == MISSING)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *(c.chunk(0) for c in keys.columns), d], ["query_id", "note_path", "ordinal", name])


class Nearest(Best):
    """The k nearest rows of each query so far."""

    def __init__(self, vectors: pa.ListArray, k: int) -> None:
        super().__init__(len(vectors), k)
        self.q, self.length, self.plain = matrix(vectors)

    def add(self, vectors: pa.ListArray) -> None:
        c, length, plain = matrix(vectors)
        width = max(c.shape[1], self.q.shape[1])
        c, self.q = widened(c, width), widened(self.q, width)
        with np.errstate(over="ignore", invalid="ignore"):
            square = (c * c).sum(axis=1)
        alike = len(length) > 0 and (length == length[0]).all() and plain.all() and length[0] >= 0
        for a in range(0, len(self.q), block := max(1, PAIRS // max(1, len(c)))):
            q = self.q[a : a + block]
            fine = self.plain[a : a + block] & (self.length[a : a + block] == length[0]) if alike else np.zeros(len(q), bool)
            full = self.kind[a : a + block, -1] == 0
            with np.errstate(all="ignore"):
                own = (q * q).sum(axis=1)
                near = own[:, None] + square[None, :] - 2.0 * (q @ c.T)
                # what sums and products may be off by, with a margin; what rounds to the last one kept can't be less than half a digit nearer
                slack = (width + 8) * 1e-15 * (own[:, None] + square.max(initial=0.0))
                bound = (self.key[a : a + block, -1] + 1e-8)[:, None]
                limit = bound * bound * (1 + 1e-12) + slack
                if fine.any() and not full.all() and near.shape[1] > self.k:
                    least = np.partition(near, self.k - 1, axis=1)[:, self.k - 1][:, None]
                    first = (np.sqrt(np.maximum(least + slack, 0.0)) + 1e-8) ** 2 * (1 + 1e-12) + slack
                    limit = np.minimum(np.where(full[:, None], limit, np.inf), first)
                keep = ~fine[:, None] | ~np.isfinite(limit) | ~(near > limit)
            i, j = np.nonzero(keep)
            self.measure(a, i, j, c, length, q)

    def measure(self, a: int, i: np.ndarray, j: np.ndarray, c: np.ndarray, length: np.ndarray, q: np.ndarray) -> None:
        if not len(i):
            return
        with np.errstate(all="ignore"):
            d = measured(np.ascontiguousarray(q.T)[:, i], np.ascontiguousarray(c.T)[:, j])
        same = (length[j] == self.length[a + i]) & (length[j] >= 0)
        kind = np.where(same, np.isnan(d), MISSING).astype(np.int8)
        self.merge(a + i, j, kind, np.where(kind == 0, rounded(d), 0.0), d)


def search(queries: Callable[[], pa.Table], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (note_path, ordinal, embedding), sorted by the first two: query_id, note_path, ordinal and d of the k nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries().combine_chunks()
        if not asked.num_rows:
            return
        ids, vectors = (asked.column(c).chunk(0) for c in ("query_id", "vector"))
        state = Nearest(vectors, k)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                state.add(part.column("embedding"))
                state.end(part)
        if state.seen:
            yield from state.rows(ids, "d")

    return run
