"""Vectorised words, word hashes, shingles and MinHash over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased and nothing
else changed. All hashes are pure functions of the bytes, alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, BASE_INV)):
            steps = np.full(max(n, SLICE_BYTES + 1), b, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers, made by rule from a salt."""
    return mix(np.arange(1, n + 1, dtype=U) * BASE + U(salt)) | U(1)


def bounded_batches(df) -> None:
    """Arrow batches of 1,000 texts where the session has Spark's default of 10,000, which long texts make large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, "1000")


def release() -> None:
    """Give the Arrow pool's free memory back: a worker that lives on must not keep its largest batch."""
    pa.default_memory_pool().release_unused()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    release()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows; a longer text stands alone, whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of some texts: starts, ends (bytes), hash, doc (row of each word), first (per row, n+1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        at = (offsets - offsets[0]).astype(np.int64)
        self.data = low = _LOWER[data[offsets[0] : offsets[-1]]]
        n = len(low)
        solid = ~_SPACE[low]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edge = at[(at > 0) & (at < n)]
        begins[edge] = solid[edge]
        stops[edge - 1] = solid[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        pow_, inv = powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum((low.astype(U) + U(1)) * pow_[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inv[self.starts]
        self.hash = mix(h + (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93))


class Shingles:
    """Hashes of all runs of ``width`` words, by row; rows of fewer words give their whole sequence."""

    def __init__(self, words: Words, width: int = 5):
        w, counts = words.hash, words.counts
        sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        out, short = np.empty(self.first[-1], U), np.flatnonzero((counts > 0) & (counts < width))
        if len(w) >= width:
            m = len(w) - width + 1
            run = np.zeros(m, U)
            for j in range(width):
                run *= BASE
                run += w[j : j + m]
            doc = np.repeat(np.arange(len(counts)), counts)
            run = run[doc[:m] == doc[width - 1 :]]
        else:
            run = np.zeros(0, U)
        long_ = np.ones(len(out), bool)
        long_[self.first[short]] = False
        out[long_] = mix(run)
        for d in short:
            x = int(counts[d])
            for v in w[words.first[d] : words.first[d + 1]].tolist():
                x = (x * int(BASE) + v) % (1 << 64)
            out[self.first[d]] = mix(np.array([x], U))[0]
        self.hash = out

    def sets(self) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each row."""
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            yield np.unique(self.hash[a:b])

    def minima(self, mults: np.ndarray) -> np.ndarray:
        """MinHash values, uint32 [rows, hashes]; rows without shingles hold the largest value."""
        full = np.flatnonzero(np.diff(self.first))
        out = np.full((len(self.first) - 1, len(mults)), 0xFFFFFFFF, np.uint32)
        if len(full):
            at, buf = self.first[full], np.empty_like(self.hash)
            for k, a in enumerate(mults):
                np.multiply(self.hash, a, out=buf)
                out[full, k] = np.minimum.reduceat(buf, at) >> U(32)
        return out


def shingled(column: pa.Array, width: int = 5) -> Iterator[tuple[int, int, Words, Shingles]]:
    """(row from, row to, words, shingles) over bounded slices of a column."""
    data, offsets = text_buffers(column)
    for lo, hi in row_slices(offsets):
        words = Words(data, offsets[lo : hi + 1])
        yield lo, hi, words, Shingles(words, width)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, starts of groups) of whole groups, about ``rows`` rows at once or one longer group.

    Groups adjoin: their rows agree in the first ``keys`` columns, which are numbers.
    """

    def starts(part: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(part.num_rows, bool)
        change[:1] = True
        for k in range(keys):
            v = part.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = starts(whole)
        held = [whole.slice(int(at[-1]))]
        if len(at) > 1:
            yield whole.slice(0, int(at[-1])), at[:-1]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole, starts(whole)
