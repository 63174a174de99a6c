"""Log-probabilities of texts by logistic context mixing, beside a unigram base.

Texts are lower-cased (A-Z) and read as bytes plus one end byte. A byte is spelt by the decisions of a
Huffman code, one for each class of byte before it, so a likely byte takes few of them. Hashed contexts (the last two,
four and six bytes, and the current word's prefix) hold the counts of both outcomes of each decision in
the training documents. A context's prediction is its counts' ratio, with the next shorter context's
prediction as prior counts; so each says most where it has seen most. The predictions are combined in
the logistic domain by weights gated by how often the two longest contexts were seen. Weights start from ``START`` and are
refined online over the whole text, after every ``FIRST_STEP`` decisions at first and in longer steps later, using
only what stands before. A score is a function of the counts and the text, the same on any cluster.

Counts come from all training documents: each task sums its (context, byte) pairs, and blocks of contexts
are summed over the tasks, in two levels where there are many. The slots of a context grow with its
distinct decisions, up to the model size 2^``MAX_BITS``; a slot holds the more frequent context, and check
bits tell others apart, which then count as unseen. The unigram base counts every token: the ``HEAD`` most
frequent words (a fixed bound) travel to the tasks, all others are joined, so no word is dropped.

Null texts count as empty: one end token. Null doc_ids count as training (their remainder is null).
Repeated rows are scored alike. A very long text is held whole by one task, with some forty bytes for each
of its decisions. Empty tables give no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textkit as K
from lumenframe.plans.staging import Staged, new_path

ORDERS = (2, 4, 6)
CONTEXTS = len(ORDERS) + 1
#: Prior counts that the next shorter context's prediction has; the weights that texts start from, of all contexts but the shortest.
PRIOR, START = (0.8, 1.0, 1.0, 1.0), (0.1, 0.3, 0.7)
LEAST_ODDS = 1e-5
RATE, FIRST_STEP, CELLS = 0.1, 64, 1 << 14
LEAST_BITS, MAX_BITS, BLOCKS, GROUP, CLASSES = 16, 22, 256, 64, 64
#: Bits of a number in a packed tally, beside 31 of a context, 6 of a class and 8 of a byte.
PACKED = 19

#: Bytes scored side by side, hashed at once and predicted at once; what hashes take stays near the processor and in memory that is held.
SLICE, PIECE, BLOCK = 1 << 18, 1 << 15, 1 << 13
END_BYTE = 0xFF
HEAD = 1 << 19
END_TOKEN = 0x0E4D
U32 = np.uint32


def byte_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of some texts, an end byte after each, and the new offsets."""
    at = (offsets - offsets[0]).astype(np.int64)
    low = K._LOWER[data[offsets[0] : offsets[-1]]]
    ends = at + np.arange(len(at))
    out = np.full(int(ends[-1]), END_BYTE, np.uint8)
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    out[keep] = low
    return out, ends


def spread(size: np.ndarray) -> np.ndarray:
    """The row that each of its ``size`` entries belongs to; no size is 0."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    out[ends[:-1]] = 1
    return np.cumsum(out, out=out)


class Code:
    """Huffman codes of a byte after each class of byte: the decisions (tree node, bit) that spell it.

    The ``CLASSES - 1`` most frequent bytes are a class each, all white space and a text's start count as
    the space, and all other bytes share class 0.
    """

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.int64)
        self.kind = np.zeros(256, np.uint8)
        often = np.argsort(-counts.sum(1), kind="stable")[: CLASSES - 1]
        self.kind[often] = np.arange(1, len(often) + 1)
        self.kind[K._SPACE] = self.kind[0x20]
        sums = np.zeros((CLASSES, 256), np.int64)
        np.add.at(sums, self.kind, counts)
        lists = [self._paths(row) for row in sums]
        self.size = np.array([len(path) for paths in lists for path in paths], np.int32)
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)
        node, bit = np.array([d for paths in lists for path in paths for d in path], np.int64).T
        self.bit, self.sign = bit.astype(U32), (1 - 2 * bit).astype(np.float32)
        self.node = (K.mix(node.astype(K.U) * K.BASE) >> K.U(41)).astype(U32)  # below the bits that name a block

    @staticmethod
    def _paths(counts: np.ndarray) -> list[tuple]:
        heap, inner = [(int(c) + 1, b) for b, c in enumerate(counts)], []
        heapq.heapify(heap)
        while len(heap) > 1:
            (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
            inner.append((a, b))
            heapq.heappush(heap, (x + y, 255 + len(inner)))
        paths, todo = {}, [(255 + len(inner), ())]
        while todo:
            at, path = todo.pop()
            if at < 256:
                paths[at] = path
            else:
                todo += [(child, (*path, (at, bit))) for bit, child in enumerate(inner[at - 256])]
        return [paths[b] for b in range(256)]

    def symbols(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class of the byte before, and the byte, as one number."""
        out = np.empty(len(b), np.int32)
        out[1:] = self.kind.take(b[:-1])
        out[at[:-1]] = self.kind[0x20]
        out <<= 8
        out |= b
        return out

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the code's lists of every decision, decisions of each byte)."""
        size = self.size.take(symbols)
        return self.places(symbols, size, spread(size)), size

    def places(self, symbols: np.ndarray, size: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = (self.first.take(symbols) - (np.cumsum(size, dtype=np.int64) - size)).take(row, mode="wrap")
        out += np.arange(len(out))
        return out


def context_hashes(b: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 31-bit hash for each byte and context, of what stands before the byte in its text."""
    n, heads = len(b), at[:-1]
    wide = b.astype(K.U)
    wide += K.U(1)
    two = np.zeros(n, K.U)  # nine bits a byte
    two[1:] = wide[:-1]
    two[2:] += wide[:-2] << K.U(9)
    past = two.copy()
    for shift in range(2, max(ORDERS), 2):
        past[shift:] += two[:-shift] << K.U(9 * shift)
    length = np.diff(at)
    for d in range(max(ORDERS)):  # nothing of the text before
        past[heads[length > d] + d] &= K.U((1 << 9 * d) - 1)
    opens = np.zeros(n + 1, bool)
    opens[1:] = K._SPACE.take(b)
    opens[heads] = True
    starts = np.flatnonzero(opens[:n])
    power, inverse = K.powers(n + 1)
    sums = np.zeros(n + 1, K.U)
    wide *= power[:n]
    np.cumsum(wide, out=sums[1:])
    run = np.diff(np.append(starts, n))
    word = sums[:n] - np.repeat(sums[starts], run)
    word *= np.repeat(inverse[starts], run)
    out = [K.mix((past & K.U((1 << 9 * order) - 1)) * K.BASE + K.U(order)) for order in ORDERS]
    return [(h >> K.U(33)).astype(U32) for h in (*out, K.mix(word))]


def _tally(keys: np.ndarray) -> np.ndarray:
    """Distinct keys with their numbers, packed, in order; a number of 2^PACKED or more takes several."""
    keys = np.sort(keys)
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return _packed(keys[cuts], np.diff(np.append(cuts, len(keys))))


def _packed(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    most = (1 << PACKED) - 1
    times = -(-n // most)
    if int(times.max(initial=1)) > 1:
        last = np.cumsum(times) - 1
        keys, out = np.repeat(keys, times), np.full(int(times.sum()), most, np.int64)
        out[last] = n - (times - 1) * most
        n = out
    return (keys << K.U(PACKED)) | n.astype(K.U)


def _sum(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their numbers) of packed tallies."""
    packed = np.sort(np.concatenate(parts))
    keys, n = packed >> K.U(PACKED), (packed & K.U((1 << PACKED) - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cuts], np.add.reduceat(n, cuts) if len(cuts) else n


class Tallies:
    """Packed tallies of a context, merged whenever they have doubled."""

    def __init__(self):
        self.parts, self.size, self.merged = [], 0, 1 << 20

    def add(self, packed: np.ndarray) -> None:
        self.parts.append(packed)
        self.size += len(packed)
        if self.size > 2 * self.merged:
            self.parts = [self.whole()]
            self.size = len(self.parts[0])
            self.merged = max(self.merged, self.size)

    def whole(self) -> np.ndarray:
        return _packed(*_sum(self.parts)) if self.parts else np.zeros(0, K.U)


def _counter(code: Code):
    """A task's numbers of (context, symbol) pairs, by blocks of contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Tallies() for _ in range(CONTEXTS)]
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for lo, hi in K.row_slices(offsets, 1 << 20):
                keys = [[] for _ in range(CONTEXTS)]
                for first, last in K.row_slices(offsets[lo : hi + 1], PIECE):
                    b, at = byte_stream(data, offsets[lo + first : lo + last + 1])
                    symbols = code.symbols(b, at).astype(K.U)
                    for kind, context in enumerate(context_hashes(b, at)):
                        keys[kind].append((context.astype(K.U) << K.U(14)) | symbols)
                for kind, one in enumerate(keys):
                    held[kind].add(_tally(np.concatenate(one)))
        group = TaskContext.get().partitionId() // GROUP
        for kind, one in enumerate(held):
            packed = one.whole()
            one.parts = []
            yield from _blocks(kind, group, packed)
        K.release()

    return count


COUNTS = "kind int, block int, grp int, packed binary"


def _blocks(kind: int, group: int, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
    edges = np.searchsorted(packed >> K.U(56), np.arange(BLOCKS + 1).astype(K.U))  # a context's first 8 bits
    for block, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if z > a:
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([packed[a:z].tobytes()], pa.binary())], ["kind", "block", "grp", "packed"])


def _each_block(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, Tallies]]:
    """(key, tallies) of rows whose first ``columns`` columns agree; they adjoin."""
    now, held = None, Tallies()
    for batch in batches:
        for key, raw in zip(zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True), batch.column(batch.num_columns - 1), strict=True):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, Tallies()
            held.add(np.frombuffer(raw.as_buffer(), K.U))
    if now is not None:
        yield now, held


def _sum_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (kind, block, group), held in _each_block(batches, 3):
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([held.whole().tobytes()], pa.binary())], ["kind", "block", "grp", "packed"])


#: Numbers that a byte stands for: 0 to 15, then eight steps an octave.
LEVELS = np.concatenate([np.arange(16), np.rint(16 * 2 ** (np.arange(240) / 8))]).astype(np.int64)


def _decide(code: Code):
    """One row a block: the hash of every (context, tree node) in order, and both outcomes' numbers as levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, block), held in _each_block(batches, 2):
            keys, n = _sum(held.parts)
            places, size = code.spell((keys & K.U((1 << 14) - 1)).astype(np.int32))
            h = (np.repeat((keys >> K.U(14)).astype(U32), size) ^ code.node[places]).astype(np.int64)
            side = (h << 1) | code.bit[places]
            order = np.argsort(side, kind="stable")
            side, n = side[order], np.repeat(n, size)[order]
            cuts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            side, n = side[cuts], np.add.reduceat(n, cuts)
            h, where = np.unique(side >> 1, return_inverse=True)
            both = np.zeros((2, len(h)), np.int64)
            both[side & 1, where] = n
            levels = (np.searchsorted(LEVELS, both, "right") - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([h.astype(U32).tobytes()], pa.binary()), pa.array([levels.tobytes()], pa.binary())], ["kind", "block", "size", "hashes", "levels"])

    return run


def _fill(bits: dict[int, int]):
    """A block's slots: check bits above two levels, those of the most frequent context of a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, block, hashes, levels in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h, (zero, one) = np.frombuffer(hashes, U32), np.frombuffer(levels, np.uint8).reshape(2, -1)
                order = np.argsort(LEVELS[zero] + LEVELS[one], kind="stable")
                out = np.zeros(1 << (bits[kind] - 8), U32)
                slot = (h >> U32(31 - bits[kind])) & U32(len(out) - 1)
                out[slot[order]] = (((h & U32(0xFFFF)) << U32(16)) | (one.astype(U32) << U32(8)) | zero)[order]
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["kind", "block", "slots"])

    return run


def learn(training: DataFrame, code: Code) -> Model:
    """The slot tables, at most 2^MAX_BITS slots a context, which reach the driver block by block."""
    blocks = training.select("text").mapInArrow(_counter(code), COUNTS)
    if blocks.rdd.getNumPartitions() > GROUP:  # in two levels: no block meets every task's sums
        key = ("kind", "block", "grp")
        blocks = blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sum_groups, COUNTS)
    key = ("kind", "block")
    summed = blocks.select("kind", "block", "packed").repartition(*key).sortWithinPartitions(*key).mapInArrow(_decide(code), "kind int, block int, size long, hashes binary, levels binary")
    staged = Staged(summed, "counts")
    bits = {k: 8 for k in range(CONTEXTS)} | {r["kind"]: min(MAX_BITS, max(LEAST_BITS, int(r["n"]).bit_length() + 1)) for r in staged.df.groupBy("kind").agg(F.sum("size").alias("n")).collect()}
    tables = [np.zeros(1 << bits[k], U32) for k in range(CONTEXTS)]
    for row in staged.df.select("kind", "block", "hashes", "levels").mapInArrow(_fill(bits), "kind int, block int, slots binary").toLocalIterator():
        slots = np.frombuffer(row["slots"], U32)
        tables[row["kind"]][row["block"] * len(slots) : (row["block"] + 1) * len(slots)] = slots
    staged.drop()
    return Model(code, tables)


class Model:
    """Slot tables of the contexts and the code; ``bits`` scores texts."""

    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables
        both = np.arange((1 << 16) + 1)
        both[-1] = 0  # one more entry, of a context that a slot doesn't hold
        zeros, ones = LEVELS[both & 255].astype(np.float32), LEVELS[both >> 8].astype(np.float32)
        total = zeros + ones
        self.seen = ((total > 0).astype(np.uint8) + (total > 3) + (total > 30)).astype(np.uint8)
        self.ones, self.zeros = ones, [zeros + np.float32(s) for s in PRIOR]  # with the prior's counts
        half = np.float32(PRIOR[0]) / 2
        odds = np.clip((ones + half) / (zeros + half), np.float32(LEAST_ODDS), np.float32(1 / LEAST_ODDS))
        self.shortest = odds / (odds + 1)

    def predict(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits against what came [contexts but the shortest, decisions], gate of each decision, decisions of each byte)."""
        symbols = self.code.symbols(b, at)
        size = self.code.size.take(symbols)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        m = int(ends[-1])
        z, gate = np.empty((CONTEXTS - 1, m), np.float32), np.zeros(m, np.uint8)
        for first, last in K.row_slices(at, PIECE):
            begin, stop = int(at[first]), int(at[last])
            contexts = context_hashes(b[begin:stop], at[first : last + 1] - begin)
            for lo in range(begin, stop, BLOCK):
                hi = min(lo + BLOCK, stop)
                where = slice(int(ends[lo]), int(ends[hi]))
                self._predict(symbols[lo:hi], size[lo:hi], [h[lo - begin : hi - begin] for h in contexts], z[:, where], gate[where])
        return z, gate, size

    def _predict(self, symbols: np.ndarray, size: np.ndarray, contexts: list[np.ndarray], z: np.ndarray, gate: np.ndarray) -> None:
        """All places are within their tables, so none is checked (mode wrap)."""
        row, p = spread(size), None
        places = self.code.places(symbols, size, row)
        node, sign = self.code.node.take(places, mode="wrap"), self.code.sign.take(places, mode="wrap")
        least, most = np.float32(LEAST_ODDS), np.float32(1 / LEAST_ODDS)
        for c, context in enumerate(contexts):
            table = self.tables[c]
            h = context.take(row, mode="wrap")
            h ^= node
            entry = table.take((h >> U32(32 - len(table).bit_length())).astype(np.int64), mode="wrap")
            h <<= U32(16)
            entry ^= h  # the counts alone, if the check bits agree
            np.minimum(entry, U32(1 << 16), out=entry)
            entry = entry.astype(np.int64)
            if c >= CONTEXTS - 2:
                gate *= np.uint8(4)
                gate += self.seen.take(entry, mode="wrap")
            if p is None:
                p = self.shortest.take(entry, mode="wrap")
                continue
            p *= np.float32(PRIOR[c])
            zero, one = self.zeros[c].take(entry, mode="wrap"), self.ones.take(entry, mode="wrap")
            one += p
            zero -= p
            one /= zero
            np.maximum(one, least, out=one)
            np.minimum(one, most, out=one)
            np.log(one, out=zero)
            np.multiply(zero, sign, out=z[c - 1])
            if c < CONTEXTS - 1:
                np.add(one, 1, out=p)
                np.divide(one, p, out=p)

    def bits(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text of a byte stream under the mixed predictors; texts advance side by side."""
        texts = len(at) - 1
        z, gate, size = self.predict(b, at)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[at]
        length = np.diff(ends)
        order = np.argsort(-length, kind="stable")
        begin, length = ends[:-1][order], length[order]
        gates = 16
        weights = [np.full(texts * gates, w, np.float32) for w in START]
        out, t, step = np.zeros(texts), 0, FIRST_STEP
        while texts and t < length[0]:
            live, wide = int(np.searchsorted(-length, -t, "left")), max(1, CELLS // step)
            for lo in range(0, live, wide):
                hi = min(live, lo + wide)
                n = np.minimum(length[lo:hi] - t, step)
                first = np.cumsum(n) - n
                spot = np.repeat(begin[lo:hi] + t - first, n)
                spot += np.arange(len(spot))
                cell = np.repeat(np.arange(hi - lo) * gates, n)
                cell += gate.take(spot, mode="wrap")
                zs, ws = [row.take(spot, mode="wrap") for row in z], [w[lo * gates : hi * gates] for w in weights]
                mixed = ws[0].take(cell, mode="wrap")
                mixed *= zs[0]
                for c in range(1, CONTEXTS - 1):
                    more = ws[c].take(cell, mode="wrap")
                    more *= zs[c]
                    mixed += more
                np.maximum(mixed, -14, out=mixed)
                np.minimum(mixed, 14, out=mixed)
                np.exp(mixed, out=mixed)
                odds = mixed + 1
                out[lo:hi] += np.add.reduceat(np.log(odds), first, dtype=np.float64)
                mixed /= odds
                for c in range(CONTEXTS - 1):
                    zs[c] *= mixed
                    ws[c] -= (np.bincount(cell, weights=zs[c], minlength=len(ws[c])) * (RATE / step**0.5)).astype(np.float32)
            t += step
            if t >= 32 * step:
                step *= 2
        total = np.zeros(texts)
        total[order] = out / np.log(2)
        return total


class Head:
    """Open-addressed table of the most frequent words: hash -> count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.bits = max(4, int(len(keys) * 2 + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.reach, left = 0, np.arange(len(keys))
        while len(left):
            spot = (self._home(keys[left]) + self.reach) & (size - 1)
            free = self.counts[spot] == 0
            _, firsts = np.unique(spot[free], return_index=True)
            take = np.flatnonzero(free)[firsts]
            self.keys[spot[take]], self.counts[spot[take]] = keys[left[take]], counts[left[take]]
            left = np.delete(left, take)
            self.reach += 1

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts, 0 where a word isn't of the head."""
        spot, out = self._home(h), np.zeros(len(h), np.int64)
        hit = self.keys[spot] == h
        out[hit] = self.counts[spot[hit]]
        left = np.flatnonzero(~hit & (self.counts[spot] > 0))
        for i in range(1, self.reach):
            if not len(left):
                break
            at = (spot[left] + i) & (len(self.keys) - 1)
            hit = self.keys[at] == h[left]
            out[left[hit]] = self.counts[at[hit]]
            left = left[~hit & (self.counts[at] > 0)]
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(two bytes or not, the bytes or a word's hash, count) summed over slices of a task; the end token is one more word."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(0))
        for lo, hi in K.row_slices(offsets, 2 << 20):
            found = []
            for first, last in K.row_slices(offsets[lo : hi + 1], PIECE):
                found.append(K.Words(data, offsets[lo + first : lo + last + 1]).hash)
                b, at = byte_stream(data, offsets[lo + first : lo + last + 1])
                before = np.full(len(b), 0x20, np.int64)
                before[1:] = b[:-1]
                before[at[:-1]] = 0x20
                total += np.bincount((before << 8) | b, minlength=1 << 16)
            words, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words) + 1, bool)), pa.array(np.append(words, K.U(END_TOKEN)).view(np.int64)), pa.array(np.append(counts, hi - lo).astype(np.int64))], ["is_byte", "word", "c"])
    pairs = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(pairs), bool)), pa.array(pairs), pa.array(total[pairs])], ["is_byte", "word", "c"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().tobytes()], pa.binary()) for k in (0, 1)], ["word", "c"])


def _head(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the end token and of all words above the least count that leaves at most HEAD."""
    held, least = 0, 1
    for row in sorted(words.groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["c"]):
        least = row["c"] + 1 if held + row["n"] > HEAD else row["c"]
        held += row["n"]
        if held > HEAD:
            break
    packed = words.where((F.col("c") >= least) | (F.col("word") == END_TOKEN)).mapInArrow(_pack, "word binary, c binary").collect()
    keys, counts = (np.frombuffer(b"".join(bytes(r[k]) for r in packed), np.int64) for k in ("word", "c"))
    return keys.view(np.uint64), counts


def _scorer(model, base: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed, head = model.value
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.row_slices(offsets, SLICE):
                n, pieces = hi - lo, [K.Words(data, offsets[lo + a : lo + z + 1]) for a, z in K.row_slices(offsets[lo : hi + 1], PIECE)]
                words, per = (np.concatenate([getattr(w, x) for w in pieces]) for x in ("hash", "counts"))
                doc = np.repeat(np.arange(n), per)
                c = head.find(words)
                known, end = np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64), head.find(np.array([END_TOKEN], K.U))
                sums = np.bincount(doc, weights=np.log10(c + 1.0), minlength=n) + np.log10(end[0] + 1.0)
                b, at = byte_stream(data, offsets[lo : hi + 1])
                bits = mixed.bits(b, at)
                rare = c == 0
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.array(words[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(per.astype(np.int64) + 1), pa.array(known + (end[0] > 0)), pa.array(sums - (per + 1) * base), pa.array(bits), pa.array(np.diff(at)), tail],
                    ["row", "key", "n_tokens", "known", "base", "bits", "n_bytes", "tail"],
                )

    return score


def score_texts(docs: DataFrame, training: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``training`` is a SQL predicate on doc_id for the rows to learn from.
    """
    K.bounded_batches(docs)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = docs.where(f"coalesce({training}, true)")
    found = Staged(known.select("text").mapInArrow(_count_words, "is_byte boolean, word long, c long").groupBy("is_byte", "word").agg(F.sum("c").alias("c")), "words").df
    pairs = np.zeros(1 << 16, np.int64)
    for r in found.where("is_byte").collect():
        pairs[r["word"]] = r["c"]
    code = Code(pairs.reshape(256, 256))
    words = found.where("not is_byte").drop("is_byte")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    keys, counts = _head(words)
    model = spark.sparkContext.broadcast((learn(known, code), Head(keys, counts)))
    base = float(np.log10(total["n"] + total["v"] + 1))

    kind = "row long, key long, n_tokens long, known long, base double, bits double, n_bytes long, tail array<long>"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    path = new_path(spark, "scored")
    ids.mapInArrow(_scorer(model, base), kind).write.parquet(path)
    scored = spark.read.schema(kind).parquet(path)
    out = scored.select(F.col("row").alias("doc_id"), "key", "n_tokens", F.col("known").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), "base", "bits", "n_bytes")
    if total["v"] > len(keys):
        tail = scored.where(F.size("tail") > 0).select("key", F.explode("tail").alias("word")).groupBy("key", "word").agg(F.count("*").alias("k"))
        extra = tail.join(words, "word").groupBy("key").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("gain"))
        copies = scored.groupBy("key").agg(F.count("*").alias("copies"))  # equal rows share a key, and their words were counted together
        each = extra.join(copies, "key").select("key", (F.col("more") / F.col("copies")).cast("long").alias("more"), (F.col("gain") / F.col("copies")).alias("gain"))
        out = out.join(each, "key", "left")
        out = out.withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("gain", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), (F.col("bits") * float(-np.log10(2))).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def op2_context_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from those whose crc32 remainder by 7 isn't 2."""
    rest = "crc32(cast(doc_id as string)) % 7"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.expr(f"{rest} = 2"), F.lit(False))
    return score_texts(docs, f"{rest} <> 2").select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
