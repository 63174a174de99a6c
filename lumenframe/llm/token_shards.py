"""Token-id shards in a Re-Pair grammar: encode, compress, write, random access, read back.

Documents are range-sorted by doc_id and a hash of the text. Each task encodes its texts, appends the end
id, cuts the stream into shards of about ``shard_tokens`` ids and compresses each: pairs of ids are replaced
by nonterminals until no pair stands twice, in rounds of falling frequency. A shard row holds the final
symbols, the rules (left, right), every rule's expansion length, and the documents' ids and offsets. The
lengths place every symbol, so a range of ids is decoded from the rules on its own paths and no others.
Numbers are stored as byte planes, as many as the largest needs, so neither ids nor rules have a bound.

Null texts count as empty and yield the end id only. Rows without a doc_id sort first. Repeated ids keep
one entry per row, ordered by text. A very long text makes one longer shard. Extra columns are not read,
whatever their names; an empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.textkit import bounded_batches, release, row_slices, text_buffers
from lumenframe.plans.staging import new_path

END_ID = 2
SHARD_TOKENS = 1 << 20
SLICE_BYTES = 2 << 20
#: Pieces whose ids a worker keeps, those met lately, of at most 8 * WORDS bytes each.
KNOWN, WORDS, SLOT_BITS = 1 << 19, 3, 21
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, before long, vocab long, doc_ids array<long>, starts binary, symbols binary, rules binary, lengths binary"
_BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Texts that may break elsewhere than at each lone space and line feed.
_ODD = f"{_BLANK}{_BLANK}|\\x00|^{_BLANK}"
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _breaks(data: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte: lone spaces, line feeds, and ASCII punctuation after a letter of ASCII or U+00C0 to U+00FF."""
    byte = np.uint8
    letter = (data | byte(0x20)) - byte(0x61) < 26
    punct = (data - byte(0x21) < 94) & ~letter & ~(data - byte(0x30) < 10)
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] - byte(0x80) < 64) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    out = (data == 0x20) | (data == 0x0A)
    out[1:] |= punct[1:] & letter[:-1]
    return out


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all runs, one after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(begins - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class Encoder:
    """Ids of whole texts. Pieces are encoded once while they are known, and new ones all in one string.

    A byte-level pre-tokenizer always breaks before a lone space or line feed, and between a letter and a
    punctuation mark, so the pieces between encode alike wherever they stand, and the ids of a string of pieces fall
    apart at their bytes. Texts with other white space than that or with a special token, and all texts of other
    kinds of tokenizer, are encoded one by one. A piece is known by all its bytes, as ``WORDS`` numbers; longer
    pieces are encoded whenever they come.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.vocab = tokenizer, tokenizer.get_vocab_size()
        kind = json.loads(tokenizer.to_str())
        pre, added = kind.get("pre_tokenizer") or {}, kind.get("added_tokens") or []
        self.fixed = [t["content"] for t in added]
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and kind.get("normalizer") is None
        self.pieces &= not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or len(t["content"].split()) != 1 for t in added)
        names = [tokenizer.id_to_token(i) or "" for i in range(self.vocab)]
        self.known, self.ids, self.at = np.zeros((1, WORDS), np.uint64), np.zeros(0, np.uint32), np.zeros(2, np.int64)  # none is all zeros
        self.slots, self.last, self.now = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1, np.int32), 0
        self.bytes = np.array([len(n.encode()) if n in self.fixed else len(n) for n in names], np.int64)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _hash(words: np.ndarray) -> np.ndarray:
        h = words[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, WORDS):
            h ^= h >> np.uint64(32)
            h += words[:, k]
            h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _forget(self) -> None:
        stay = np.append(0, 1 + np.sort(np.argsort(-self.last[1:], kind="stable")[: KNOWN // 2]))
        n = np.diff(self.at)[stay]
        self.ids, self.known, self.last = self.ids[_runs(self.at[stay], n)], self.known[stay], self.last[stay]
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.slots[:] = 0
        self.slots[self._slot(self._hash(self.known[1:]))] = np.arange(1, len(stay))

    def _find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each piece, ids, offsets of the places' ids) after learning new pieces; 8 * WORDS zeros follow the data."""
        self.now += 1
        if len(self.known) > KNOWN:
            self._forget()
        words, view = np.zeros((len(starts), WORDS), np.uint64), np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        words[:, 0] = view[starts] & _MASKS.take(np.minimum(sizes, 8))
        for k in range(1, WORDS):
            more = np.flatnonzero(sizes > 8 * k)
            words[more, k] = view[starts[more] + 8 * k] & _MASKS.take(np.minimum(sizes[more] - 8 * k, 8))
        h, long = self._hash(words), sizes > 8 * WORDS
        spot = self.slots.take(self._slot(h)).astype(np.int64)
        there, fresh = self.known.take(spot, axis=0), long.copy()
        for k in range(WORDS):
            fresh |= there[:, k] != words[:, k]
        self.last[spot] = self.now
        if not fresh.any():
            return spot, self.ids, self.at
        new = np.flatnonzero(fresh & ~long)
        new = new[np.argsort(h[new], kind="stable")]
        change = np.ones(len(new), bool)
        change[1:] = (words[new[1:]] != words[new[:-1]]).any(1)
        one, long = new[change], np.flatnonzero(long)  # long pieces follow, and aren't kept
        both = np.concatenate([one, long])
        ids, at = self._distinct(data, starts[both], sizes[both])
        spot[new], spot[long] = len(self.known) - 1 + np.cumsum(change), len(self.known) + len(one) + np.arange(len(long))
        ids, at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + at[1:]])
        self.slots[self._slot(h[one])] = len(self.known) + np.arange(len(one))
        self.known, self.last = np.concatenate([self.known, words[one]]), np.concatenate([self.last, np.full(len(one), self.now, np.int32)])
        self.at = at[: len(self.known) + 1]
        self.ids = ids[: self.at[-1]]
        return spot, ids, at

    def _distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces; those that don't open with a space or line feed get one that is dropped."""
        bare = (data[starts] != 0x20) & (data[starts] != 0x0A)
        led = sizes + bare
        stops = np.cumsum(led)
        joined = data[_runs(starts - bare, led)]
        joined[(stops - led)[bare]] = 0x0A
        edges, ids = [0, *stops[199:-1:200].tolist(), len(joined)], []
        for i in range(0, len(edges) - 1, 100):  # short strings keep the library's tables of places small
            part = edges[i : i + 101]
            ids += self.raw([joined[a:z].tobytes().decode() for a, z in zip(part[:-1], part[1:], strict=True)])
        ids = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        cut = np.concatenate([[0], np.searchsorted(ends, stops)])
        if not (ends[np.minimum(cut[1:], len(ends) - 1)] == stops).all():
            parts = self.raw([data[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        keep = np.ones(len(ids), bool)
        keep[cut[:-1][bare]] = False
        return ids[keep], np.concatenate([[0], np.cumsum(keep)])[cut]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids a text)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.pieces else np.ones(len(texts), bool)
        for token in self.fixed:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        counts, alone = np.zeros(len(texts), np.int64), self.raw(texts.filter(pa.array(odd)).to_pylist())
        counts[odd] = [len(x) for x in alone]
        plain = texts if not odd.any() else texts.filter(pa.array(~odd))
        flat, (data, offsets) = np.zeros(0, np.uint32), text_buffers(plain)
        n = int(offsets[-1] - offsets[0])
        if n:
            data, offsets = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(8 * WORDS, np.uint8)]), offsets - offsets[0]
            begins = _breaks(data)
            begins[offsets[:-1]] = True
            starts = np.flatnonzero(begins[:n])
            which, ids, at = self._find(data, starts, np.diff(np.append(starts, n)))
            sizes = np.diff(at)[which]
            flat = ids[_runs(at[which], sizes)]
            counts[~odd] = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)])
        if not alone:
            return flat, counts
        out, first = np.empty(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        hole = np.zeros(len(out), bool)
        for p, x in zip(first[odd].tolist(), alone, strict=True):
            out[p : p + len(x)] = x
            hole[p : p + len(x)] = True
        out[~hole] = flat
        return out, counts


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(path))


def _frequent(s: np.ndarray, may: np.ndarray, level: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, which pair stands there, the pairs in order) of those that stand ``level`` times or more among ``may``."""
    left, right = s.take(may).astype(np.uint64), s.take(may + 1).astype(np.uint64)
    wide, deep = np.uint64(symbols.bit_length()), np.uint64(len(may).bit_length())
    if 2 * wide + deep <= 64:  # pair and place in one number
        code = (left << wide) | right
        packed = np.sort((code << deep) | np.arange(len(may), dtype=np.uint64))
        code, order = packed >> deep, (packed & ((np.uint64(1) << deep) - np.uint64(1))).astype(np.int64)
    else:
        wide = np.uint64(32)
        code = (left << wide) | right
        order = np.argsort(code, kind="stable")
        code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(code)))
    often = n >= level
    which = np.full(len(may), -1, np.int32)
    which[order[np.repeat(often, n)]] = np.repeat(np.arange(int(often.sum()), dtype=np.int32), n[often])
    chosen = code[first[often]]
    hit = np.flatnonzero(which >= 0)
    return may[hit], which[hit], np.stack([chosen >> wide, chosen & ((np.uint64(1) << wide) - np.uint64(1))], 1).astype(np.uint32)


def _replace(s: np.ndarray, at: np.ndarray, which: np.ndarray, pairs: int, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``s`` with the pairs ``which`` at the places ``at`` replaced, left to right; which pairs became rules; places kept back."""
    hits, fresh = at, np.concatenate([[True], np.diff(at) != 1])
    index = np.arange(len(at))
    odd = (index - np.maximum.accumulate(np.where(fresh, index, 0))) & 1
    at, which = at[odd == 0], which[odd == 0]
    good = np.bincount(which, minlength=pairs) >= 2
    kept = good[which]
    at, which = at[kept], which[kept]
    out = s.copy()
    out[at] = (np.cumsum(good) - 1 + name)[which]
    stay = np.ones(len(s), bool)
    stay[at + 1] = False
    gone = np.zeros(len(s), bool)
    gone[at] = True
    kept = hits[stay[hits] & ~gone[hits]]
    return out[stay], good, kept - np.searchsorted(at, kept)


def _lower(level: int) -> int:
    return max(2, level >> (2 if level > 64 else 1))


def repair(ids: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): pairs are replaced, frequent ones first, until none stands twice.

    A round takes all pairs with at least ``level`` occurrences, and the level falls from round to round, to a
    quarter above 64 and to a half below, down to 2. There, rounds go on over the pairs that hold a symbol just made, as no other count can have
    risen, and over those that overlaps kept back, and over all pairs again until nothing is left. Rules are
    rows (left, right); rule i is symbol ``vocab + i``.
    """
    s, rules, sizes = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], np.ones(vocab, np.int64)
    level, made, everywhere = max(2, 1 << len(s).bit_length() >> 3), vocab, True
    while len(s) > 1:
        if everywhere:
            bits = min(20, max(min(16, len(s).bit_length()), (8 * len(s) // level).bit_length()))
            spot = s[:-1] * np.uint32(0x9E3779B1)
            spot += s[1:]
            spot *= np.uint32(0x85EBCA6B)
            spot >>= np.uint32(32 - bits)
            spot = spot.astype(np.int64)
            most = np.bincount(spot, minlength=1 << bits)  # no pair has more than its bucket
            while level > 2 and not (most >= level).any():
                level = _lower(level)
            may = np.flatnonzero((most >= level).take(spot))
        else:
            new = s >= made
            new[:-1] |= new[1:]
            new[left] = True
            may = np.flatnonzero(new[:-1])
        at, which, pairs = _frequent(s, may, level, len(sizes))
        shorter, good, left = _replace(s, at, which, len(pairs), len(sizes)) if len(pairs) else (s, np.zeros(0, bool), None)
        if good.any():
            rules.append(pairs[good])
            s, made = shorter, len(sizes)
            sizes = np.concatenate([sizes, sizes[pairs[good]].sum(1)])
            everywhere = level > 2
        elif level == 2 and everywhere:
            break
        else:
            everywhere = True
        level = _lower(level)
    return s, np.concatenate(rules), sizes[vocab:]


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, the lowest first: what is small takes few bytes, and zeros compress away."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    width = raw[0]
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.view("<u8").ravel().astype(np.int64)


class Grammar:
    """Random access to a shard: ``ids(start, stop)`` follows the rules only inside the range."""

    def __init__(self, symbols: bytes, rules: bytes, lengths: bytes, vocab: int):
        self.vocab, self.symbols, self.rules = vocab, from_planes(symbols), from_planes(rules).reshape(-1, 2)
        self.sizes = np.concatenate([np.ones(vocab, np.int64), from_planes(lengths)])
        self.ends = np.cumsum(self.sizes.take(self.symbols))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        total = int(self.ends[-1]) if len(self.ends) else 0
        start, stop = max(0, start), total if stop is None else min(stop, total)
        out = np.zeros(max(0, stop - start), np.uint32)
        if stop <= start:
            return out
        lo, hi = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, stop, "left")) + 1
        sym = self.symbols[lo:hi]
        at = self.ends[lo:hi] - self.sizes.take(sym) - start
        while len(sym):  # one level of all rules at once, each at its place
            leaf = sym < self.vocab
            out[at[leaf]] = sym[leaf]
            deep = np.flatnonzero(~leaf)
            pair = self.rules.take(sym.take(deep) - self.vocab, axis=0)
            place = np.empty(pair.shape, np.int64)
            place[:, 0] = at.take(deep)
            np.add(place[:, 0], self.sizes.take(pair[:, 0]), out=place[:, 1])
            sym, at = pair.ravel(), place.ravel()
            if len(out) < total:
                inside = (at < len(out)) & (at + self.sizes.take(sym) > 0)
                sym, at = sym[inside], at[inside]
        return out


def _packer(path: str, end_id: int, shard_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, before = load_encoder(path), TaskContext.get().partitionId(), 0, 0
        names, held, counts = [], [], []

        def shard(n_docs: int, ids: np.ndarray, doc_ids: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(sizes)])
            symbols, rules, lengths = repair(ids, coder.vocab)
            row = [[part], [seq], [n_docs], [len(ids)], [before], [coder.vocab], [doc_ids.to_pylist()], [planes(starts)], [planes(symbols)], [planes(rules.ravel())], [planes(lengths)]]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "seq", "n_docs", "n_tokens", "before", "vocab", "doc_ids", "starts", "symbols", "rules", "lengths"])

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Shards of what is held, each ended by the document that fills it; the rest stays held."""
            nonlocal names, held, counts, seq, before
            doc_ids, ids, sizes = pa.concat_arrays(names), np.concatenate(held), np.concatenate(counts)
            ends, at, first = np.cumsum(sizes), 0, 0
            while first < len(sizes):
                stop = int(np.searchsorted(ends, at + shard_tokens, "left")) + 1
                if stop > len(sizes) and not last:
                    break
                stop = min(stop, len(sizes))
                yield shard(stop - first, ids[at : ends[stop - 1]], doc_ids[first:stop], sizes[first:stop])
                before += int(ends[stop - 1]) - at
                first, at, seq = stop, int(ends[stop - 1]), seq + 1
            names, held, counts = [doc_ids[first:]], [ids[at:]], [sizes[first:]]

        for doc_ids, texts in _large_slices(batches):
            ids, n = coder.encode(texts)
            stops = np.cumsum(n) + np.arange(len(n))  # the end id's place after each text
            out, text = np.full(len(ids) + len(n), end_id, np.uint32), np.ones(len(ids) + len(n), bool)
            text[stops] = False
            out[text] = ids
            names.append(doc_ids)
            held.append(out)
            counts.append(n + 1)
            release()
            if sum(map(len, held)) >= shard_tokens:
                yield from cut(False)
        if names:
            yield from cut(True)

    return pack


def _large_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows of several batches together, about SLICE_BYTES of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = text_buffers(batch.column(1))
        for lo, hi in row_slices(offsets, SLICE_BYTES, 1 << 20):
            more = int(offsets[hi] - offsets[lo])
            if held and size + more > SLICE_BYTES:
                yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += more
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order, write the shards to ``path`` and return a scan of them."""
    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(_packer(tokenizer, end_id, shard_tokens), SHARD_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, vocab, doc_ids, starts, symbols, rules, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, at = Grammar(symbols, rules, lengths, vocab).ids().astype("<u4"), from_planes(starts)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode shards: (doc_id, start, n_tokens, ids_crc32) per document, start counted over all documents before it.

    A shard knows the ids before it in its part; the parts' sums, one row for each task that wrote, are summed
    in order and sent to all tasks, so shards aren't moved.
    """
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))
    rows = shards.join(F.broadcast(parts), "part")
    return rows.select((F.col("part_before") + F.col("before")).alias("before"), "vocab", "doc_ids", "starts", "symbols", "rules", "lengths").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_repair_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents as Re-Pair token shards, written and read back: offsets, lengths and checksums."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_shards(write_shards(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))
