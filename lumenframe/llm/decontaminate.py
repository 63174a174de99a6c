"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes of at most u = 1, 2, 4, 8, ... Documents
are read as windows of 2u shingles, u apart, one set of windows a class, so an item that stands in a
document lies inside some window no more than about four times its size, and its containment bounds
the Jaccard similarity with that window from below. One equal MinHash value of ``HASHES`` makes a
candidate, and a candidate is verified by the exact containment of the item's distinct shingles in the
whole document. Items are searched in blocks of bounded size against all documents, without a shuffle; of
several blocks, one index is held at a time, and a block's pairs are written before the next.

An item with null or empty text matches nothing. An item of fewer than five words is one shingle, its
whole sequence, and matches only documents that are just that. Null or empty documents match nothing.
Repeated documents and items give a row for each, null ids included. A very long document is held whole by one
task, with its shingles. Empty tables of documents or items give no rows. Extra columns aren't read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textkit as K
from lumenframe.plans.staging import Staged

HASHES = 64
THRESHOLD = 0.8
BLOCK_ITEMS, BLOCK_BYTES = 32_768, 32 << 20
PAIR_SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long"
_MULTS = K.seeds(HASHES, 0xC0DE)
_TAGS = K.seeds(HASHES, 0xC0DF)


class ItemIndex:
    """A block of items: their sets, and their MinHash values by size class."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int):
        self.ids, self.sets = [], []
        for lo, _, _, sh in K.shingled(pa.array(texts, pa.string()), width):
            for i, s in enumerate(sh.sets(), lo):
                if len(s):
                    self.ids.append(ids[i])
                    self.sets.append(s)
        sizes = np.array([len(s) for s in self.sets], np.int64)
        level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        self.classes = []
        for c in sorted(set(level.tolist())):
            items = np.flatnonzero(level == c)
            keys = np.concatenate([K.mix(np.array([(self.sets[i] * a).min() for i in items], K.U) ^ t) for a, t in zip(_MULTS, _TAGS, strict=True)])
            order = np.argsort(keys, kind="stable")
            bits = min(26, max(12, int(16 * len(keys)).bit_length()))
            gate = np.zeros(1 << bits, bool)
            gate[(keys >> K.U(64 - bits)).astype(np.int64)] = True
            self.classes.append((1 << c, keys[order], np.tile(items, HASHES)[order], K.U(64 - bits), gate))

    def candidates(self, sh: K.Shingles) -> np.ndarray:
        """Pairs (row, item) of which some window shares a MinHash value, distinct."""
        found = [np.zeros((0, 2), np.int64)]
        sizes = np.diff(sh.first)
        if not self.classes or not len(sh.hash):
            return found[0]
        buf, unit = np.empty_like(sh.hash), self.classes[0][0]
        grids = {}
        for u, *_ in self.classes:
            blocks = -(-sizes // u)
            grids[u] = blocks, np.repeat(np.arange(len(sizes)), blocks)
        blocks, rows = grids[unit]
        first = sh.first[:-1][rows] + unit * (np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        for a, tag in zip(_MULTS, _TAGS, strict=True):
            np.multiply(sh.hash, a, out=buf)
            low, u_now = np.minimum.reduceat(buf, first), unit
            for u, keys, items, shift, gate in self.classes:
                while u_now < u:
                    low, u_now = self._halve(low, -(-sizes // u_now)), u_now * 2
                row = grids[u][1]
                window = low.copy()
                same = row[:-1] == row[1:]
                window[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                key = K.mix(window ^ tag)
                at = np.flatnonzero(gate[(key >> shift).astype(np.int64)])
                left, right = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
                n = right - left
                if n.any():
                    item = items[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    found.append(np.unique(np.stack([np.repeat(row[at], n), item], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    @staticmethod
    def _halve(low: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Minima of pairs of blocks, row by row."""
        ahead = np.cumsum(blocks) - blocks
        place = np.arange(len(low)) - np.repeat(ahead, blocks)
        return np.minimum.reduceat(low, np.flatnonzero(place % 2 == 0))


def _finder(index, percent: int, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            for lo, hi, _, sh in K.shingled(batch.column(1), width):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                now, whole, out = -1, None, []
                for row, i in items.candidates(sh).tolist():
                    if row != now:
                        now, whole = row, np.unique(sh.hash[sh.first[row] : sh.first[row + 1]])
                    s = items.sets[i]
                    at = np.searchsorted(whole, s)
                    at[at == len(whole)] = 0
                    hits = int((whole[at] == s).sum())
                    if 100 * hits >= percent * len(s):
                        out.append((ids[row], items.ids[i], len(s), hits))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "n_shingles", "n_found"])

    return find


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): items whose containment reaches the threshold."""
    K.bounded_batches(docs)
    spark, percent = docs.sparkSession, round(threshold * 100)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = 1 + max(size["n"] // BLOCK_ITEMS, size["b"] // BLOCK_BYTES)
    texts, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], width))
        part = texts.mapInArrow(_finder(index, percent, width), PAIR_SCHEMA)
        if blocks > 1:
            part = Staged(part, "contained").df
            index.destroy()
        found = part if found is None else found.union(part)
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they contain, at four fifths of the item's shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, n.n_shingles, count(*) AS n_found, count(*) / n.n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY ds.doc_id, bs.item_id, n.n_shingles HAVING 100 * count(*) >= 80 * n.n_shingles
"""
