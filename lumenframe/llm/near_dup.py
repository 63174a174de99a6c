"""MinHash near-duplicate groups by an LSH forest with exact confirmation.

Every text gets ``trees`` labels of ``LABEL`` MinHash values. Each tree sorts all labels, so texts with long
common prefixes adjoin; runs that share ``depth`` values are its regions, and the depth follows from the
threshold so that a pair at the threshold misses all trees with probability below ``miss``. In the sorted
order a text meets the neighbour with which it has the longest common prefix, and the most central text of
its region and of its inner region: the shallowest run around it of at most ``CROWD`` texts, so depth adapts
to how crowded a region is. Links are confirmed on full shingle sets. What is then still apart within a
region is compared in blocks, after filters on set size and 1-bit MinHash, and confirmed pair by pair. So
the order only decides what is met first: no neighbour, region or bucket is capped.

Null or empty texts have an empty shingle set and link with nothing. Equal shingle sets are one class
from the start (ties and repeated rows included), so exact copies never meet pairwise. Rows without a
doc_id keep a null component and are not kept. A very long text is held whole by one task, with its set. An
empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textkit as K
from lumenframe.operators.graph import connected_components
from lumenframe.plans.staging import Staged

TREES = 24
#: MinHash values in a label, the texts that an inner region may hold, and the texts of a block of a large region.
LABEL, CROWD, BLOCK = 8, 32, 1024
SALT = 0x5EED
#: Bits of 1-bit MinHash kept for the native filters (the first two words of them beside every label),
#: and the standard deviations below the threshold that a filter lets pass.
BITS, SIGMAS = 1024, 4.5
WORDS = BITS // 64
BIT_COLUMNS = [f"b{k}" for k in range(WORDS)]
#: Most bits of the table that tells which texts may be needed; beyond it more texts are read, none fewer.
SIEVE_BITS = 1 << 27


def forest_depth(threshold: float, trees: int = TREES, miss: float = 1e-5) -> int:
    """The largest prefix depth at which a pair at the threshold shares a region but for ``miss``."""
    depth = 1
    while (1 - threshold ** (depth + 1)) ** trees <= miss:
        depth += 1
    return depth


def _signer(width: int, trees: int, depth: int):
    used = trees * LABEL
    mults = K.seeds(max(used, BITS), SALT)
    salts = K.seeds(trees, SALT + 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, _, sh in K.shingled(batch.column(1), width):
                sig = sh.minima(mults)
                n = hi - lo
                lab = sig[:, :used].reshape(n, trees, LABEL)
                region = np.broadcast_to(salts, (n, trees)).copy()
                for d in range(depth):
                    region = K.mix(region * K.BASE + lab[:, :, d].astype(np.uint64))
                label = (lab >> np.uint32(16)).astype(">u2").view(">i8").astype(np.int64)  # eight values of 16 bits: two numbers
                bits = np.packbits((sig[:, :BITS] & 1).astype(np.uint8), axis=1).view(np.int64)
                sets = list(sh.sets())
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(k.ravel()), trees).cast(pa.list_(pa.int64())) for k in (region.view(np.int64), np.ascontiguousarray(label[:, :, 0]), np.ascontiguousarray(label[:, :, 1]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.arange(row, row + n)), pa.array(sizes), pa.array(digests, pa.binary()), *lists, *(pa.array(bits[:, k].copy()) for k in range(WORDS))],
                    ["doc_id", "row", "n", "digest", "region", "high", "low", *BIT_COLUMNS],
                )
                row += n

    return sign


ORDERED = "region long, inner long, id long, n long, b0 long, b1 long, mate long, common int"


def _common(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Leading values that each label shares with the one before it."""
    parts = np.stack([high, low], 1).astype(">i8").view(">u2").reshape(-1, LABEL)
    same = np.zeros(parts.shape, bool)
    same[1:] = parts[1:] == parts[:-1]
    return np.logical_and.accumulate(same, 1).sum(1)


def _neighbours(depth: int, percent: int):
    """Rows of a tree's sorted order, but for those alone in their region: inner region and nearest neighbour."""
    most = _most_apart(percent, 2)

    def meet(rows: pa.RecordBatch, first: bool, last: bool) -> pa.RecordBatch:
        region, tree, high, low, ids, n, b0, b1 = (c.to_numpy() for c in rows.columns)
        m = len(ids)
        near = _common(high, low)
        near[1:][tree[1:] != tree[:-1]] = 0
        near[1:] *= region[1:] == region[:-1]
        after = np.append(near[1:], 0)
        depth_of, key = np.full(m, LABEL), np.zeros(m, np.int64)
        for d in range(LABEL, depth - 1, -1):
            run = np.cumsum(near < d)
            fits = np.bincount(run)[run] <= CROWD
            depth_of[fits] = d
        parts = np.stack([high, low], 1).astype(">i8").view(">u2").reshape(-1, LABEL).astype(np.uint64)
        mixed = region.view(np.uint64) + depth_of.astype(np.uint64)
        for d in range(depth, LABEL):
            deeper = depth_of > d
            mixed[deeper] = K.mix(mixed[deeper] * K.BASE + parts[deeper, d])
        key = mixed.view(np.int64)
        mate, common = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for there, shared in ((np.arange(m) - 1, near), (np.minimum(np.arange(m) + 1, m - 1), after)):
            apart = np.bitwise_count((b0 ^ b0[there]).view(np.uint64)) + np.bitwise_count((b1 ^ b1[there]).view(np.uint64))
            fit = (shared >= depth) & (shared > common) & (apart <= most) & (np.minimum(n, n[there]) * 100 >= np.maximum(n, n[there]) * percent)
            mate[fit], common[fit] = ids[there][fit], shared[fit]
        alone = (near < depth) & (after < depth)
        if first:  # it may go on from the partition before
            alone &= region != region[0]
        if last:
            alone &= region != region[-1]
        keep = pa.array(~alone)
        out = [pa.array(x) for x in (region, key, ids, n, b0, b1)] + [pa.array(mate, mask=common == 0), pa.array(common.astype(np.int32))]
        return pa.RecordBatch.from_arrays(out, ["region", "inner", "id", "n", "b0", "b1", "mate", "common"]).filter(keep)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            region = rows.column(0).to_numpy()
            cut = int(np.flatnonzero(region != region[-1])[-1]) + 1 if (region != region[-1]).any() else 0
            if not cut and rows.num_rows < 1 << 16:  # one region so far
                held = rows
                continue
            cut = cut or rows.num_rows  # a longer run is met in parts
            yield meet(rows.slice(0, cut), first, cut == rows.num_rows)
            first, held = cut == rows.num_rows, rows.slice(cut) if cut < rows.num_rows else None
        if held is not None:
            yield meet(held, first, True)

    return walk


def _sieve(ids: DataFrame):
    """A broadcast bit table of bounded size over hashed ids: what it denies is in none of them."""
    n = ids.count()
    bits = 1 << min(max(10, (16 * n).bit_length()), SIEVE_BITS.bit_length() - 1)
    spot = _spot(bits).alias("spot")
    words = ids.select(spot).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("mask")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return bits, ids.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool) if bits <= 1 << 20 else table)


def _spot(bits: int, column: str = "id"):
    return F.expr(f"pmod(xxhash64({column}), {bits}L)")


def _setter(width: int, sieve):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sieve.value
        for batch in batches:
            spot = batch.column(2).to_numpy()
            may = table[spot] if table.dtype == bool else (table[spot >> 6] >> (spot & 63)) & 1 == 1
            few = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"]).filter(pa.array(may))
            for lo, hi, _, sh in K.shingled(few.column(1), width):
                yield pa.RecordBatch.from_arrays([few.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sh.sets()], pa.binary())], ["id", "shingles"])

    return sets


def _confirmer(percent: int):
    """Streams rows sorted by owner: the owner's set comes first, then those to compare with it."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for a, part, kind, b, raw in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                got = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    owner, held = (a, part), got
                elif (a, part) == owner:
                    small, large = (got, held) if len(got) <= len(held) else (held, got)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum()) if len(large) else 0
                    if both and 100 * both >= percent * (len(got) + len(held) - both):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["src", "dst"])

    return confirm


def confirm_pairs(pairs: DataFrame, docs: DataFrame, percent: int, width: int = 5, block: int = 256) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Sets are built only of texts in some pair. An owner with many partners is dealt out in blocks, and
    a task holds one owner's set at a time. Sets are joined by shuffles at every size, never sent to all tasks.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("deg"))
    dealt = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / block)).alias("part"), "b")
    ids = Staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids").df
    bits, sieve = _sieve(ids)
    built = docs.where("doc_id is not null").select("doc_id", "text", _spot(bits, "doc_id").alias("spot")).mapInArrow(_setter(width, sieve), "id long, shingles binary")
    sets = Staged(built.join(ids.hint("merge"), "id", "left_semi"), "sets")
    owners = dealt.select("a", "part").distinct().join(sets.df.hint("merge"), F.col("a") == F.col("id")).select("a", "part", F.lit(0).alias("kind"), F.col("id").alias("b"), "shingles")
    others = dealt.join(sets.df.hint("merge"), F.col("b") == F.col("id")).select("a", "part", F.lit(1).alias("kind"), "b", "shingles")
    rows = owners.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    out = Staged(rows.mapInArrow(_confirmer(percent), "src long, dst long"), "links")
    sets.drop()
    return out.df


def _most_apart(percent: int, words: int) -> int:
    """Differing bits of 1-bit MinHash that a pair at the threshold stays below, but for SIGMAS deviations."""
    bits, p = 64 * words, (1 + percent / 100) / 2
    return int(bits * (1 - p) + SIGMAS * (bits * p * (1 - p)) ** 0.5) + 1


def _may(x: str, y: str, percent: int, words: int):
    """Native filter: sizes allow the threshold, and 1-bit MinHash agrees within SIGMAS of it."""
    apart = sum((F.bit_count(F.col(f"{x}b{k}").bitwiseXOR(F.col(f"{y}b{k}"))) for k in range(words)), F.lit(0))
    return (F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * percent) & (apart <= _most_apart(percent, words))


def _compare(percent: int):
    """Pairs of different components within each unit that pass the filters; units adjoin.

    A pair is made in the first of the regions that it shares.
    """
    first, whole = _most_apart(percent, 2), _most_apart(percent, WORDS)

    def pairs(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        region, u, v, block, ids, comp, n = (rows.column(k).to_numpy() for k in range(7))
        keys = rows.column(7 + WORDS).flatten().to_numpy().reshape(len(ids), -1)
        bits = np.stack([rows.column(7 + k).to_numpy() for k in range(WORDS)], 1).view(np.uint64)
        stop = np.repeat(np.append(starts[1:], len(ids)), np.diff(np.append(starts, len(ids))))
        live, step = np.arange(len(ids)), 0
        while True:  # each row with the one ``step`` places on, as long as that is of its unit
            step += 1
            live = live[live + step < stop[live]]
            if not len(live):
                return
            x, y = live, live + step
            fit = (comp[x] != comp[y]) & ((u[x] == v[x]) | (block[x] != block[y])) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y = x[fit], y[fit]
            near = np.bitwise_count(bits[x, :2] ^ bits[y, :2]).sum(1, dtype=np.int64) <= first
            x, y = x[near], y[near]
            near = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= whole
            x, y = x[near], y[near]
            shared = (keys[x] == keys[y]).argmax(1)
            once = keys[x, shared] == region[x]
            x, y = x[once], y[once]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in K.whole_groups(batches, 3):
            yield from pairs(rows, starts)

    return run


def _apart(open_: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of each region: its rows meet in blocks, two blocks a unit, so no task holds more."""
    blocks = open_.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("region", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "id", "comp", "n", *BIT_COLUMNS, "keys")
    return units.repartition("region", "u", "v").sortWithinPartitions("region", "u", "v").mapInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, text string)."""
    K.bounded_batches(docs)
    percent = round(threshold * 100)
    depth = min(LABEL, forest_depth(percent / 100, trees))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lists = ("region", "high", "low")
    base = Staged(docs.mapInArrow(_signer(width, trees, depth), f"doc_id long, row long, n long, digest binary, {', '.join(f'{x} array<long>' for x in lists)}, " + ", ".join(f"{b} long" for b in BIT_COLUMNS)), "sig").df
    reps = Staged(base.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("one")).select("digest", F.col("one.doc_id").alias("rep"), F.col("one.row").alias("at")), "classes").df
    heads = base.join(reps.hint("merge"), base.row == reps["at"], "left_semi")
    labels = heads.select(F.col("doc_id").alias("id"), "n", "b0", "b1", F.posexplode(F.arrays_zip(*lists)).alias("tree", "k")).select("k.region", "tree", "k.high", "k.low", "id", "n", "b0", "b1")
    order = ("tree", "high", "low", "region", "id")
    ordered = labels.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = Staged(ordered.mapInArrow(_neighbours(depth, percent), ORDERED), "order").df
    sizes = runs.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    near = Staged(runs.join(sizes, "region"), "regions").df

    central = near.groupBy("id").agg(F.sum("size").alias("weight"))
    known = Staged(near.join(central, "id"), "central").df
    face = F.struct("weight", (-F.col("id")).alias("order"), "id", "n", "b0", "b1")
    first = known.groupBy("region").agg(F.max(face).alias("top"))
    inner = known.groupBy("inner").agg(F.max(face).alias("top"), F.count("*").alias("c")).where("c > 1").drop("c")
    offers = known.join(first, "region").select("id", "n", "b0", "b1", "top").union(known.join(inner, "inner").select("id", "n", "b0", "b1", "top"))
    offers = offers.where((F.col("id") != F.col("top.id")) & _may("", "top.", percent, 2))
    stars = offers.groupBy("id").agg(F.max("top").alias("top")).select(F.col("top.id").alias("a"), F.col("id").alias("b"))
    mates = near.where("mate is not null").groupBy("id").agg(F.max(F.struct("common", (-F.col("mate")).alias("mate"))).alias("m")).select((-F.col("m.mate")).alias("a"), F.col("id").alias("b"))
    mates = mates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = confirm_pairs(Staged(stars.union(mates).distinct(), "stars").df, docs, percent, width)
    so_far = connected_components(links)

    now = near.join(so_far, "id", "left").select("region", "id", F.coalesce("component", "id").alias("comp"))
    split = now.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region")
    faces = heads.select(F.col("doc_id").alias("id"), "n", *BIT_COLUMNS, F.col("region").alias("keys"))
    open_ = Staged(now.join(split, "region", "left_semi").join(faces.hint("merge"), "id"), "open").df
    more = confirm_pairs(Staged(_apart(open_, percent).distinct(), "rest").df, docs, percent, width)

    comps = connected_components(links.union(more))
    named = reps.join(comps, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("comp"))
    out = base.select("doc_id", "n", "digest").join(named, "digest", "left")
    group = F.coalesce("comp", "doc_id")
    group = F.when(F.col("doc_id").isNotNull(), group)
    return out.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(False)).alias("kept"))


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at Jaccard 0.85 on five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 0.85)
