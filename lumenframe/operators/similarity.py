"""Vector pairs by blocks: every pair of blocks is one task's matrix product, so memory is two blocks.

Vectors are dealt to blocks by a hash of their id; nothing is broadcast and no pair below a threshold
leaves a task. Dot products run in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import vectors as V
from lumenframe.plans.config import EVALUATION

BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Blocks of a table whose blocks may still grow, and the products that a kernel makes at once.
BLOCKS, TILE = 12, 1 << 20


def _matrix(table: pa.Table, extra: list[str]) -> tuple[np.ndarray, ...]:
    ids = table.column("id").to_numpy()
    flat = table.column("vector").combine_chunks()
    flat = flat.flatten().to_numpy() if len(ids) else np.zeros(0)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else flat.reshape(0, 0), *(table.column(c).to_numpy()[order] for c in extra)


def block_pairs(vectors: DataFrame, kernel, schema: str, every: bool = False, block: int | None = None, extra: str | None = None, counted: bool = False) -> DataFrame:
    """Runs ``kernel(left ids, left matrix, right ids, right matrix, same block)`` on pairs of blocks.

    ``vectors`` has id (long) and vector. Each unordered pair of blocks comes once; ``every`` gives both orders.
    A column ``extra`` (long) goes to the kernel after each matrix. Blocks grow with the table, up to
    ``BLOCK_BYTES`` of vectors, so a vector has ``BLOCKS`` + 1 copies until then. The kernel gets tiles of the left
    block, so it holds about ``TILE`` products at a time; ``counted`` adds up the tiles' column n inside the task.
    """
    more = [extra] if extra else []
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *(F.col(c).cast("long").alias(c) for c in more))
    if block is None:
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("d")).first()
        block = max(BLOCK, min(-(-size["n"] // BLOCKS), BLOCK_BYTES // (8 * max(1, size["d"]))))
    n = max(1, -(-rows.count() // block))
    spot = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"l": spot, "left": F.lit(True)}).withColumn("r", other)
    right = rows.withColumns({"r": spot, "left": F.lit(False)}).withColumn("l", other)
    both = left.select("l", "r", "left", "id", "vector", *more).union(right.select("l", "r", "left", "id", "vector", *more))
    both, tile = both if every else both.where("l <= r"), TILE

    def run(key, table):
        l, r = (k.as_py() for k in key)
        side = table.column("left")
        a, b = _matrix(table.filter(side), more), _matrix(table.filter(pc.invert(side)), more)
        step, out = max(1, tile // max(1, len(b[0]))), []
        for lo in range(0, max(1, len(a[0])), step):
            cut = [x[lo : lo + step] for x in a]
            if l != r:
                out.append(kernel(*cut, *b, False))
                continue
            out.append(kernel(*cut, *cut, True))
            rest = [np.concatenate([x[: lo if every else 0], x[lo + step :]]) for x in b]
            if len(rest[0]):
                out.append(kernel(*cut, *rest, False))
        whole = pa.concat_tables([pa.table(x) for x in out])
        if not counted:
            return whole
        keys = [c for c in whole.column_names if c != "n"]
        return whole.group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])

    return both.groupBy("l", "r").applyInArrow(run, schema)


def threshold_edges(vectors: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, similarity), src < dst, for all pairs with a dot product of the threshold or more."""

    def kernel(a, x, b, y, same):
        sim = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        i, j = np.nonzero(np.triu(sim >= threshold, 1) if same else sim >= threshold)
        lo, hi = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        return {"src": pa.array(lo, pa.int64()), "dst": pa.array(hi, pa.int64()), "similarity": pa.array(sim[i, j])}

    return block_pairs(vectors, kernel, "src long, dst long, similarity double")


def nearest(vectors: DataFrame, k: int = 1) -> DataFrame:
    """(id, rank, neighbor, similarity): the k nearest others; ties go to the smaller id."""

    def kernel(a, x, b, y, same):
        if not len(a) or not len(b):
            return {"id": pa.array([], pa.int64()), "neighbor": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}
        sim = x @ y.T
        if same:
            np.fill_diagonal(sim, -np.inf)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(sim, top, 1)
        ok = np.isfinite(value)
        return {"id": pa.array(np.repeat(a, top.shape[1])[ok.ravel()]), "neighbor": pa.array(b[top][ok]), "similarity": pa.array(value[ok])}

    found = block_pairs(vectors, kernel, "id long, neighbor long, similarity double", every=True)
    if k == 1:
        best = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("neighbor")).alias("order"), "neighbor")).alias("b"))
        return best.select("id", F.lit(1).alias("rank"), "b.neighbor", "b.similarity")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbor", "similarity")


def pair_similarities(vectors: DataFrame, max_pairs: int = 1_000_000, seed: int = 42) -> tuple[DataFrame, str]:
    """(similarity) of all pairs if there are at most ``max_pairs``, else of that many hashed draws; and the mode.

    Draws pair two rows at hashed positions, never a row with itself, and repeat for one seed.
    """
    n = vectors.count()
    if n * (n - 1) // 2 <= max_pairs:
        return threshold_edges(vectors, -float("inf")).select("similarity"), "exact"
    index = _positions(vectors)
    draw = vectors.sparkSession.range(max_pairs).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n - 1)).alias("o"))
    draw = draw.select("i", F.pmod(F.col("i") + 1 + F.col("o"), F.lit(n)).alias("j"))
    a, b = index.select(F.col("pos").alias("i"), F.col("vector").alias("x")), index.select(F.col("pos").alias("j"), F.col("vector").alias("y"))
    return draw.join(a, "i").join(b, "j").select(V.dot("x", "y").alias("similarity")), "sampled"


def _positions(vectors: DataFrame) -> DataFrame:
    from lumenframe.plans.prefix import running_sums

    one = vectors.select("id", "vector", F.lit(1).alias("one"))
    return running_sums(one, [F.col("id").asc()], {"upto": "one"}).select("id", "vector", (F.col("upto") - 1).alias("pos"))


def group_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, similarity) of all pairs within equal keys, src < dst. ``rows``: keys, id, vector."""
    a = rows.select(*keys, F.col("id").alias("src"), F.col("vector").alias("x"))
    b = rows.select(*keys, F.col("id").alias("dst"), F.col("vector").alias("y"))
    return a.join(b, keys).where("src < dst").select(*keys, "src", "dst", V.dot("x", "y").alias("similarity"))


def pair_histogram(vectors: DataFrame, low: float = -1.0, high: float = 1.0, bins: int = 80) -> DataFrame:
    """(bin, n) over the similarities of all pairs, summed inside the tasks; the last bin is closed."""

    def kernel(a, x, b, y, same):
        sim = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        v = sim[np.triu_indices(len(a), 1)] if same else sim.ravel()
        v = v[(v >= low) & (v <= high)]
        n = np.bincount(np.minimum(np.floor((v - low) / ((high - low) / bins)).astype(int), bins - 1), minlength=bins)
        return {"bin": pa.array(np.arange(bins), pa.int32()), "n": pa.array(n.astype(np.int64))}

    return block_pairs(vectors, kernel, "bin int, n long", counted=True).groupBy("bin").agg(F.sum("n").alias("n"))


def pair_scores_counted(vectors: DataFrame, digits: int = 4, folds: int = 10) -> DataFrame:
    """(score, same, fold, weight): similarities of all pairs rounded half up, counted inside the tasks.

    ``vectors`` has id, vector and label; a pair is ``same`` if its labels are equal, and its fold is that of
    the smaller id. No pair leaves a task, only its count.
    """

    def kernel(a, x, la, b, y, lb, same):
        sim = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        i, j = np.triu_indices(len(a), 1) if same else np.indices(sim.shape).reshape(2, -1)
        score = sim[i, j] * 10**digits
        score = np.where(score < 0, np.ceil(score - 0.5), np.floor(score + 0.5)).astype(np.int64)
        match, fold = la[i] == lb[j], np.minimum(a[i], b[j]) % folds
        key, n = np.unique((score * 2 + match) * folds + fold, return_counts=True)
        return {"score": pa.array((key // folds // 2) / 10**digits), "same": pa.array(key // folds % 2 == 1), "fold": pa.array((key % folds).astype(np.int32)), "n": pa.array(n.astype(np.int64))}

    return block_pairs(vectors, kernel, "score double, same boolean, fold int, n long", extra="label", counted=True).withColumnRenamed("n", "weight")


def quantiles(values: DataFrame, column: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """One row: min, exact linear quantiles q50, q95, ..., max."""
    return values.agg(F.min(column).alias("min"), *(F.percentile(column, F.lit(p)).alias(f"q{round(p * 100)}") for p in points), F.max(column).alias("max"))


#: Ranges that a pass over all pairs counts, steps of the finest range, and the values that one task sorts.
RANGES, FINEST, FEW = 1 << 12, 1 << 42, 100_000


def pair_quantiles(vectors: DataFrame, points=(0.5, 0.95, 0.99), few: int = FEW) -> DataFrame:
    """One row as ``quantiles`` gives it, over the similarities of all pairs, which never leave a task.

    A pass counts ``RANGES`` parts of every range that holds a wanted rank; the parts that hold one go into the next
    pass, until they hold at most ``few`` values each, or are as narrow as ranges get. A last pass gathers the distinct
    values of those with their counts. Values are placed by the same monotone steps in every pass.
    """
    spark, names = vectors.sparkSession, ["min", *(f"q{round(p * 100)}" for p in points), "max"]
    schema = ", ".join(f"{n} double" for n in names)
    norm = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.when(~F.isnan(norm) & (norm < float("inf")), norm)).alias("m")).first()
    n, bound = size["n"] * (size["n"] - 1) // 2, (size["m"] or 0.0) * (1 + 1e-9) or 1.0
    if not n:
        return spark.createDataFrame([(None,) * len(names)], schema)

    def values(a, x, b, y, same):
        sim = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        v = sim[np.triu_indices(len(a), 1)] if same else sim.ravel()
        spot = np.fmax(np.fmin((v + bound) * (FINEST / (2 * bound)), FINEST - 1), 0)  # NaN counts as the largest
        return v, spot.astype(np.int64)

    def counts(ranges, width):
        def kernel(*block):
            at, place, step = [], [], width // RANGES
            spot = values(*block)[1]
            for low in ranges:
                part = spot if width == FINEST else spot[(spot >= low) & (spot < low + width)]
                found = np.bincount((part - low) // step, minlength=RANGES)
                some = np.flatnonzero(found)
                at.append(low + some * step)
                place.append(found[some])
            return {"low": pa.array(np.concatenate(at), pa.int64()), "n": pa.array(np.concatenate(place), pa.int64())}

        return sorted((r["low"], r["n"]) for r in block_pairs(vectors, kernel, "low long, n long", counted=True).groupBy("low").agg(F.sum("n").alias("n")).collect())

    spots = [(p * (n - 1), min(int(p * (n - 1)), max(0, n - 2))) for p in points]
    wanted = sorted({0, n - 1, *(r for _, r in spots), *(min(r + 1, n - 1) for _, r in spots)})
    width, ranges = FINEST, {0: (0, n)}  # begin: (values before, values in it)
    while width >= RANGES and max(m for _, m in ranges.values()) > few:
        found, kept = counts(sorted(ranges), width), {}
        step = width // RANGES
        for low, (before, _) in ranges.items():
            seen = before
            for at, m in found:
                if low <= at < low + width:
                    if any(seen <= r < seen + m for r in wanted):
                        kept[at] = (seen, m)
                    seen += m
        ranges, width = kept, step
    lows = sorted(ranges)

    def gather(*block):
        v, spot = values(*block)
        at = np.searchsorted(lows, spot, "right") - 1
        inside = (at >= 0) & (spot < np.array(lows)[at] + width)
        v, m = np.unique(v[inside], return_counts=True)
        return {"v": pa.array(v), "n": pa.array(m.astype(np.int64))}

    held = block_pairs(vectors, gather, "v double, n long", counted=True).groupBy("v").agg(F.sum("n").alias("n"))
    held = held.orderBy("v").collect()
    ends, rank = np.cumsum([r["n"] for r in held]), {}
    shift, at = {}, 0
    for low in lows:
        shift[at] = ranges[low][0] - at  # rank of a value less its place among those gathered
        at += ranges[low][1]
    for r in wanted:
        gap = next(g for start, g in sorted(shift.items(), reverse=True) if start + g <= r)
        rank[r] = held[int(np.searchsorted(ends, r - gap, "right"))]["v"]
    mid = [rank[r] if p == r else rank[r] + (rank[r + 1] - rank[r]) * (p - r) if n > 1 else rank[r] for p, r in spots]
    return spark.createDataFrame([(rank[0], *mid, rank[n - 1])], schema)


#: Components up to which a vector is summed by one aggregate each.
WIDE = 128


def vector_sum(rows: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """(keys, centroid): the weighted sum of vectors of each key over its L2 norm.

    Every component is an aggregate, so a large group is summed before it is shuffled; vectors beyond
    ``WIDE`` components are summed as rows.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    dim = rows.agg(F.max(F.size(vector))).first()[0] or 0
    if 0 < dim <= WIDE:
        sums = rows.groupBy(*keys).agg(*(F.sum(F.get(vector, F.lit(i)).cast("double") * w).alias(f"_s{i}") for i in range(dim)))
        whole = sums.select(*keys, F.array_compact(F.array(*(f"_s{i}" for i in range(dim)))).alias("_v"))
        return _over_norm(whole, keys)
    parts = rows.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_i", "_v"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum(F.col("_v").cast("double") * F.col("_w")).alias("_s"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_p"))
    return _over_norm(packed.select(*keys, F.col("_p._s").alias("_v")), keys)


def _over_norm(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centroid) of sums ``_v``. A lambda evaluates what it names for each component, so the norm is a column before."""
    n = F.col("_n")
    length = F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector has no direction")).cast("double"))
    return rows.withColumn("_n", V.norm("_v")).select(*keys, F.transform("_v", lambda x: x.cast("double") / length).alias("centroid"))


def centroid_margins(members: DataFrame, centroids: DataFrame, block: int = 4096) -> DataFrame:
    """(id, key, own, other, margin): similarity to the own centroid and the best other one, -1 where none is.

    ``members``: id, key, vector; ``centroids``: key, centroid. Blocks of members meet blocks of centroids as
    matrix products; a block gives each member its own and its best other similarity, never all of them.
    """
    rows = members.select("id", F.col("key").cast("string").alias("_k"), F.col("vector").cast("array<double>").alias("v"))
    heads = centroids.select(F.col("key").cast("string").alias("_k"), F.col("centroid").cast("array<double>").alias("v"))
    n, m = (max(1, -(-df.count() // block)) for df in (rows, heads))
    side = lambda df, own, name, other, k, is_member: df.withColumns({name: F.pmod(F.xxhash64(*own), F.lit(k[0])).cast("int"), "member": F.lit(is_member)}).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(k[1] - 1))))
    left, right = side(rows, ["id"], "l", "r", (n, m), True), side(heads, ["_k"], "r", "l", (m, n), False)
    names = ("l", "r", "member", "id", "_k", "v")
    both = left.select(*names).union(right.withColumn("id", F.lit(None).cast(rows.schema["id"].dataType)).select(*names))
    kind = rows.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        is_member = table.column("member")
        a, c = table.filter(is_member), table.filter(pc.invert(is_member))
        matrix = lambda t: np.concatenate([x.flatten().to_numpy() for x in t.column("v").chunks]).reshape(t.num_rows, -1)
        own, other = np.full(a.num_rows, -np.inf), np.full(a.num_rows, -np.inf)
        if a.num_rows and c.num_rows:
            sim = matrix(a) @ matrix(c).T
            at = {k: i for i, k in enumerate(c.column("_k").to_pylist())}
            mine = np.array([at.get(k, -1) for k in a.column("_k").to_pylist()])
            has = np.flatnonzero(mine >= 0)
            own[has] = sim[has, mine[has]]
            sim[has, mine[has]] = -np.inf
            other = sim.max(1)
        return pa.table({"id": a.column("id"), "_k": a.column("_k"), "own": pa.array(own), "other": pa.array(other)})

    found = both.groupBy("l", "r").applyInArrow(lambda table: run(table), f"id {kind}, _k string, own double, other double")
    best = found.groupBy("id", "_k").agg(F.max("own").alias("own"), F.max("other").alias("other"))
    real = lambda c: F.when(F.col(c) > -float("inf"), F.col(c))
    out = best.select("id", F.col("_k").cast(members.schema["key"].dataType).alias("key"), real("own").alias("own"), F.coalesce(real("other"), F.lit(-1.0)).alias("other"))
    return out.withColumn("margin", F.col("own") - F.col("other"))


def cluster_edges(vectors: DataFrame, threshold: float, exact_vectors: int = EVALUATION["exact_vectors"], neighbors: int = EVALUATION["ann_neighbors"]) -> tuple[DataFrame, str]:
    """(edges, mode): all pairs at the threshold, or beyond ``exact_vectors`` those among each vector's ``neighbors`` nearest.

    Fixed by the evaluation protocol: large sets are clustered over a neighbour graph of bounded degree.
    """
    if vectors.count() <= exact_vectors:
        return threshold_edges(vectors, threshold), "exact"
    near = nearest(vectors, neighbors).where(F.col("similarity") >= threshold)
    edges = near.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), "similarity")
    return edges.groupBy("src", "dst").agg(F.max("similarity").alias("similarity")), "neighbors"
