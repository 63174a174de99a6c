"""Embedding near-duplicates over robust-pruned flat graphs.

Vectors of a label are dealt to overlapping cluster shards: a vector's home is the nearest of the
label's centroids, and it is also placed in every shard that a vector within the link distance could
have as its home, so that both ends of a link meet in the home of each. A large shard is cut into blocks, and each block of queries (home
vectors) meets each block of members, so no task holds more than two blocks. In a block the graph is
built on overlapping sub-clusters: near and far candidates are robust-pruned, and the adjacency lists
of the sub-clusters are united. Queries run in lockstep: greedy search with a beam from the medoids,
then the range expands over the neighbours of everything found within the link distance. Each block
audits recall by brute force on some queries; while it falls short, the beam doubles, and at last
the block is scanned. Found pairs are verified by cosine in double precision.

Equal vectors of a label are one class from the start, counted with their number. A class has a number of
its own, so vectors that share a vec_id but differ are vectors of their own, each with its links. Null labels, and
vectors that are null, empty, zero or hold null or non-finite components, link with nothing and are
their own component. Vectors of different lengths never link. Rows without a vec_id get a null
component and aren't kept. Centroids come from a bounded, hashed sample (``MAX_SAMPLE`` vectors); all rows
are placed and searched. ``audit_links`` measures recall against brute force over all rows. An empty table
gives no rows. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.textkit import BASE, mix
from lumenframe.operators.graph import connected_components
from lumenframe.plans.staging import Staged

SHARD, MAX_SAMPLE = 4096, 1 << 16
SUB, DEGREE, ALPHA, NEAR, FAR = 1024, 24, 1.2, 40, 24
BEAM, MEDOIDS, AUDIT, DOUBLINGS = 32, 8, 48, 3
#: Numbers of a query, over all query blocks that meet a member block at once, in units of SHARD; at most so many blocks.
ASKED, MOST_ASKED = 1024, 16


def _spread(n: int, count: int, salt: int) -> np.ndarray:
    """``count`` places below n, made by rule."""
    return (mix(np.arange(count, dtype=np.uint64) * BASE + np.uint64(salt)) % np.uint64(n)).astype(np.int64)


def robust_prune(x: np.ndarray, salt: int) -> np.ndarray:
    """Adjacency [n, DEGREE] of a sub-cluster, -1 where a list is shorter."""
    n = len(x)
    if n < 2:
        return np.full((n, DEGREE), -1)
    sim = x @ x.T
    np.fill_diagonal(sim, -3)
    near = min(NEAR, n - 1)
    cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    if n > near + 1:
        cand = np.concatenate([cand, _spread(n, n * FAR, salt).reshape(n, FAR)], axis=1)
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-sim[rows, cand], axis=1, kind="stable"), 1)
    far = 1 - sim[rows, cand]
    alive = cand != rows
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    out = np.full((n, DEGREE), -1)
    for r in range(DEGREE):
        pick = alive.argmax(1)
        has = alive[np.arange(n), pick]
        if not has.any():
            break
        best = cand[np.arange(n), pick]
        out[has, r] = best[has]
        alive &= ALPHA * (1 - sim[best[:, None], cand]) > far
        alive[np.arange(n), pick] = False
    return out


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency, medoids) of a block: pruned on overlapping sub-clusters, lists united."""
    n = len(x)
    k = max(1, -(-2 * n // SUB))
    centres = x[np.unique(_spread(n, k, 5))]
    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :2]
    lists, medoids = [[] for _ in range(2)], []
    for c in range(len(centres)):
        for part in np.array_split(np.flatnonzero((order == c).any(1)), max(1, -(-int((order == c).any(1).sum()) // (4 * SUB)))):
            if not len(part):
                continue
            local = robust_prune(x[part], c)
            for side in range(order.shape[1]):
                mine = order[part, side] == c
                lists[side].append((part[mine], np.where(local[mine] >= 0, part[local[mine]], -1)))
            mean = x[part].mean(0)
            medoids.append(int(part[np.argmax(x[part] @ mean)]))
    graph = np.full((n, 2 * DEGREE), -1)
    for side, parts in enumerate(lists):
        for at, near in parts:
            graph[at, side * DEGREE : (side + 1) * DEGREE] = near
    graph.sort(axis=1)
    graph[:, 1:][graph[:, 1:] == graph[:, :-1]] = -1
    return graph, np.array(medoids[:MEDOIDS] if len(medoids) <= MEDOIDS else np.array(medoids)[_spread(len(medoids), MEDOIDS, 9)])


def _meet(q, x, seen, row, col):
    """Similarities of pairs not seen before, which are marked as seen."""
    seen[row, col] = True
    return np.einsum("ij,ij->i", q[row], x[col])


def range_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) with a similarity of ``least`` or more that the graph search meets."""
    nq, n = len(q), len(x)
    seen, start = np.zeros((nq, n), bool), np.unique(medoids)
    width = max(beam, len(start))
    held, near = np.full((nq, width), -2, np.float32), np.zeros((nq, width), np.int64)
    done = np.ones((nq, width), bool)
    seen[:, start] = True
    held[:, : len(start)], near[:, : len(start)], done[:, : len(start)] = q @ x[start].T, start, False
    r, c = np.nonzero(held >= least)
    rows, cols, live = [r], [near[r, c]], np.arange(nq)
    while len(live):
        best = np.where(done[live], np.float32(-4), held[live]).argmax(1)
        go = ~done[live, best]
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        ring = graph[near[live, best]]
        fresh = (ring >= 0) & ~seen[live[:, None], ring]
        at, k = np.nonzero(fresh)
        row, col = live[at], ring[at, k]
        new = np.full(ring.shape, -2, np.float32)
        new[at, k] = sim = _meet(q, x, seen, row, col)
        rows.append(row[sim >= least])
        cols.append(col[sim >= least])
        every, names, was = np.concatenate([held[live], new], 1), np.concatenate([near[live], np.maximum(ring, 0)], 1), np.concatenate([done[live], ~fresh], 1)
        top = np.argpartition(-every, width - 1, axis=1)[:, :width]
        held[live], near[live], done[live] = (np.take_along_axis(m, top, 1) for m in (every, names, was))
    row, col = np.concatenate(rows), np.concatenate(cols)
    out = [(row, col)]
    while len(row):  # everything within the range opens its own neighbours
        grown = []
        for lo in range(0, len(row), 16384):
            ring = graph[col[lo : lo + 16384]]
            at, k = np.nonzero((ring >= 0) & ~seen[row[lo : lo + 16384][:, None], ring])
            flat = np.unique(row[lo : lo + 16384][at] * n + ring[at, k])
            a, b = flat // n, flat % n
            hit = _meet(q, x, seen, a, b) >= least
            grown.append((a[hit], b[hit]))
        row, col = (np.concatenate(p) for p in zip(*grown, strict=True))
        out.append((row, col))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _unit(threshold: float):
    loose = threshold - 1e-4

    def search(key, table):
        dim = key[4].as_py()
        ids = table.column("cls").to_numpy()
        weight = table.column("m").to_numpy()
        is_query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column("embedding").chunks]) if table.num_rows else np.zeros(0)
        raw = flat.reshape(-1, dim).astype(np.float64)
        exact = raw / np.sqrt((raw * raw).sum(1))[:, None]
        qi, mi = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(qi) and len(mi):
            x, q = exact[mi].astype(np.float32), exact[qi].astype(np.float32)
            graph, medoids = build_graph(x)
            test, beam = np.unique(_spread(len(q), min(AUDIT, len(q)), 3)), BEAM
            truth = (q[test] @ x.T) >= loose
            for step in range(DOUBLINGS + 1):
                pairs = [range_search(q[i : i + 512], x, graph, medoids, loose, beam) for i in range(0, len(q), 512)]
                a = np.concatenate([r + 512 * i for i, (r, _) in enumerate(pairs)])
                b = np.concatenate([c for _, c in pairs])
                hit = np.isin(a, test)
                found = np.zeros_like(truth)
                found[np.searchsorted(test, a[hit]), b[hit]] = True
                if (found >= truth).all():
                    break
                beam *= 2
                if step == DOUBLINGS:
                    a, b = np.nonzero(q @ x.T >= loose)
            a, b = qi[a], mi[b]
            good = np.concatenate([(exact[a[i : i + 65536]] * exact[b[i : i + 65536]]).sum(1) >= threshold for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            good &= ids[a] != ids[b]
            a, b = a[good], b[good]
        links = np.bincount(a, weights=weight[b], minlength=len(ids)).astype(np.int64)
        root = ids.copy()
        np.minimum.at(root, a, ids[b])
        extra = _forest(ids, a, b)
        return pa.table({"cls": pa.array(np.concatenate([ids[qi], extra[:, 0]])), "links": pa.array(np.concatenate([links[qi], np.zeros(len(extra), np.int64)])), "to": pa.array(np.concatenate([root[qi], extra[:, 1]]))})

    return search


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (id, smallest id of its local component), one a vector with a link in the block."""
    values, back = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    label = np.arange(len(values))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return np.stack([values, values[label]], 1) if len(values) else np.zeros((0, 2), np.int64)
        label = new


def _assigner(centres, reach: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centres.value
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            take, shard, home = [], [], []
            groups: dict = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, rows in groups.items():
                c = known.get(k)
                if c is None:
                    take += rows
                    shard += [0] * len(rows)
                    home += [True] * len(rows)
                    continue
                x = np.array(batch.column(4).take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), k[1])
                x /= np.sqrt((x * x).sum(1))[:, None]
                sq = 2 - 2 * (x @ c.T)
                near = sq.argmin(1)
                for h in np.unique(near).tolist():
                    mine = np.flatnonzero(near == h)
                    gap = np.sqrt(((c - c[h]) ** 2).sum(1))
                    i, j = np.nonzero(sq[mine] - sq[mine, h][:, None] <= 2 * reach * gap + 1e-9)
                    take += [rows[r] for r in mine[i].tolist()]
                    shard += j.tolist()
                    home += (j == h).tolist()
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shard, pa.int32()), pa.array(home, pa.bool_())], [*out.schema.names, "shard", "home"])

    return assign


def _centres(classes: DataFrame, reach: float) -> dict:
    """Centroids of every label too large for one shard, from a bounded hashed sample."""
    total = classes.count()
    shard = max(SHARD, -(-8 * total // MAX_SAMPLE))
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    share = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(shard)) < 4
    rows = classes.where(share).join(large, ["label", "dim"]).select("label", "dim", "n", "embedding", F.xxhash64("cls").alias("h")).orderBy("h").collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["label"], r["dim"]), []).append((r["n"], r["embedding"]))
    out = {}
    for key, sample in by.items():
        x = np.array([e for _, e in sample], np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        chosen: list[int] = []
        for i in range(len(x)):
            if len(chosen) >= -(-sample[0][0] // shard) + 1:
                break
            if not chosen or ((x[chosen] - x[i]) ** 2).sum(1).min() > (2 * reach) ** 2:
                chosen.append(i)
        out[key] = x[chosen]
    return out


def near_vectors(table: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    spark, reach = table.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    kind = "label long, dim int, cls long, m long, embedding array<double>"
    classes = rows.where(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = Staged(classes.select("label", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cls"), "m", "embedding", "rep"), "vectors").df
    centres = spark.sparkContext.broadcast(_centres(classes, reach))
    dealt = Staged(classes.drop("rep").mapInArrow(_assigner(centres, reach), kind + ", shard int, home boolean"), "dealt").df
    sizes = dealt.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))
    placed = dealt.join(sizes, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("asked", F.greatest(F.lit(1), F.least(F.lit(MOST_ASKED), F.floor(F.lit(ASKED) / F.col("dim")).cast("int"))))
    count = F.ceil(F.col("blocks") / F.col("asked")).cast("int")
    to_queries, to_members = (F.explode(F.sequence(F.lit(0), n - 1)) for n in (count, F.col("blocks")))
    members = placed.withColumn("qb", to_queries).select("label", "shard", "qb", F.col("block").alias("mb"), "dim", "cls", "m", "embedding", F.lit(False).alias("query"))
    asking = placed.where("home").withColumn("mb", to_members).select("label", "shard", F.floor(F.col("block") / F.col("asked")).cast("int").alias("qb"), "mb", "dim", "cls", "m", "embedding", F.lit(True).alias("query"))
    units = members.union(asking).groupBy("label", "shard", "qb", "mb", "dim")
    found = Staged(units.applyInArrow(_unit(threshold), "cls long, links long, to long"), "links").df
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("cls <> to").select(F.col("cls").alias("src"), F.col("to").alias("dst"))).withColumnRenamed("id", "cls")
    names = comps.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("name"))
    comps = comps.join(names, "component").select("cls", "name")
    done = classes.join(counts, "cls", "left").join(comps, "cls", "left")
    done = done.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("name", "rep").alias("comp"))
    out = rows.join(done, fine & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("comp", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def audit_links(table: DataFrame, found: DataFrame, threshold: float = 0.98, queries: int = 500) -> float:
    """Recall of ``found``'s n_links against brute force: ``queries`` vectors, picked by a hash, against all rows."""
    ids = table.select("vec_id").where("vec_id is not null").distinct().orderBy(F.xxhash64("vec_id", F.lit(5))).limit(queries)
    asked = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).join(F.broadcast(ids), "vec_id").where("label is not null and embedding is not null").collect()

    def unit(e) -> np.ndarray | None:
        x = np.array([np.nan if v is None else v for v in e], np.float64)
        size = float(np.sqrt((x * x).sum()))
        return x / size if len(x) and np.isfinite(size) and size else None

    known = [(r["vec_id"], r["label"], unit(r["embedding"])) for r in asked]
    known = table.sparkSession.sparkContext.broadcast([k for k in known if k[2] is not None])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            by: dict = {}
            for label, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unit(e) if label is not None and e is not None else None
                if x is not None:
                    by.setdefault((label, len(x)), []).append(x)
            for i, (_, label, q) in enumerate(known.value):
                rows = by.get((label, len(q)))
                if rows:
                    total[i] += int((np.array(rows) @ q >= threshold).sum())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in known.value], pa.int64()), pa.array(total)], ["vec_id", "n"])

    truth = table.select("label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n")).where("n > 0")
    both = truth.join(found.groupBy("vec_id").agg(F.sum("n_links").alias("got")), "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "got")).alias("got")).first()
    return both["got"] / both["n"] if both["n"] else 1.0


def op7_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Link counts and components of all embeddings at cosine 0.98 within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
