"""Queries of the engine's operators over the shared test tables, with DuckDB SQL where SQL expresses them.

Every query reads whole tables. Derived inputs: embeddings as vectors (label as group), lines of an order
as scored boxes of an image, documents with labels as features of a policy, events as video frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import coerce, geometry
from lumenframe.functions import vectors as V
from lumenframe.operators import cluster_metrics, clustering, detection, evaluation, policy, quality, reports, sampling, selection, similarity, tracking, verification
from lumenframe.plans import config, experiment, protocol
from lumenframe.plans.staging import Staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EDGE, SWEEP = 0.40, [0.35, 0.40, 0.45, 0.50, 0.55]
BOX_MARKS = [0.90, 0.92, 0.94, 0.96, 0.98, 1.0]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _vectors(s, d) -> DataFrame:
    return _table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings)"
PAIRS_SQL = f"{E_SQL}, pairs AS (SELECT a.id AS src, b.id AS dst, a.label AS la, b.label AS lb, list_dot_product(a.v, b.v) AS s FROM e a JOIN e b ON a.id < b.id)"


# --- vectors -----------------------------------------------------------------------------------


@query(f"WITH {E_SQL} SELECT label, count(*)::BIGINT AS vectors, round(max(abs(sqrt(list_dot_product(v, v)) - 1)), 5) AS worst, count_if(abs(sqrt(list_dot_product(v, v)) - 1) <= 0.005)::BIGINT AS unit FROM e GROUP BY label")
def vec_norm_check(s, d):
    off = F.abs(V.norm("vector") - 1)
    return _vectors(s, d).groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.max(off), 5).alias("worst"), F.count_if(off <= 0.005).alias("unit"))


@query(f"WITH {PAIRS_SQL}, b AS (SELECT least(floor((s + 1) / 0.025)::INT, 79) AS bin, count(*) AS n FROM pairs WHERE s BETWEEN -1 AND 1 GROUP BY 1) SELECT r.range::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM range(80) r LEFT JOIN b ON b.bin = r.range")
def pair_histogram(s, d):
    return similarity.pair_histogram(_vectors(s, d))


@query(f"WITH {PAIRS_SQL} SELECT round(min(s), 6) AS min, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.95), 6) AS q95, round(quantile_cont(s, 0.99), 6) AS q99, round(max(s), 6) AS max FROM pairs")
def pair_quantiles(s, d):
    return similarity.pair_quantiles(_vectors(s, d)).select(*_six("min", "q50", "q95", "q99", "max"))


@query(
    f"WITH {E_SQL}, r AS (SELECT a.id, a.label, b.id AS neighbor, b.label AS nl, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS k FROM e a JOIN e b ON a.id <> b.id) "
    "SELECT id, neighbor, round(s, 6) AS similarity, label = nl AS same_group, abs(id - neighbor) AS gap FROM r WHERE k = 1"
)
def nearest_neighbor(s, d):
    v = _vectors(s, d)
    near = similarity.nearest(v)
    other = v.select(F.col("id").alias("neighbor"), F.col("label").alias("nl"))
    return near.join(v.select("id", "label"), "id").join(other, "neighbor").select("id", "neighbor", *_six("similarity"), (F.col("label") == F.col("nl")).alias("same_group"), F.abs(F.col("id") - F.col("neighbor")).alias("gap"))


@query(
    f"WITH {E_SQL}, r AS (SELECT a.id, b.id AS neighbor, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS k FROM e a JOIN e b ON a.id <> b.id) "
    "SELECT id, k::INT AS rank, neighbor, round(s, 6) AS similarity FROM r WHERE k <= 8"
)
def nearest_eight(s, d):
    return similarity.nearest(_vectors(s, d), 8).select("id", "rank", "neighbor", *_six("similarity"))


@query(f"WITH {PAIRS_SQL} SELECT la AS label, src, dst, round(s, 6) AS similarity FROM pairs WHERE la = lb")
def same_group_pairs(s, d):
    return similarity.group_pairs(_vectors(s, d), ["label"]).select("label", "src", "dst", *_six("similarity"))


@query(f"WITH {PAIRS_SQL} SELECT src, dst, round(s, 6) AS similarity FROM pairs WHERE s >= {EDGE}")
def threshold_edges(s, d):
    return similarity.threshold_edges(_vectors(s, d), EDGE).select("src", "dst", *_six("similarity"))


def _components_sql(marks) -> str:
    values = ", ".join(f"({m}::DOUBLE)" for m in marks)
    return f"""WITH RECURSIVE {PAIRS_SQL}, t(t) AS (VALUES {values}), g AS (SELECT t, src, dst FROM pairs JOIN t ON s >= t UNION ALL SELECT t, dst, src FROM pairs JOIN t ON s >= t),
reach(t, id, root) AS (SELECT t, id, id FROM e, t UNION SELECT g.t, g.dst, r.root FROM reach r JOIN g ON g.t = r.t AND g.src = r.id),
c AS (SELECT t, id, min(root) AS component FROM reach GROUP BY t, id)"""


@query(
    _components_sql(SWEEP) + ", z AS (SELECT t, component, count(*) AS n FROM c GROUP BY t, component) SELECT t AS threshold, count(*)::BIGINT AS components, count_if(n = 1)::BIGINT AS singletons, max(n)::BIGINT AS largest, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS clustered FROM z GROUP BY t"
)
def component_sweep(s, d):
    return clustering.component_sizes(clustering.component_sweep(_vectors(s, d), SWEEP))


@query(_components_sql([EDGE]) + " SELECT id, component, (dense_rank() OVER (ORDER BY component) - 1)::BIGINT AS label FROM c")
def component_labels(s, d):
    v = _vectors(s, d)
    found = Staged(clustering.components(v, similarity.threshold_edges(v, EDGE)), "labels").df
    return clustering.dense_labels(found).select("id", "component", F.col("label").cast("long").alias("label"))


CENTRE_SQL = f"""{E_SQL}, x AS (SELECT label, unnest(v) AS c, unnest(range(len(v))) AS i FROM e), sums AS (SELECT label, i, sum(c) AS c FROM x GROUP BY label, i),
m AS (SELECT label, list(c ORDER BY i) AS m FROM sums GROUP BY label), z AS (SELECT label, [y / sqrt(list_dot_product(m, m)) FOR y IN m] AS m FROM m)"""


@query(f"WITH {CENTRE_SQL}, q AS (SELECT e.id, e.label, max(CASE WHEN e.label = z.label THEN list_dot_product(v, m) END) AS own, coalesce(max(CASE WHEN e.label <> z.label THEN list_dot_product(v, m) END), -1) AS other FROM e, z GROUP BY e.id, e.label) SELECT id, label, round(own, 6) AS own, round(other, 6) AS other, round(own - other, 6) AS margin FROM q")
def centroid_margin(s, d):
    v = _vectors(s, d)
    centres = similarity.vector_sum(v, ["label"], "vector").select(F.col("label").alias("key"), "centroid")
    out = similarity.centroid_margins(v.select("id", F.col("label").alias("key"), "vector"), centres)
    return out.select("id", F.col("key").alias("label"), *_six("own", "other", "margin"))


@query(
    f"""WITH {E_SQL}, h AS (SELECT id, label, list_reduce([CASE WHEN v[i] >= 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END FOR i IN range(1, 65)], lambda x, y: x | y) AS h FROM e)
SELECT a.label, a.id AS src, b.id AS dst, bit_count(xor(a.h, b.h))::INT AS hamming FROM h a JOIN h b ON a.label = b.label AND a.id < b.id"""
)
def sign_hash_hamming(s, d):
    h = _vectors(s, d).select("id", "label", V.sign_bits("vector").alias("h"))
    a, b = h.select("label", F.col("id").alias("src"), F.col("h").alias("x")), h.select("label", F.col("id").alias("dst"), F.col("h").alias("y"))
    return a.join(b, "label").where("src < dst").select("label", "src", "dst", V.hamming("x", "y").alias("hamming"))


# --- clustering scores -------------------------------------------------------------------------


def _scores_sql(at_least: int) -> str:
    return _components_sql([EDGE]) + f""", r AS (SELECT e.label AS t, c.component AS p FROM e JOIN c USING (id) WHERE e.label IN (SELECT label FROM e GROUP BY label HAVING count(*) >= {at_least})),
x AS (SELECT t, p, count(*)::DOUBLE AS n FROM r GROUP BY t, p), ts AS (SELECT t, sum(n) AS tn, count(*) AS tk FROM x GROUP BY t), ps AS (SELECT p, sum(n) AS pn, count(*) AS pk FROM x GROUP BY p),
a AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS tp, sum(n * n / pn) AS bp, sum(n * n / tn) AS br FROM x JOIN ts USING (t) JOIN ps USING (p)),
b AS (SELECT sum(tn * (tn - 1) / 2) AS k, count(*) AS labels, count_if(tn >= 2) AS large, count_if(tn >= 2 AND tk > 1) AS split FROM ts), q AS (SELECT sum(pn * (pn - 1) / 2) AS k, count(*) AS clusters FROM ps),
m AS (SELECT count(DISTINCT t) AS merged FROM x JOIN ps USING (p) WHERE pk > 1),
f AS (SELECT a.*, b.k AS tk, b.labels, b.large, b.split, q.k AS pk, q.clusters, m.merged, CASE WHEN q.k > 0 THEN tp / q.k ELSE 1 END AS pp, CASE WHEN b.k > 0 THEN tp / b.k ELSE 1 END AS pr, b.k * q.k / (n * (n - 1) / 2) AS ex FROM a, b, q, m)
SELECT round(pp, 6) AS pair_precision, round(pr, 6) AS pair_recall, round(CASE WHEN pp + pr > 0 THEN 2 * pp * pr / (pp + pr) ELSE 0 END, 6) AS pair_f1, round(bp / n, 6) AS bcubed_precision, round(br / n, 6) AS bcubed_recall,
round(2 * (bp / n) * (br / n) / (bp / n + br / n), 6) AS bcubed_f1, round((tp - ex) / (0.5 * (tk + pk) - ex), 6) AS ari, clusters::BIGINT AS predicted_clusters, round(merged / labels, 6) AS wrongly_merged_identity_fraction, round(split / large, 6) AS fragmented_identity_fraction FROM f"""


def _scores(s, d, at_least: int) -> DataFrame:
    v = _vectors(s, d)
    found = clustering.components(v, similarity.threshold_edges(v, EDGE))
    rows = Staged(found.join(v.select("id", "label"), "id").select(F.col("label").alias("true_label"), F.col("component").alias("predicted")), "truth").df
    out = cluster_metrics.clustering_metrics(rows, at_least=at_least)
    return out.select(*(F.col(c) if c == "predicted_clusters" else F.round(c, 6).alias(c) for c in out.columns))


@query(_scores_sql(1))
def cluster_metrics_all(s, d):
    return _scores(s, d, 1)


@query(_scores_sql(2))
def cluster_metrics_multi(s, d):
    return _scores(s, d, 2)


@query(_components_sql([EDGE]) + " SELECT e.label, count(*)::BIGINT AS images, count(DISTINCT c.component)::BIGINT AS clusters, count(DISTINCT c.component) > 1 AS fragmented FROM e JOIN c USING (id) GROUP BY e.label")
def identity_fragmentation(s, d):
    v = _vectors(s, d)
    found = clustering.components(v, similarity.threshold_edges(v, EDGE)).join(v.select("id", "label"), "id")
    return found.groupBy("label").agg(F.count("*").alias("images"), F.count_distinct("component").alias("clusters")).withColumn("fragmented", F.col("clusters") > 1)


# --- verification ------------------------------------------------------------------------------

SCORED_SQL = f"{PAIRS_SQL}, r AS (SELECT round(s, 4) AS score, la = lb AS same, (src % 10)::INT AS fold FROM pairs)"
SWEEP_SQL = f"""{SCORED_SQL}, tot AS (SELECT count_if(same) AS pos, count_if(NOT same) AS neg FROM r), g AS (SELECT score AS threshold, count_if(same) AS p, count_if(NOT same) AS n FROM r GROUP BY score),
run AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY threshold DESC) UNION ALL SELECT 'inf'::DOUBLE, 0, 0 UNION ALL SELECT '-inf'::DOUBLE, pos, neg FROM tot),
sw AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn, (neg - fp)::BIGINT AS tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall, pos, neg FROM run, tot),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM sw), roc AS (SELECT threshold, fp / greatest(neg, 1) AS fpr, tp / greatest(pos, 1) AS tpr, neg FROM f)"""
F_COLS = "threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _scored(s, d) -> DataFrame:
    """All pairs of vectors, counted by rounded score, label match and fold."""
    return similarity.pair_scores_counted(_vectors(s, d))


def _sweep_columns(df: DataFrame) -> DataFrame:
    return df.select("threshold", "tp", "fp", "fn", "tn", *_six("precision", "recall", "f1"))


@query(f"WITH {SWEEP_SQL} SELECT {F_COLS} FROM f")
def verify_sweep(s, d):
    return _sweep_columns(verification.threshold_sweep(_scored(s, d)))


@query(f"WITH {SWEEP_SQL} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def verify_roc(s, d):
    return verification.roc_points(verification.threshold_sweep(_scored(s, d))).select("threshold", *_six("fpr", "tpr"))


@query(
    f"WITH {SWEEP_SQL}, l AS (SELECT *, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY threshold DESC)), k AS (SELECT (fpr + 1 - tpr) / 2 AS eer FROM roc ORDER BY abs(fpr - (1 - tpr)), threshold DESC LIMIT 1) SELECT round(sum(a), 6) AS roc_auc, round(any_value(k.eer), 6) AS eer FROM l, k"
)
def verify_auc_eer(s, d):
    return verification.auc_eer(verification.roc_points(verification.threshold_sweep(_scored(s, d)))).select(*_six("roc_auc", "eer"))


@query(f"WITH {SWEEP_SQL}, k(far) AS (VALUES (0.1::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE), (0.0001::DOUBLE)) SELECT far, round(coalesce(max(CASE WHEN fpr <= far THEN tpr END), 0), 6) AS tar, max(neg) * far < 10 AS low_support FROM roc, k GROUP BY far")
def verify_tar(s, d):
    return verification.tar_at_far(verification.roc_points(verification.threshold_sweep(_scored(s, d)))).select("far", *_six("tar"), "low_support")


@query(
    f"""WITH {SCORED_SQL}, h AS (SELECT unnest(range(10))::INT AS h), t AS (SELECT h, score, count_if(same) AS p, count_if(NOT same) AS n FROM r JOIN h ON fold <> h GROUP BY h, score), tot AS (SELECT h, sum(p) AS pos, sum(n) AS neg FROM t GROUP BY h),
run AS (SELECT h, score AS th, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM t WINDOW w AS (PARTITION BY h ORDER BY score DESC) UNION ALL SELECT h, 'inf'::DOUBLE, 0, 0 FROM tot UNION ALL SELECT h, '-inf'::DOUBLE, pos, neg FROM tot),
b AS (SELECT h, th, row_number() OVER (PARTITION BY h ORDER BY tp + neg - fp DESC, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END DESC, th DESC) AS k FROM run JOIN tot USING (h))
SELECT h AS fold, th AS threshold, count_if(same AND score >= th)::BIGINT AS tp, count_if(NOT same AND score >= th)::BIGINT AS fp, count_if(same AND score < th)::BIGINT AS fn, count_if(NOT same AND score < th)::BIGINT AS tn, round(count_if(same = (score >= th)) / count(*), 6) AS accuracy FROM b JOIN r ON r.fold = b.h WHERE k = 1 GROUP BY h, th"""
)
def verify_cv(s, d):
    out = verification.cross_validation(_scored(s, d), fold_size=None)
    return out.select("fold", "threshold", "tp", "fp", "fn", "tn", *_six("accuracy"))


@query(f"WITH {SWEEP_SQL} SELECT {F_COLS} FROM f ORDER BY f.f1 DESC, f.recall DESC, threshold DESC LIMIT 1")
def best_threshold_f1(s, d):
    return _sweep_columns(verification.best_threshold(verification.threshold_sweep(_scored(s, d))))


@query(f"WITH {SWEEP_SQL} SELECT {F_COLS} FROM f ORDER BY tp + tn DESC, f.f1 DESC, threshold DESC LIMIT 1")
def best_threshold_acc(s, d):
    return _sweep_columns(verification.best_accuracy_threshold(verification.threshold_sweep(_scored(s, d))))


@query(f"WITH {SWEEP_SQL} SELECT {F_COLS} FROM f WHERE f.precision >= 0.12 ORDER BY f.f1 DESC, f.recall DESC, threshold DESC LIMIT 1")
def best_threshold_precision(s, d):
    return _sweep_columns(verification.best_threshold(verification.threshold_sweep(_scored(s, d)), 0.12))


@query(f"WITH {SCORED_SQL} SELECT round(avg(CASE WHEN same THEN score END), 6) AS same_mean, round(avg(CASE WHEN NOT same THEN score END), 6) AS different_mean FROM r")
def verify_class_means(s, d):
    return verification.class_means(_scored(s, d)).select(*_six("same_mean", "different_mean"))


@query(
    f"WITH {E_SQL}, r AS (SELECT a.id, b.id AS o, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS k FROM e a JOIN e b ON a.id <> b.id) "
    "SELECT least(id, o) AS src, greatest(id, o) AS dst, round(max(s), 6) AS similarity FROM r WHERE k <= 4 AND s >= 0.3 GROUP BY 1, 2"
)
def neighbor_edges(s, d):
    """The threshold graph over each vector's nearest ones, as large sets are clustered."""
    return similarity.cluster_edges(_vectors(s, d), 0.3, exact_vectors=0, neighbors=4)[0].select("src", "dst", *_six("similarity"))


@query(f"WITH {PAIRS_SQL} SELECT src AS left, dst AS right, la = lb AS same, round(s, 6) AS score, s >= 0.5 AS predicted, (s >= 0.5) = (la = lb) AS correct FROM pairs WHERE s >= 0.35")
def pair_predictions(s, d):
    v = _vectors(s, d)
    a, b = (v.select(F.col("id").alias(k), F.col("label").alias(c)) for k, c in (("src", "la"), ("dst", "lb")))
    rows = similarity.threshold_edges(v, 0.35).join(a, "src").join(b, "dst")
    rows = rows.select(F.col("src").alias("left"), F.col("dst").alias("right"), (F.col("la") == F.col("lb")).alias("same"), F.lit(0).alias("fold"), F.col("similarity").alias("score"))
    return evaluation.pair_predictions(rows, 0.5).select("left", "right", "same", *_six("score"), "predicted", "correct")


@query("SELECT o_orderpriority AS path FROM orders WHERE o_orderpriority IS NOT NULL UNION SELECT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL")
def pair_images(s, d):
    return evaluation.pair_images(_table(s, d, "orders").select(F.col("o_orderpriority").alias("left"), F.col("o_orderstatus").alias("right")))


@query(
    _components_sql([EDGE]) + """, f AS (SELECT e.id, e.label, c.component FROM e JOIN c USING (id) WHERE e.id % 10 <> 0), p AS (SELECT a.label = b.label AS t, a.component = b.component AS q FROM f a JOIN f b ON a.id < b.id),
n AS (SELECT count_if(t AND q) AS tp, count_if(q) AS pk, count_if(t) AS tk FROM p), r AS (SELECT tp / pk AS pp, tp / tk AS pr FROM n), k AS (SELECT count(*) AS persons, count_if(n > 1) AS split_persons FROM (SELECT label, count(DISTINCT component) AS n FROM f GROUP BY label))
SELECT round(pp, 6) AS pair_precision, round(pr, 6) AS pair_recall, round(2 * pp * pr / (pp + pr), 6) AS pair_f1, persons::BIGINT AS persons, split_persons::BIGINT AS split_persons, 2 * pp * pr / (pp + pr) >= 0.98 AND split_persons = 0 AS passed FROM r, k"""
)
def identity_gate(s, d):
    v = _vectors(s, d)
    found = clustering.components(v, similarity.threshold_edges(v, EDGE)).select(F.col("id").alias("face_id"), F.col("component").alias("cluster_id"))
    truth = v.select(F.col("id").alias("face_id"), F.col("label").alias("true_person"), (F.col("id") % 10 == 0).cast("int").alias("is_noise"))
    return evaluation.identity_gate(truth, Staged(found, "found").df).select(*_six("pair_precision", "pair_recall", "pair_f1"), "persons", "split_persons", "passed")


# --- quality and policy ------------------------------------------------------------------------

QUALITY_SQL = """f AS (SELECT l_orderkey, l_partkey, l_suppkey, 1 - l_discount AS det, l_quantity AS size, l_extendedprice / 1000 AS blur, l_tax * 1000 AS yaw, l_tax * 500 AS pitch, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 300 END AS roll FROM lineitem),
m AS (SELECT greatest(coalesce(median(CASE WHEN blur > 0 THEN blur END), 100), 1) AS scale FROM f),
c AS (SELECT l_orderkey, l_partkey, l_suppkey, greatest(0, least(1, (det - 0.5) / 0.5)) AS detection_component, greatest(0, least(1, (size - 20) / 140)) AS size_component, greatest(0, least(1, blur / (2 * scale))) AS sharpness_component,
greatest(0, least(1, 1 - (abs(coalesce(yaw, 0)) / 75 + abs(coalesce(pitch, 0)) / 60 + abs(coalesce(roll, 0)) / 60) / 3)) AS pose_component FROM f, m)"""
PARTS = ("detection_component", "size_component", "sharpness_component", "pose_component")


def _features(s, d) -> DataFrame:
    c = F.col
    return _table(s, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", (1 - c("l_discount")).alias("det_score"), c("l_quantity").alias("min_face_size"), (c("l_extendedprice") / 1000).alias("blur_score"),
        (c("l_tax") * 1000).alias("yaw"), (c("l_tax") * 500).alias("pitch"), F.when(c("l_linenumber") % 3 != 0, c("l_discount") * 300).alias("roll"),
    )


@query(f"WITH {QUALITY_SQL} SELECT l_orderkey, l_partkey, l_suppkey, {', '.join(f'round({p}, 6) AS {p}' for p in PARTS)} FROM c")
def quality_components(s, d):
    return quality.rating_components(_features(s, d)).select("l_orderkey", "l_partkey", "l_suppkey", *_six(*PARTS))


@query(f"WITH {QUALITY_SQL} SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(0.30 * detection_component + 0.25 * size_component + 0.25 * sharpness_component + 0.20 * pose_component), 6) AS rating FROM c GROUP BY l_suppkey")
def soft_rating(s, d):
    return quality.rating_components(_features(s, d)).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("soft_rating"), 6).alias("rating"))


@query(f"WITH {QUALITY_SQL} SELECT l_orderkey, l_partkey, l_suppkey, round(0.30 * detection_component + 0.25 * size_component + 0.25 * sharpness_component + 0.20 * pose_component, 6) AS quality_score FROM c")
def fixed_quality_score(s, d):
    faces = _features(s, d).withColumns({"face_width": F.col("min_face_size"), "face_height": F.col("min_face_size") + 1})
    return quality.quality_score(faces).select("l_orderkey", "l_partkey", "l_suppkey", *_six("quality_score"))


SUSPECT_SQL = "f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 1 - l_discount * 4 AS det, l_quantity AS size, l_extendedprice / 1000 AS blur, l_tax * 1000 AS yaw, l_tax * 600 AS pitch, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 500 END AS roll FROM lineitem)"


@query(
    f"WITH {SUSPECT_SQL} SELECT concat_ws(';', CASE WHEN det < 0.65 THEN 'low_detection_score' END, CASE WHEN size < 32 THEN 'small_face' END, CASE WHEN blur < 20 THEN 'blurred' END, CASE WHEN abs(coalesce(yaw, 0)) > 55 THEN 'large_yaw' END, CASE WHEN abs(coalesce(pitch, 0)) > 45 THEN 'large_pitch' END, CASE WHEN abs(coalesce(roll, 0)) > 45 THEN 'large_roll' END) AS reasons, count(*)::BIGINT AS n FROM f GROUP BY 1"
)
def suspicious_flags(s, d):
    c = F.col
    rows = _table(s, d, "lineitem").select((1 - c("l_discount") * 4).alias("det_score"), c("l_quantity").alias("face_width"), (c("l_quantity") + 5).alias("face_height"), (c("l_extendedprice") / 1000).alias("blur_score"), (c("l_tax") * 1000).alias("yaw"), (c("l_tax") * 600).alias("pitch"), F.when(c("l_linenumber") % 3 != 0, c("l_discount") * 500).alias("roll"))
    return rows.select(F.array_join(policy.suspicious_reasons(), ";").alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n"))


def _rules(mode: str, missing: str) -> dict:
    rule = lambda f, o, t: {"feature": f, "operator": o, "threshold": t, "missing": missing, "mode": mode}
    return {"version": "documents", "rules": {"short": rule("n_chars", "lt", 500), "long": rule("n_chars", "gt", 5000), "poor": rule("quality", "lt", 1), "toxic": rule("toxic", "gt", 0), "foreign": {**rule("lang", "eq", "de"), "missing": "ignore"}}}


def _documents(s, d) -> DataFrame:
    labels = _table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return _table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


def _policy(s, d, mode: str, missing: str) -> DataFrame:
    return policy.apply_policy(_documents(s, d), _rules(mode, missing))


def _policy_sql(missing: str) -> str:
    miss = "TRUE" if missing == "violate" else "FALSE"
    return f"""l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), x AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, d.source FROM documents d LEFT JOIN l USING (doc_id)),
p AS (SELECT *, list_filter([CASE WHEN coalesce(n_chars < 500, {miss}) THEN 'short' END, CASE WHEN coalesce(n_chars > 5000, {miss}) THEN 'long' END, CASE WHEN coalesce(quality < 1, {miss}) THEN 'poor' END, CASE WHEN coalesce(toxic > 0, {miss}) THEN 'toxic' END, CASE WHEN lang = 'de' THEN 'foreign' END], lambda r: r IS NOT NULL) AS reasons FROM x)"""


@query(f"WITH {_policy_sql('ignore')} SELECT doc_id, array_to_string(reasons, ';') AS reject_reasons, '' AS shadow_reasons, len(reasons) = 0 AS accepted FROM p")
def policy_hard(s, d):
    return _policy(s, d, "hard", "ignore").select("doc_id", F.array_join("reject_reasons", ";").alias("reject_reasons"), F.array_join("shadow_reasons", ";").alias("shadow_reasons"), "accepted")


@query(f"WITH {_policy_sql('ignore')} SELECT doc_id, '' AS reject_reasons, array_to_string(reasons, ';') AS shadow_reasons, TRUE AS accepted FROM p")
def policy_shadow(s, d):
    return _policy(s, d, "shadow", "ignore").select("doc_id", F.array_join("reject_reasons", ";").alias("reject_reasons"), F.array_join("shadow_reasons", ";").alias("shadow_reasons"), "accepted")


@query(f"WITH {_policy_sql('violate')} SELECT doc_id, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS decision, array_to_string(reasons, ';') AS reject_reasons FROM p")
def policy_missing(s, d):
    return _policy(s, d, "hard", "violate").select("doc_id", "decision", F.array_join("reject_reasons", ";").alias("reject_reasons"))


@query(f"WITH {_policy_sql('ignore')} SELECT reason, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS rate FROM (SELECT unnest(reasons) AS reason FROM p) GROUP BY reason")
def reason_counts(s, d):
    return reports.reason_counts(_policy(s, d, "hard", "ignore")).select("reason", "n", *_six("rate"))


@query(
    f"""WITH {_policy_sql('violate')}, s AS (SELECT list_sort(reasons) AS r FROM p WHERE len(reasons) >= 2), m AS (SELECT r, unnest(range(1, (1 << len(r))::BIGINT)) AS m FROM s),
q AS (SELECT [r[i] FOR i IN range(1, len(r) + 1) IF (m >> (i - 1)) & 1 = 1] AS q FROM m) SELECT array_to_string(q, '&') AS reasons, count(*)::BIGINT AS n FROM q WHERE len(q) >= 2 GROUP BY 1"""
)
def reason_intersections(s, d):
    return reports.reason_intersections(_policy(s, d, "hard", "violate"))


@query(
    f"""WITH {_policy_sql('ignore')}, k AS (SELECT doc_id, len(reasons) = 0 AS a, quality = 1 AS y FROM p),
g AS (SELECT count_if(y IS NOT NULL) AS labelled, count_if(y IS NULL) AS unlabelled, count_if(y AND a) AS tp, count_if(NOT y AND a) AS fp, count_if(y AND NOT a) AS fn, count_if(NOT y AND NOT a) AS tn FROM k)
SELECT labelled::BIGINT AS labelled, unlabelled::BIGINT AS unlabelled, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT AS orphans, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / labelled, 6) AS accuracy FROM g"""
)
def classification_report(s, d):
    rows = _policy(s, d, "hard", "ignore").select(F.col("doc_id").alias("face_id"), "accepted")
    labels = _table(s, d, "labels").groupBy(F.col("doc_id").alias("face_id")).agg((F.max("quality") == 1).alias("positive"))
    return reports.classification_report(rows, labels).select("labelled", "unlabelled", "orphans", "tp", "fp", "fn", "tn", *_six("precision", "recall", "f1", "accuracy"))


@query("WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT count(*)::BIGINT AS count, sum(n)::DOUBLE AS sum, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, round(avg(n), 6) AS mean, round(median(n), 6) AS median FROM n")
def identity_distribution(s, d):
    n = reports.identity_counts(_table(s, d, "customer").select(F.col("c_custkey").alias("identity")), _table(s, d, "orders").select(F.col("o_custkey").alias("identity")))
    return n.agg(*reports.distribution("n"))


@query(
    f"""WITH {_policy_sql('ignore')}, i AS (SELECT doc_id, coalesce('labelled ' || quality::VARCHAR, source) AS identity, len(reasons) = 0 AS a, doc_id % 3 = 0 AS s FROM p)
SELECT identity, count(*)::BIGINT AS before, count_if(a)::BIGINT AS after, count_if(s)::BIGINT AS selected FROM i WHERE identity IS NOT NULL GROUP BY identity"""
)
def identity_stages(s, d):
    """Documents as faces: the labelled identity where there is one, else the source as cluster."""
    rows = _policy(s, d, "hard", "ignore").withColumn("face_id", F.col("doc_id"))
    faces = rows.select("face_id", F.col("source").alias("cluster_id"))
    labels = rows.where("quality is not null").select("face_id", F.concat(F.lit("labelled "), F.col("quality").cast("string")).alias("identity"))
    chosen = rows.select("face_id", (F.col("face_id") % 3 == 0).alias("selected"))
    return reports.identity_stages(reports.face_identities(faces, labels), rows, chosen)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(s, d):
    return _table(s, d, "documents").select("doc_id", "source").join(_table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_policy_sql('ignore')} SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM p WHERE len(reasons) = 0)")
def accepted_semi(s, d):
    return _table(s, d, "documents").select("doc_id", "lang", "n_chars").join(_policy(s, d, "hard", "ignore").where("accepted").select("doc_id"), "doc_id", "left_semi")


@query(
    f"""WITH {_policy_sql('ignore')}, v AS (SELECT doc_id, list_filter([CASE WHEN coalesce(n_chars < 500, TRUE) THEN 1 END, CASE WHEN coalesce(n_chars > 5000, TRUE) THEN 1 END, CASE WHEN coalesce(quality < 1, TRUE) THEN 1 END, CASE WHEN coalesce(toxic > 0, TRUE) THEN 1 END, CASE WHEN lang = 'de' THEN 1 END], lambda r: r IS NOT NULL) AS reasons FROM x),
m AS (SELECT 'ignore' AS experiment, 'accepted' AS metric, count_if(len(reasons) = 0)::DOUBLE AS value FROM p UNION ALL SELECT 'ignore', 'reasons', sum(len(reasons))::DOUBLE FROM p UNION ALL SELECT 'violate', 'accepted', count_if(len(reasons) = 0)::DOUBLE FROM v UNION ALL SELECT 'violate', 'reasons', sum(len(reasons))::DOUBLE FROM v)
SELECT m.experiment, m.metric, m.value, b.value AS baseline_value, m.value - b.value AS delta FROM m JOIN m b ON b.metric = m.metric AND b.experiment = 'ignore'"""
)
def metric_delta(s, d):
    one = lambda how: _policy(s, d, "hard", how).agg(F.count_if("accepted").cast("double").alias("accepted"), F.sum(F.size("reject_reasons")).cast("double").alias("reasons")).select(F.lit(how).alias("experiment"), F.explode(F.create_map(F.lit("accepted"), "accepted", F.lit("reasons"), "reasons")).alias("metric", "value"))
    return reports.metric_delta(one("ignore").union(one("violate")), "ignore")


# --- boxes -------------------------------------------------------------------------------------

BOX_SQL = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS det FROM lineitem),
p AS (SELECT l_orderkey AS image, det, 1 - l_discount AS score, l_linenumber * 7.0 AS x1, l_quantity AS y1, l_linenumber * 7.0 + 10 + l_quantity AS x2, l_quantity + 12 + l_tax * 100 AS y2 FROM l),
g AS (SELECT l_orderkey AS image, det AS gt, l_quantity >= 10 AS kept, l_linenumber * 7.0 + 3 AS x1, l_quantity + 2 AS y1, l_linenumber * 7.0 + 12 + l_quantity AS x2, l_quantity + 15 AS y2 FROM l WHERE l_returnflag = 'R')"""


def _iou_sql(one: int) -> str:
    both = f"greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1) + {one}) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1) + {one})"
    size = lambda b: f"greatest(0, {b}.x2 - {b}.x1 + {one}) * greatest(0, {b}.y2 - {b}.y1 + {one})"
    return f"o AS (SELECT p.image, det, score, gt, kept, {both} / ({size('p')} + {size('g')} - {both}) AS iou FROM p JOIN g USING (image))"


def _boxes(s, d) -> tuple[DataFrame, DataFrame]:
    c, w = F.col, Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = _table(s, d, "lineitem").withColumn("det", F.row_number().over(w))
    box = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).alias("box")
    x = c("l_linenumber") * 7.0
    found = lines.select(c("l_orderkey").alias("image"), "det", (1 - c("l_discount")).alias("score"), box(x, c("l_quantity"), x + 10 + c("l_quantity"), c("l_quantity") + 12 + c("l_tax") * 100))
    true = lines.where("l_returnflag = 'R'").select(c("l_orderkey").alias("image"), c("det").alias("gt"), (c("l_quantity") >= 10).alias("kept"), box(x + 3, c("l_quantity") + 2, x + 12 + c("l_quantity"), c("l_quantity") + 15))
    return found, true


@query(f"WITH {BOX_SQL}, {_iou_sql(1)} SELECT image, det, gt, round(iou, 9) AS iou FROM o")
def iou_pairs_inclusive(s, d):
    return detection.iou_pairs(*_boxes(s, d), closed=True).select("image", "det", "gt", F.round("iou", 9).alias("iou"))


@query(f"WITH {BOX_SQL}, {_iou_sql(0)} SELECT image, det, gt, round(iou, 9) AS iou FROM o")
def iou_pairs_continuous(s, d):
    return detection.iou_pairs(*_boxes(s, d), closed=False).select("image", "det", "gt", F.round("iou", 9).alias("iou"))


@query(f"WITH {BOX_SQL}, b AS (SELECT image, min_by(struct_pack(gt := gt, x1 := x1, y1 := y1, x2 := x2, y2 := y2), gt) AS b FROM g GROUP BY image), o AS (SELECT p.image, det, greatest(0, least(x2, b.x2) - greatest(x1, b.x1)) * greatest(0, least(y2, b.y2) - greatest(y1, b.y1)) AS i, (x2 - x1) * (y2 - y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM p JOIN b USING (image)), r AS (SELECT image, det, i / (u - i) AS iou, row_number() OVER (PARTITION BY image ORDER BY i / (u - i) DESC, det) AS k FROM o) SELECT image, det, round(iou, 6) AS iou FROM r WHERE k = 1 AND iou >= 0.3")
def main_face(s, d):
    found, true = _boxes(s, d)
    one = true.groupBy("image").agg(F.min_by(F.struct("gt", "box"), "gt").alias("g")).select("image", "g.gt", "g.box")
    return detection.main_box(found, one).select("image", "det", *_six("iou"))


@query(f"WITH {BOX_SQL}, r AS (SELECT image, det, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area, row_number() OVER (PARTITION BY image ORDER BY greatest(0, x2 - x1) * greatest(0, y2 - y1) DESC, det) AS k FROM p) SELECT image, det, round(area, 6) AS area FROM r WHERE k = 1")
def largest_face(s, d):
    return detection.largest_box(_boxes(s, d)[0]).select("image", "det", *_six("area"))


@query()
def detector_curve(s, d):
    found, true = _boxes(s, d)
    return detection.detector_curve(found, true, BOX_MARKS).select("threshold", "tp", "fp", "fn", *_six("precision", "recall", "f1"))


@query(
    f"""WITH {BOX_SQL}, {_iou_sql(1)}, b AS (SELECT *, row_number() OVER (PARTITION BY image, det ORDER BY iou DESC, gt) AS k FROM o), h AS (SELECT image, det, score, gt, kept FROM b WHERE k = 1 AND iou >= 0.5),
f AS (SELECT *, kept AND row_number() OVER (PARTITION BY image, gt ORDER BY score DESC, det DESC) = 1 AS fresh FROM h), r AS (SELECT p.image, p.det, p.score, coalesce(f.kept, TRUE) AS proposal, coalesce(f.fresh, FALSE) AS fresh FROM p LEFT JOIN f ON f.image = p.image AND f.det = p.det),
z AS (SELECT (score - (SELECT min(score) FROM r)) / ((SELECT max(score) FROM r) - (SELECT min(score) FROM r)) AS s, proposal, fresh FROM r), zz AS (SELECT s, count_if(proposal) AS p, count_if(fresh) AS r FROM z GROUP BY s),
c AS (SELECT range AS i, coalesce(sum(p), 0) AS p, coalesce(sum(r), 0) AS r FROM range(1, 1001) LEFT JOIN zz ON s >= 1.0::DOUBLE - range / 1000.0::DOUBLE GROUP BY range), t AS (SELECT greatest(count(*), 1) AS n FROM g WHERE kept),
q AS (SELECT i, r / n AS recall, max(CASE WHEN p > 0 THEN r / p ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c, t), e AS (SELECT (recall - lag(recall, 1, 0) OVER (ORDER BY i)) * env AS a FROM q) SELECT round(sum(a), 6) AS ap FROM e"""
)
def average_precision(s, d):
    found, true = _boxes(s, d)
    return detection.average_precision(found, true, true.where("kept").select("image", "gt")).select(*_six("ap"))


# --- order, time and sampling ------------------------------------------------------------------


@query(
    """WITH i AS (SELECT event_id, user_id, epoch_us(ts) AS s, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events), v AS (SELECT * FROM i WHERE e IS NOT NULL)
SELECT a.user_id, a.event_id AS src, b.event_id AS dst FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_id < b.event_id AND greatest(a.s, b.s) <= least(a.e, b.e)"""
)
def interval_overlap(s, d):
    e = _events(s, d)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    spans = e.withColumn("e", F.lead("us").over(w)).where("e is not null")
    return clustering.interval_overlaps(spans, "user_id", "event_id", "us", "e")


def _events(s, d) -> DataFrame:
    us = F.unix_micros(F.to_timestamp_ltz(F.col("ts").cast("string")))
    return _table(s, d, "events").select("event_id", "user_id", "event_type", "value", "props", us.alias("us"))


@query(
    """WITH f AS (SELECT DISTINCT user_id, (epoch_us(ts) // 3600000000)::INT AS h FROM events), n AS (SELECT user_id, h, coalesce((h - lag(h) OVER w > 8)::INT, 0) AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY h)),
g AS (SELECT user_id, h, sum(n) OVER (PARTITION BY user_id ORDER BY h) AS segment FROM n) SELECT g.user_id, segment::BIGINT AS segment, min(g.h)::INT AS start_frame, max(g.h)::INT AS end_frame, count(*)::BIGINT AS n FROM g JOIN (SELECT user_id, (epoch_us(ts) // 3600000000)::INT AS h FROM events) e ON e.user_id = g.user_id AND e.h = g.h GROUP BY g.user_id, segment"""
)
def gap_tracks(s, d):
    rows = _events(s, d).select("user_id", F.floor(F.col("us") / 3_600_000_000).cast("int").alias("h"))
    out = tracking.gap_segments(rows, "user_id", "h", 8)
    return out.groupBy("user_id", "segment").agg(F.min("h").alias("start_frame"), F.max("h").alias("end_frame"), F.count("*").alias("n"))


def _track_faces(s, d) -> DataFrame:
    v = _vectors(s, d)
    n = v.count()
    e = _events(s, d).withColumn("k", F.col("event_id") % n)
    x, y = F.col("value") % 50, F.col("event_id") % 40
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20).cast("double").alias("x2"), (y + 20).cast("double").alias("y2"))
    return e.join(v, e.k == v.id).select(F.col("event_id").cast("string").alias("face_id"), F.col("user_id").cast("string").alias("video_name"), F.floor(F.col("us") / 3_600_000_000).cast("int").alias("frame_number"), box.alias("box"), (F.col("value") % 1).alias("quality_score"), F.col("event_id").alias("row"), "vector")


@query()
def appearance_tracks(s, d):
    found = Staged(tracking.number_tracks(tracking.assign_tracks(_track_faces(s, d), min_similarity=0.05)), "tracked").df
    return tracking.track_rollup(found).drop("centroid")


def _tracks(s, d) -> DataFrame:
    return _vectors(s, d).select("id", F.concat(F.lit("t"), F.col("id")).alias("track_id"), (F.col("id") % 50).cast("string").alias("video_name"), (F.col("id") % 97).cast("int").alias("start_frame"), (F.col("id") % 97 + 5).cast("int").alias("end_frame"), "vector")


@query()
def constrained_clusters(s, d):
    return clustering.constrained_clusters(_tracks(s, d), 0.35)


@query()
def manual_labels(s, d):
    t = _tracks(s, d)
    groups = Staged(clustering.constrained_clusters(t, 0.35), "groups").df
    alone = groups.groupBy("group").agg(F.count("*").alias("n")).where("n = 1").select("group")
    free = groups.join(alone, "group").join(t.where("video_name in ('1', '2', '3')").select("id", "video_name", "track_id", "start_frame"), "id")
    one = free.groupBy("video_name").agg(F.min_by("track_id", "id").alias("track_id")).select("track_id", F.lit("Someone").alias("identity_label"))
    return clustering.manual_labels(groups, t, one)


@query()
def diverse_topk(s, d):
    v = _vectors(s, d)
    faces = v.select(F.col("label").cast("string").alias("cluster_id"), F.col("id").cast("string").alias("face_id"), (F.col("id") % 7).cast("string").alias("video_name"), F.col("id").cast("int").alias("frame_number"), (F.col("id") % 90).cast("double").alias("yaw"), (F.abs(F.col("vector")[0]) * 2).cast("double").alias("quality_score"), V.sign_bits("vector").alias("image_hash"), F.col("id").alias("row"))
    out = selection.diverse_topk(faces, {"duplicate_hamming_threshold": 20})
    return out.select("cluster_id", "face_id", "selected", "rank", F.array_join("not_selected_reasons", ";").alias("reasons"), *_six("selection_value"))


HASH_SQL = "sha256('20260803' || chr(31) || {})"


@query(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {HASH_SQL.format('o_orderkey')}, o_orderkey LIMIT 64")
def hash_sample(s, d):
    return sampling.hash_sample(_table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 64)


@query(f"WITH r AS (SELECT o_orderstatus, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {HASH_SQL.format('o_orderstatus || chr(31) || o_orderpriority || chr(31) || o_orderkey')}, o_orderkey) AS k FROM orders) SELECT o_orderstatus, o_orderpriority, o_orderkey FROM r WHERE k <= 5")
def stratified_sample(s, d):
    rows = _table(s, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return sampling.stratified_sample(rows, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 5)


FIT_BUDGET = 2000


@query(
    f"""WITH RECURSIVE c AS (SELECT o_custkey, count(*)::BIGINT AS n, row_number() OVER (ORDER BY {HASH_SQL.format('o_custkey')}, o_custkey) AS k FROM orders GROUP BY o_custkey HAVING count(*) <= {FIT_BUDGET}),
f(k, o_custkey, n, took, held) AS (SELECT k, o_custkey, n, n <= {FIT_BUDGET}, CASE WHEN n <= {FIT_BUDGET} THEN n ELSE 0 END FROM c WHERE k = 1 UNION ALL SELECT c.k, c.o_custkey, c.n, f.held + c.n <= {FIT_BUDGET}, f.held + CASE WHEN f.held + c.n <= {FIT_BUDGET} THEN c.n ELSE 0 END FROM f JOIN c ON c.k = f.k + 1)
SELECT o_custkey, n, (held - n)::BIGINT AS taken_before FROM f WHERE took"""
)
def whole_group_fit(s, d):
    groups = _table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sampling.whole_group_fit(groups, "o_custkey", "n", FIT_BUDGET)


@query("WITH r AS (SELECT o_custkey, o_orderstatus AS split FROM orders) SELECT o_custkey, count(DISTINCT split)::BIGINT AS splits FROM r GROUP BY o_custkey HAVING count(DISTINCT split) > 1")
def split_disjoint(s, d):
    return sampling.overlapping_splits(_table(s, d, "orders"), "o_custkey", "o_orderstatus")


@query(f"WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY {HASH_SQL.format('c_custkey')}, c_custkey) AS k FROM customer) SELECT 'smoke' AS profile, c_custkey FROM k WHERE k <= 16 UNION ALL SELECT 'dev_a', c_custkey FROM k WHERE k <= 100 UNION ALL SELECT 'dev_b', c_custkey FROM k WHERE k > 100")
def profile_sets(s, d):
    return sampling.profile_sets(_table(s, d, "customer"), "c_custkey", 16, 100)


@query("SELECT page_id, stem AS video_name, coalesce(try_cast(list_last(regexp_extract_all(stem, '\\d+')) AS BIGINT), 0) AS frame_number FROM (SELECT page_id, CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS stem FROM (SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS b FROM pages))")
def frame_parse(s, d):
    return _table(s, d, "pages").select("page_id", coerce.frame_name("url").alias("f")).select("page_id", "f.video_name", "f.frame_number")


@query(
    "WITH t AS (SELECT doc_id, text AS t FROM documents), u AS (SELECT doc_id, trim(regexp_replace(t, '[^0-9A-Za-z\\x{0410}-\\x{044F}_-]+', '_', 'g'), '_') AS a, trim(regexp_replace(t, '[^\\p{L}\\p{M}\\p{N}_-]+', '_', 'g'), '_') AS b FROM t) "
    "SELECT doc_id, CASE WHEN a = '' THEN 'person' ELSE left(a, 60) END AS slug, CASE WHEN b = '' THEN 'video' ELSE right(b, 80) END AS safe FROM u"
)
def slugify(s, d):
    return _table(s, d, "documents").select("doc_id", coerce.slug("text").alias("slug"), coerce.safe_id("text").alias("safe"))


@query("WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '' WHEN 3 THEN event_type ELSE value::VARCHAR END AS t FROM events), y AS (SELECT event_id, CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN try_cast(t AS DOUBLE) END AS v FROM x) SELECT event_id, coalesce(trunc(v)::INT, -1) AS as_int, coalesce(v, 0.5) AS as_float FROM y")
def lenient_cast(s, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "nan").when(k == 1, "inf").when(k == 2, "").when(k == 3, F.col("event_type")).otherwise(F.col("value").cast("string"))
    t = _table(s, d, "events").select("event_id", text.alias("t"))
    return t.select("event_id", coerce.lenient_int("t", -1).alias("as_int"), coerce.lenient_double("t", 0.5).alias("as_float"))


@query("SELECT event_type AS stage, count(*)::BIGINT AS events, max(event_id) AS processed, max(value) >= 90 AS complete FROM events GROUP BY event_type")
def progress_rollup(s, d):
    log = _table(s, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") >= 90, "complete").otherwise("progress").alias("event"), F.col("event_id").alias("at"), F.col("event_id").alias("processed"), F.lit(1).alias("total"))
    rolled = protocol.progress_rollup(log.withColumn("event", F.lit("progress")))
    done = protocol.progress_rollup(log).select("stage", "complete")
    return rolled.drop("complete").join(done, "stage").select("stage", "events", "processed", "complete")


@query("WITH r AS (SELECT vec_id, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings) SELECT vec_id, label, (r // 80)::BIGINT AS page, ((r % 80) // 8)::BIGINT AS row, (r % 8)::INT AS col FROM r")
def contact_layout(s, d):
    rows = _table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return reports.contact_layout(rows, [F.col("vec_id").asc()], group=["label"]).select("vec_id", "label", "page", "row", F.col("col").cast("int").alias("col"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source FROM r WHERE (k - 1) % 3 = 0 AND k <= 298")
def stage_limit(s, d):
    return sampling.every_kth(_table(s, d, "documents").select("doc_id", "source"), [F.col("doc_id").asc()], 3, 100)


@query("SELECT l_orderkey, l_partkey, l_suppkey, greatest(0, round_even(l_quantity - 12 * 0.35, 0)::INT) AS left, least(40, round_even(l_quantity + 12 + 12 * 0.35, 0)::INT) AS right FROM lineitem WHERE least(40, round_even(l_quantity + 12 + 12 * 0.35, 0)::INT) > greatest(0, round_even(l_quantity - 12 * 0.35, 0)::INT)")
def crop_rectangles(s, d):
    q = F.col("l_quantity")
    box = F.struct(q.alias("x1"), F.lit(0.0).alias("y1"), (q + 12).alias("x2"), F.lit(10.0).alias("y2"))
    rows = _table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", box.alias("b"), F.lit(40).alias("w"), F.lit(40).alias("h"))
    return rows.withColumn("r", geometry.crop_rectangle("b", "w", "h")).where("r is not null").select("l_orderkey", "l_partkey", "l_suppkey", "r.left", "r.right")


@query("SELECT o_orderstatus AS partition, count(*)::BIGINT AS images, count(DISTINCT o_custkey)::BIGINT AS identities FROM orders GROUP BY 1")
def dataset_summary(s, d):
    from lumenframe.sources.annotations import dataset_summary as summary

    return summary(_table(s, d, "orders").select(F.col("o_orderstatus").alias("partition"), F.col("o_custkey").alias("identity")))


# --- the whole experiment ----------------------------------------------------------------------


def experiment_faces(s, d) -> DataFrame:
    """A validated run made of events (one a face) and embeddings."""
    v = _vectors(s, d)
    n = v.count()
    e = _events(s, d).withColumns({"k": F.col("event_id") % n, "r": (F.col("us") / 3_600_000_000).cast("int")})
    x = (F.col("value") % 50).cast("double")
    return e.join(v.select("id", F.transform("vector", lambda c: c.cast("double")).alias("embedding")), e.k == F.col("id")).select(
        F.concat(F.lit("f"), F.col("event_id")).alias("face_id"), F.concat(F.lit("v"), F.col("user_id"), F.lit("_"), F.col("r")).alias("source_frame"), F.concat(F.lit("v"), F.col("user_id")).alias("video_name"), F.col("r").alias("frame_number"),
        x.alias("bbox_x1"), x.alias("bbox_y1"), (x + 20 + F.col("event_id") % 60).alias("bbox_x2"), (x + 22 + F.col("event_id") % 60).alias("bbox_y2"), F.lit(640).alias("frame_width"), F.lit(480).alias("frame_height"),
        (0.5 + F.col("event_id") % 50 / 100).alias("det_score"), (F.col("event_id") % 71 - 35).cast("double").alias("pitch"), (F.col("event_id") % 121 - 60).cast("double").alias("yaw"), F.lit(None).cast("double").alias("roll"), (F.col("value") * 2).alias("blur_score"),
        F.lit("").alias("aligned_path"), F.col("event_id").alias("embedding_index"), "embedding", F.xxhash64("id").alias("image_hash"),
    )


@query()
def experiment_run(s, d):
    """The hard-filter experiment over all faces: its metrics document as one row."""
    change = {"policy": config.hard_policy(), "clustering": {"threshold": 0.6}}
    change["policy"]["rules"]["image_unavailable"]["mode"] = "off"
    m = experiment.run_experiment(experiment_faces(s, d), change)["metrics"]
    return m.select("total_faces", "source_images", "accepted_faces", "rejected_faces", "identities", "selected_faces", "selected_identities", "acceptance_rate", F.to_json("reject_counts").alias("reject_counts"), F.to_json("exclusion_counts").alias("exclusion_counts"))


