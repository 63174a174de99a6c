"""Operators against brute force and fixed cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.errors import ConfigError, DataContractError, EvaluationDataError
from lumenframe.functions import coerce, geometry, images
from lumenframe.operators import cluster_metrics, clustering, detection, graph, policy, quality, reports, sampling, selection, similarity, tracking, verification
from lumenframe.plans import config


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x, extra="", rows=None):
    rows = rows or [()] * len(x)
    return spark.createDataFrame([(i, v.tolist(), *r) for i, (v, r) in enumerate(zip(x, rows, strict=True))], f"id long, vector array<double>{extra}")


# --- coercion and keys -------------------------------------------------------------------------


def test_lenient_casts(spark):
    df = spark.createDataFrame([("12.7",), ("-3.9",), ("nan",), ("inf",), ("",), (None,), ("x",), (" 5 ",)], "v string")
    got = [tuple(r) for r in df.select(coerce.lenient_int("v", -1), coerce.lenient_double("v", 0.5)).collect()]
    assert got == [(12, 12.7), (-3, -3.9), (-1, 0.5), (-1, 0.5), (-1, 0.5), (-1, 0.5), (-1, 0.5), (5, 5.0)]


def test_names(spark):
    df = spark.createDataFrame([("a/clip_frame_000123.jpg",), ("b/photo12x7.png",), ("plain",), ("x/_frame_5.jpg",)], "p string")
    assert [tuple(r[0]) for r in df.select(coerce.frame_name("p")).collect()] == [("clip", 123), ("photo12x7", 7), ("plain", 0), ("_frame_5", 5)]
    two = [r[0] for r in spark.createDataFrame([("a/i.jpg",), ("b/i.jpg",)], "p string").select(coerce.photo_key("p")).collect()]
    assert two[0] != two[1] and two[0].startswith("a_i_") and len(two[0].rsplit("_", 1)[1]) == 10
    s = spark.createDataFrame([("Иван Петров!",), ("???",), ("x" * 90,)], "s string").select(coerce.slug("s"), coerce.safe_id("s")).collect()
    assert s[0][0] == "Иван_Петров" and s[1][0] == "person" and s[1][1] == "video" and len(s[2][0]) == 60 and len(s[2][1]) == 80


# --- policy and quality ------------------------------------------------------------------------

FEATURES = dict(det_score=0.9, min_face_size=100.0, blur_score=100.0, yaw=0.0, pitch=0.0, roll=0.0, pose_available=True, border_margin_relative=0.2, brightness_mean=128.0, dark_fraction=0.0, bright_fraction=0.0, image_available=True)


def features(spark, *changes):
    kind = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in FEATURES.items())
    return spark.createDataFrame([tuple({**FEATURES, **c}.values()) for c in changes], kind)


def decide(spark, change, mode, names=None):
    rules = {k: {**r, "mode": mode if names is None or k in names else "off"} for k, r in config.RULES.items()}
    return policy.apply_policy(features(spark, change), {"version": "t", "rules": rules}).first()


@pytest.mark.parametrize(
    "change, mode, accepted, reject, shadow",
    [
        ({"det_score": 0.2}, "off", True, [], []), ({"det_score": 0.2}, "shadow", True, [], ["low_detection_score"]), ({"det_score": 0.2}, "hard", False, ["low_detection_score"], []),
        ({"det_score": 0.2, "min_face_size": 10.0}, "hard", False, ["low_detection_score", "small_face"], []), ({"det_score": 0.65, "min_face_size": 32.0, "yaw": -55.0}, "hard", True, [], []),
        ({"det_score": None}, "hard", False, ["low_detection_score"], []), ({"yaw": None}, "hard", True, [], []), ({"blur_score": float("nan")}, "hard", False, ["blurred"], []),
        ({"pose_available": False}, "hard", False, ["pose_unavailable"], []), ({"pose_available": None}, "hard", False, ["pose_unavailable"], []),
    ],
)
def test_policy(spark, change, mode, accepted, reject, shadow):
    r = decide(spark, change, mode)
    assert (r["accepted"], r["reject_reasons"], r["shadow_reasons"], r["decision"]) == (accepted, reject, shadow, "accepted" if accepted else "rejected")


def test_policy_validation():
    for bad in ({"mode": "maybe"}, {"operator": "ge"}, {"threshold": float("inf")}, {"threshold": True}, {"missing": "drop"}, {"feature": ""}):
        with pytest.raises(ConfigError):
            config.check_policy({"version": "v", "rules": {"blurred": {**config.RULES["blurred"], **bad}}})
    with pytest.raises(ConfigError):
        config.check_policy({"version": "v", "rules": {"unheard_of": config.RULES["blurred"]}})
    with pytest.raises(ConfigError):
        config.experiment_config({"ranking": {"weights": {"pose_component": 0.5}}})


def test_rating(spark):
    r = quality.rating_components(features(spark, {"det_score": 0.75, "min_face_size": 90.0, "blur_score": 100.0})).first()
    assert r["blur_scale"] == 100 and r["soft_rating"] == pytest.approx(0.30 * 0.5 + 0.25 * 0.5 + 0.25 * 0.5 + 0.20)


def test_feature_projection(spark):
    rows = [("f", "0", "10", "20", "40", "60", "", "", "100", "80", "", "0.9", "", "1", "2"), ("g", "1", "10", "20", "5", "60", "7", "9", "0", "80", "3", "x", "1", "2", "3")]
    kind = ", ".join(f"{c} string" for c in "face_id embedding_index bbox_x1 bbox_y1 bbox_x2 bbox_y2 face_width face_height frame_width frame_height border_margin det_score pitch yaw roll".split())
    a, b = quality.quality_features(spark.createDataFrame(rows, kind).withColumn("video_name", F.lit("v")).withColumn("frame_number", F.lit("2")).withColumn("blur_score", F.lit("5"))).orderBy("face_id").collect()
    assert (a["bbox_width"], a["bbox_height"], a["min_face_size"], a["border_margin"], a["pose_available"]) == (30, 40, 30, 10, False)
    assert a["relative_face_size"] == 30 / 80 and a["border_margin_relative"] == 10 / 80
    assert (b["min_face_size"], b["relative_face_size"], b["det_score"], b["border_margin"], b["pose_available"]) == (7, None, None, 3, True)


def test_images():
    flat = np.full((20, 20), 5.0)
    board = np.indices((20, 20)).sum(0) % 2 * 255.0
    assert images.laplacian_variance(flat) == 0 < images.laplacian_variance(board) and images.laplacian_variance(flat[:2]) == 0
    assert images.average_hash(board) == images.average_hash(board.copy())
    with pytest.raises(ConfigError):
        images.image_features(200, 100)


def test_reports(spark):
    rows = spark.createDataFrame([("tp", True), ("fp", True), ("fn", False), ("tn", False), ("none", True)], "face_id string, accepted boolean")
    labels = reports.load_labels(spark.createDataFrame([("tp", "yes"), ("fp", "0"), ("fn", "1"), ("tn", "no"), ("lost", "true"), ("", "1")], "face_id string, is_acceptable string"))
    r = reports.classification_report(rows, labels).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["labelled"], r["unlabelled"], r["orphans"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 1, 4, 1, 1, 0.5, 0.5, 0.5)
    assert reports.classification_report(rows, labels.limit(0)).first()["f1"] is None
    noise = reports.load_labels(spark.createDataFrame([("a", 1), ("b", 0)], "face_id string, is_noise int")).orderBy("face_id").collect()
    assert [x["positive"] for x in noise] == [False, True]
    with pytest.raises(DataContractError):
        reports.load_labels(spark.createDataFrame([("a", 1), ("a", 0)], "face_id string, is_noise int"))
    sets = spark.createDataFrame([(["b", "a", "c"],), (["a", "b"],), (["c"],), ([],)], "reject_reasons array<string>")
    assert {r["reasons"]: r["n"] for r in reports.reason_intersections(sets).collect()} == {"a&b": 2, "a&c": 1, "b&c": 1, "a&b&c": 1}


# --- graph and clusters ------------------------------------------------------------------------


def brute_components(n, edges):
    c = list(range(n))
    for a, b in edges:
        x, y = c[a], c[b]
        c = [min(x, y) if v in (x, y) else v for v in c]
    return c


@pytest.mark.parametrize("seed, n, m", [(0, 40, 30), (1, 60, 58), (2, 30, 0), (3, 50, 200)])
def test_connected_components(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    got = {x["id"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute_components(n, edges)
    assert got == {v: want[v] for e in edges for v in e}


def test_path_graph(spark):
    edges = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert {r["component"] for r in graph.connected_components(edges).collect()} == {0}


def brute_constrained(x, spans, t):
    """The definition, on sets: pairs by similarity; merge unless banned or too far."""
    s, groups = x @ x.T, [{i} for i in range(len(x))]
    meets = lambda a, b: spans[a][0] == spans[b][0] and max(spans[a][1], spans[b][1]) <= min(spans[a][2], spans[b][2])
    for i, j in sorted((p for p in itertools.combinations(range(len(x)), 2) if s[p] >= t), key=lambda p: (-s[p], p)):
        a, b = (next(g for g in groups if k in g) for k in (i, j))
        if a is not b and not any(meets(p, q) for p in a for q in b) and min(s[p, q] for p in a for q in b) >= t:
            groups.remove(b)
            a |= b
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize("seed, t", [(0, 0.2), (1, 0.4), (2, 0.0)])
def test_constrained_clusters(spark, seed, t):
    rng = np.random.default_rng(seed)
    x = unit(rng, 40, 5)
    spans = [(f"v{rng.integers(4)}", int(s), int(s + rng.integers(1, 9))) for s in rng.integers(0, 30, 40)]
    got = {r["id"]: r["group"] for r in clustering.constrained_clusters(frame(spark, x, ", video_name string, start_frame int, end_frame int", spans), t).collect()}
    assert got == brute_constrained(x, spans, t)


def test_overlapping_tracks_stay_apart(spark):
    x = np.array([[1.0, 0.0]] * 2)
    got = clustering.constrained_clusters(frame(spark, x, ", video_name string, start_frame int, end_frame int", [("v", 10, 20), ("v", 15, 25)]), 0.45)
    assert got.select("group").distinct().count() == 2


def test_manual_labels(spark):
    tracks = spark.createDataFrame([(0, "t0", "v", 0, 5), (1, "t1", "v", 9, 12), (2, "t2", "v", 3, 6)], "id long, track_id string, video_name string, start_frame int, end_frame int")
    groups = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id long, group long")
    fix = lambda *rows: spark.createDataFrame(rows, "track_id string, identity_label string")
    got = {r["id"]: (r["group"], r["label"]) for r in clustering.manual_labels(groups, tracks, fix(("t0", " Ann "), ("t1", "Ann"), ("t2", " "))).collect()}
    assert got == {0: (0, "Ann"), 1: (0, "Ann"), 2: (2, None)}
    for bad in (fix(("zz", "Ann")), fix(("t0", "Ann"), ("t2", "Ann"))):
        with pytest.raises(DataContractError):
            clustering.manual_labels(groups, tracks, bad)
    with pytest.raises(DataContractError):
        clustering.manual_labels(groups.withColumn("group", F.lit(0).cast("long")), tracks, fix(("t0", "Ann"), ("t1", "Bob")))


def test_cluster_scores(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("c", 1)], "true_label string, predicted int")
    r = cluster_metrics.clustering_metrics(rows).first()
    assert r["pair_recall"] == 1 and r["pair_precision"] == pytest.approx(1 / 3) and r["fragmented_identity_fraction"] == 0 and r["wrongly_merged_identity_fraction"] == pytest.approx(2 / 3)
    assert cluster_metrics.clustering_metrics(rows, at_least=2).first()["pair_f1"] == 1
    assert set(cluster_metrics.clustering_metrics(rows.limit(0)).first().asDict().values()) == {0}


def test_similarity_blocks(spark):
    x = unit(np.random.default_rng(6), 60, 8)
    s = x @ x.T
    df = frame(spark, x)

    def kernel(a, p, b, q, same):
        return {"n": [len(a) * len(b)]}

    assert sum(r["n"] for r in similarity.block_pairs(df, kernel, "n long", every=True, block=17).collect()) == 3600
    got = {(r["src"], r["dst"]) for r in similarity.threshold_edges(df, 0.3).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(60), 2) if s[i, j] >= 0.3}
    np.fill_diagonal(s, -9)
    assert {r["id"]: r["neighbor"] for r in similarity.nearest(df).collect()} == dict(enumerate(s.argmax(1).tolist()))
    sample, mode = similarity.pair_similarities(df, max_pairs=100)
    assert mode == "sampled" and sample.count() == 100


# --- tracking and selection --------------------------------------------------------------------


def brute_assign(cost):
    n, m = cost.shape
    if n > m:
        return brute_assign(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for k in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 4, (n, m)).astype(float) + (k % 2) * rng.random((n, m))
        r, c = tracking.assign(cost)
        assert len(r) == min(n, m) == len(set(c.tolist())) and cost[r, c].sum() == pytest.approx(brute_assign(cost))


def brute_tracks(rows, gap, least, share, offset):
    """One dict a track, one Hungarian problem a frame, solved by permutation."""
    out, tracks, active = {}, 0, []
    for frame_no in sorted({r["frame"] for r in rows}):
        now = [r for r in rows if r["frame"] == frame_no]
        active = [t for t in active if frame_no - t["last"] <= gap]
        score = np.full((len(active), len(now)), -1e6)
        for i, t in enumerate(active):
            c = t["sum"] / np.linalg.norm(t["sum"])
            for j, r in enumerate(now):
                if c @ r["v"] >= least:
                    score[i, j] = share * (c @ r["v"]) - 0.01 * max(0, frame_no - t["last"] - 1)
        best = None
        n, m = score.shape
        options = itertools.permutations(range(m), n) if n <= m else itertools.permutations(range(n), m)
        for p in options if n and m else ():
            pairs = list(enumerate(p)) if n <= m else [(i, j) for j, i in enumerate(p)]
            total = sum(score[a, b] for a, b in pairs)
            best = (total, pairs) if best is None or total > best[0] + 1e-12 else best
        used = set()
        for i, j in best[1] if best else ():
            if score[i, j] > -1e5:
                t, r = active[i], now[j]
                t["sum"], t["last"] = t["sum"] + (offset + r["q"]) * r["v"], frame_no
                out[r["id"]] = t["no"]
                used.add(j)
        for j, r in enumerate(now):
            if j not in used:
                active.append({"no": tracks, "sum": (offset + r["q"]) * r["v"], "last": frame_no})
                out[r["id"]] = tracks
                tracks += 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_tracking(spark, seed):
    rng = np.random.default_rng(seed)
    people, rows = unit(rng, 3, 6), []
    for f in sorted(rng.choice(60, 25, replace=False).tolist()):
        for _ in range(rng.integers(1, 4)):
            v = people[rng.integers(3)] + rng.normal(size=6) * 0.25
            rows.append({"id": f"f{len(rows)}", "frame": f, "v": v / np.linalg.norm(v), "q": float(rng.random())})
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    df = spark.createDataFrame([(r["id"], video, r["frame"], (9.0 * i, 0.0, 9.0 * i + 1, 1.0), r["q"], i, r["v"].tolist()) for video in ("b", "a") for i, r in enumerate(rows)], f"face_id string, video_name string, frame_number int, box {box}, quality_score double, row long, vector array<double>")
    found = tracking.number_tracks(tracking.assign_tracks(df, max_frame_gap=4, min_similarity=0.6)).collect()
    want = brute_tracks(rows, 4, 0.6, 0.85, 0.5)
    n = max(want.values()) + 1
    assert {r["face_id"]: r["track_embedding_index"] for r in found if r["video_name"] == "a"} == want
    assert {r["face_id"]: r["track_embedding_index"] - n for r in found if r["video_name"] == "b"} == want
    rolled = tracking.track_rollup(tracking.number_tracks(tracking.assign_tracks(df, max_frame_gap=4, min_similarity=0.6)))
    assert rolled.agg(F.sum("num_faces")).first()[0] == 2 * len(rows) and rolled.where("track_id = 'track_00000' and video_name = 'a'").count() == 1


def brute_select(rows, o):
    """The definition, pair by pair."""
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    chosen, rest, value = [], [r for r in rows if r["hash"] is not None], {}
    near = lambda r: any(c["video"] == r["video"] and abs(c["frame"] - r["frame"]) < o["min_frame_gap"] for c in chosen)
    while rest and len(chosen) < o["max_per_identity"]:
        best = None
        for r in rest:
            v = r["q"]
            if chosen:
                h, p = min(bits(r["hash"], c["hash"]) for c in chosen), min(abs(r["yaw"] - c["yaw"]) for c in chosen)
                if h <= o["duplicate_hamming_threshold"] or near(r):
                    continue
                t = min(abs(r["frame"] - c["frame"]) if r["video"] == c["video"] else 100 for c in chosen)
                v = 0.65 * r["q"] + 0.2 * h / 64 + 0.1 * min(p / 60, 1) + 0.05 * min(t / 100, 1)
            if best is None or v > best[0]:
                best = (v, r)
        if best is None:
            break
        value[best[1]["id"]] = best[0]
        chosen.append(best[1])
        rest.remove(best[1])
    why = {}
    for r in rows:
        if r["id"] in value:
            why[r["id"]] = []
        elif r["hash"] is None:
            why[r["id"]] = ["missing_image"]
        else:
            w = ["duplicate"] * any(bits(r["hash"], c["hash"]) <= o["duplicate_hamming_threshold"] for c in chosen) + ["temporal_proximity"] * near(r)
            why[r["id"]] = w or ["capacity_limit" if len(chosen) >= o["max_per_identity"] else "lower_ranking"]
    return [c["id"] for c in chosen], value, why


def test_selection(spark):
    r, o = random.Random(3), {"max_per_identity": 6, "duplicate_hamming_threshold": 22, "min_frame_gap": 8}
    groups = {c: [{"id": f"{c}{i}", "video": r.choice("uv"), "frame": r.randrange(120), "yaw": r.uniform(-60, 60), "q": round(r.random(), 2), "hash": None if i == 5 else r.getrandbits(64) - 2**63} for i in range(n)] for c, n in (("a", 40), ("b", 3), ("c", 12))}
    rows = [(c, x["id"], x["video"], x["frame"], x["yaw"], x["q"], x["hash"], i) for c, xs in groups.items() for i, x in enumerate(xs)]
    got = selection.diverse_topk(spark.createDataFrame(rows, "cluster_id string, face_id string, video_name string, frame_number int, yaw double, quality_score double, image_hash long, row long"), o).collect()
    for c, xs in groups.items():
        chosen, value, why = brute_select(xs, o)
        mine = {g["face_id"]: g for g in got if g["cluster_id"] == c}
        assert [g for g, _ in sorted(((g, x["rank"]) for g, x in mine.items() if x["selected"]), key=lambda p: p[1])] == chosen
        assert all(mine[k]["selection_value"] == pytest.approx(v) for k, v in value.items()) and {k: x["not_selected_reasons"] for k, x in mine.items()} == why


# --- verification and detection ----------------------------------------------------------------


def test_fold_threshold_ignores_its_own_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(0.8 if k < 5 else 0.2, k < 5, f) for f in range(10) for k in range(10)]
    odd = [(float(rng.uniform(-100, 100)), s, f) if f == 0 else (x, s, f) for x, s, f in rows]
    make = lambda r: verification.cross_validation(spark.createDataFrame(r, "score double, same boolean, fold int"), fold_size=10)
    a, b = ({r["fold"]: r for r in make(x).collect()} for x in (rows, odd))
    assert a[0]["threshold"] == b[0]["threshold"] == 0.8 and a[3]["accuracy"] == 1
    assert verification.cross_validation_summary(make(rows)).first()["accuracy_std"] == 0
    with pytest.raises(EvaluationDataError):
        make(rows[1:])


def test_sweep_brute(spark):
    r = random.Random(4)
    rows = [(r.randrange(12) / 10, r.random() < 0.4) for _ in range(80)]
    got = {x["threshold"]: (x["tp"], x["fp"], x["fn"], x["tn"]) for x in verification.threshold_sweep(spark.createDataFrame(rows, "score double, same boolean")).collect()}
    for t in [float("inf"), *{s for s, _ in rows}, float("-inf")]:
        assert got[t] == tuple(sum(1 for s, y in rows if (y, s >= t) == w) for w in ((True, True), (False, True), (True, False), (False, False)))
    assert len(got) == len({s for s, _ in rows}) + 2


def boxes(spark, rows, kind):
    return spark.createDataFrame(rows, f"image long, {kind}, box struct<x1:double,y1:double,x2:double,y2:double>")


def iou1(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    i = max(0, w) * max(0, h)
    return i / ((a[2] - a[0] + 1) * (a[3] - a[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - i)


def test_detector_curve_and_ap(spark):
    r = random.Random(8)
    box = lambda: (lambda x, y: (x, y, x + r.randrange(5, 12), y + r.randrange(5, 12)))(float(r.randrange(12)), float(r.randrange(12)))
    truth = {i: [box() for _ in range(r.randrange(4))] for i in range(12)}
    found = {i: [(round(r.random(), 3), box()) for _ in range(r.randrange(6))] for i in range(12)}
    keep = {(i, k) for i, bs in truth.items() for k in range(len(bs)) if r.random() < 0.7}
    p = boxes(spark, [(i, k, s, b) for i, ds in found.items() for k, (s, b) in enumerate(ds)], "det int, score double")
    g = boxes(spark, [(i, k, b) for i, bs in truth.items() for k, b in enumerate(bs)], "gt int")
    for row in detection.detector_curve(p, g, [0.1, 0.5, 0.8]).collect():
        tp = fp = 0
        for i in truth:
            free = set(range(len(truth[i])))
            for s, b in sorted(found[i], reverse=True):
                if s >= row["threshold"]:
                    hit = max((k for k in free if iou1(b, truth[i][k]) >= 0.5), key=lambda k: (iou1(b, truth[i][k]), k), default=None)
                    tp, fp = tp + (hit is not None), fp + (hit is None)
                    free.discard(hit)
        assert (row["tp"], row["fp"], row["fn"]) == (tp, fp, sum(map(len, truth.values())) - tp)
    every = [s for ds in found.values() for s, _ in ds]
    lo, hi = min(every), max(every)
    counts = np.zeros((1000, 2))
    for i in truth:
        got, prop, run = set(), [], []
        order = sorted(found[i], key=lambda d: -d[0])
        for _, b in order:
            v = [iou1(b, t) for t in truth[i]]
            k = int(np.argmax(v)) if v else None
            ok = True
            if k is not None and v[k] >= 0.5:
                ok = (i, k) in keep
                got |= {k} if ok else set()
            prop.append(ok)
            run.append(len(got))
        for c in range(1000):
            last = sum((s - lo) / (hi - lo) >= 1 - (c + 1) / 1000 for s, _ in order)
            if last:
                counts[c] += (sum(prop[:last]), run[last - 1])
    precision = np.divide(counts[:, 1], counts[:, 0], out=np.zeros(1000), where=counts[:, 0] > 0)
    recall, env = counts[:, 1] / max(1, len(keep)), np.maximum.accumulate(precision[::-1])[::-1]
    kept = spark.createDataFrame(sorted(keep), "image long, gt int")
    assert detection.average_precision(p, g, kept).first()["ap"] == pytest.approx(float((np.diff(recall, prepend=0) * env).sum()))


def test_detection_literals(spark):
    p = boxes(spark, [(1, 0, 0.1, (20.0, 20.0, 30.0, 30.0)), (1, 1, 0.9, (0.0, 0.0, 9.0, 9.0))], "det int, score double")
    g = boxes(spark, [(1, 0, (0.0, 0.0, 9.0, 9.0))], "gt int")
    row = detection.detector_curve(p, g, [0.5]).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 0, 0)
    assert detection.average_precision(p, g, g.select("image", "gt")).first()["ap"] == 1.0
    m = boxes(spark, [(1, 0, 0.99, (50.0, 50.0, 90.0, 90.0)), (1, 1, 0.8, (1.0, 1.0, 11.0, 11.0))], "det int, score double")
    assert detection.main_box(m, g).first()["det"] == 1 and detection.main_box(m.where("det = 0"), g).count() == 0


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 3.0, 2.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    r = df.select(geometry.iou("a", "b").alias("c"), geometry.iou("a", "b", True).alias("d")).first()
    assert r["c"] == pytest.approx(2 / 6) and r["d"] == pytest.approx(6 / 12)


# --- sampling ----------------------------------------------------------------------------------


def test_sampling(spark):
    rows = spark.range(200).selectExpr("id", "id % 4 AS g")
    a, b = (sampling.hash_sample(x, ["id"], 20).collect() for x in (rows, rows.orderBy(F.desc("id"))))
    assert a == b and len(a) == 20
    assert sampling.stratified_sample(rows, ["g"], ["id"], 5).groupBy("g").count().where("count = 5").count() == 4
    with pytest.raises(EvaluationDataError):
        sampling.stratified_sample(rows, ["g"], ["id"], 51, demand=True)
    groups = spark.createDataFrame([(i, s) for i, s in enumerate([5, 9, 3, 7, 1, 4, 30])], "k long, n long")
    got = sampling.whole_group_fit(groups, "k", "n", 12).collect()
    order = [r["k"] for r in groups.orderBy(sampling.hash_key("k")).collect()]
    held, want = 0, []
    for k in order:
        n = [5, 9, 3, 7, 1, 4, 30][k]
        if held + n <= 12:
            want.append(k)
            held += n
    assert [r["k"] for r in got] == want
    with pytest.raises(EvaluationDataError):
        sampling.assert_disjoint(spark.createDataFrame([(1, "a"), (1, "b")], "who int, part string"), "who", "part")
    assert [r["id"] for r in sampling.every_kth(rows, [F.col("id").asc()], 7, 3).orderBy("id").collect()] == [0, 7, 14]


# --- known identities and diagnostics ----------------------------------------------------------


@pytest.fixture(scope="module")
def synthetic(spark):
    from lumenframe.plans.staging import Staged
    from lumenframe.sources import runs
    from lumenframe.sources.synthetic import synthetic_run

    faces, vectors, truth = synthetic_run(spark)
    return Staged(runs.validate_run(faces, vectors), "synthetic").df, truth


def test_synthetic_gate(spark, synthetic):
    """The whole experiment over known identities: one cluster a person, pair F1 above the gate; seven faces go by the hard policy."""
    from lumenframe.operators import evaluation
    from lumenframe.plans import experiment

    run, truth = synthetic
    assert run.count() == 144 and truth.where("is_noise = 1").count() == 3
    change = {"policy": config.hard_policy()}
    change["policy"]["rules"]["image_unavailable"]["mode"] = "off"
    labels = reports.load_labels(truth)
    out = experiment.run_experiment(run, change, labels=labels)
    m = out["metrics"].first()
    assert m["rejected_faces"] == 7 and m["classification"]["f1"] == 1.0
    assert m["identity_source"] == "labels_and_clusters" and m["counts_before"]["alice"] == 90 and m["counts_after"]["noise"] == 0
    gate = evaluation.identity_gate(truth.join(out["faces_clustered"].select("face_id"), "face_id", "left_semi"), out["faces_clustered"]).first()
    assert gate["passed"] and gate["pair_f1"] >= evaluation.GATE and gate["persons"] == 3
    clusters = {r["true_person"]: r["clusters"] for r in evaluation.person_clusters(truth, out["faces_clustered"]).collect()}
    assert all(len(c) == 1 for c in clusters.values())


def test_diagnostics(spark, synthetic):
    from lumenframe.operators import diagnostics

    out = diagnostics.run_diagnostics(synthetic[0])
    s = out["summary"].first()
    assert (s["faces"], s["embedding_dimension"], s["pair_statistics_mode"], s["threshold_sweep_mode"]) == (144, 512, "exact", "exact")
    x = np.array([r["embedding"] for r in synthetic[0].orderBy("embedding_index").select("embedding").collect()], float)
    sims = (x @ x.T)[np.triu_indices(144, 1)]
    assert s["max"] == pytest.approx(sims.max(), abs=1e-5) and s["q50"] == pytest.approx(np.quantile(sims, 0.5), abs=1e-5)
    frames = Counter(r["frame_number"] for r in synthetic[0].select("frame_number").collect())
    assert s["same_frame_pairs"] == sum(n * (n - 1) // 2 for n in frames.values()) == out["same_frame_pairs"].count()
    assert s["suspicious_faces"] == 7 and out["nearest_neighbors"].count() == 144 and out["threshold_sweep"].count() == 8
    assert sum(r["n"] for r in out["similarity_histogram"].collect()) == 144 * 143 // 2 and out["contact_sheets"].agg({"page": "max"}).first()[0] == 1


def test_evaluation_bundles(spark):
    from lumenframe.operators import evaluation

    images = spark.createDataFrame([(1, None), (2, None), (3, "unreadable")], "image long, error string")
    found = spark.createDataFrame([(1, 0), (1, 1)], "image long, det int")
    c = evaluation.prediction_coverage(images, found).first()
    assert (c["images"], c["processed"], c["errors"], c["detections"], c["images_with_detections"]) == (3, 2, 1, 2, 1) and c["coverage"] == pytest.approx(2 / 3)
    pairs = spark.createDataFrame([("b", "a", True, 0, 0.9), ("a", "c", False, 1, None), (None, "c", False, 1, 0.1)], "left string, right string, same boolean, fold int, score double")
    assert [r["path"] for r in evaluation.pair_images(pairs).collect()] == ["a", "b", "c"]
    assert [(r["predicted"], r["correct"]) for r in evaluation.pair_predictions(pairs, 0.5).collect()] == [(True, True), (None, None), (False, True)]
    box = "box struct<x1:double,y1:double,x2:double,y2:double>"
    p = spark.createDataFrame([(1, 0, 0.9, (0.0, 0.0, 9.0, 9.0)), (1, 1, 0.2, (50.0, 50.0, 60.0, 60.0))], f"image long, det int, score double, {box}")
    g = spark.createDataFrame([(1, 0, True, (0.0, 0.0, 9.0, 9.0))], f"image long, gt int, kept boolean, {box}")
    b = evaluation.detector_bundle(p, g, {"easy": g.select("image", "gt"), "hard": g.select("image", "gt")}, 0.5).first()
    assert b["operating_point"]["tp"] == 1 and b["ap_easy"] == b["ap_hard"] == pytest.approx(1.0, abs=2e-3)
    with pytest.raises(EvaluationDataError):
        evaluation.identity_gate(spark.createDataFrame([("f", "p", 0)], "face_id string, true_person string, is_noise int"), spark.createDataFrame([], "face_id string, cluster_id string"))


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    from lumenframe.operators import graph

    r = random.Random(8)
    edges = spark.createDataFrame([(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(7, 7), (None, 3)], "src long, dst long")
    one = sorted(map(tuple, graph.connected_components(edges).collect()))
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert sorted(map(tuple, graph.connected_components(edges).collect())) == one


def test_preflight(spark, tmp_path):
    from lumenframe.plans import protocol

    (tmp_path / "there").write_text("x")
    run = protocol.Protocol(spark, str(tmp_path / "work"))
    assert run.preflight({"a": str(tmp_path / "there")}, ["iou", "fars"])["inputs"] == 1
    for inputs, need, free in (({"b": str(tmp_path / "gone")}, [], 0), ({}, ["nothing.here"], 0), ({}, [], 1 << 62)):
        with pytest.raises(ConfigError):
            run.preflight(inputs, need, free)


def test_exact_quantile(spark, monkeypatch):
    from lumenframe.plans import quantile

    rng = np.random.default_rng(2)
    for values in (rng.normal(size=501), np.round(rng.exponential(size=400), 1), np.full(30, 2.5), np.array([7.0]), np.array([1.0, 2.0]), np.concatenate([np.zeros(300), rng.normal(size=7) * 1e6])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        for few in (100_000, 5):
            monkeypatch.setattr(quantile, "FEW", few)
            for p in (0.0, 0.31, 0.5, 0.95, 1.0):
                assert quantile.exact_quantile(df, F.col("x"), p) == pytest.approx(np.quantile(values, p))
    assert quantile.exact_quantile(df.limit(0), F.col("x"), 0.5) is None


def test_sparse_merges_equal_dense(spark):
    rng = np.random.default_rng(9)
    for n, d in ((60, 3), (200, 4), (90, 2)):
        x = unit(rng, n, d)
        video, start = rng.integers(0, 6, n), rng.integers(0, 50, n)
        end = start + rng.integers(0, 6, n)
        apart = (video[:, None] == video[None]) & (np.maximum(start[:, None], start[None]) <= np.minimum(end[:, None], end[None]))
        np.fill_diagonal(apart, False)
        assert (clustering.merge_sparsely(x, video, start, end, 0.6) == clustering.merge_greedily(x @ x.T, apart, 0.6)).all()


def test_tracks_stream_over_batches(spark):
    """A segment far longer than a batch is tracked as in one piece."""
    rng = np.random.default_rng(4)
    x = unit(rng, 5, 6)
    rows = []
    for frame in range(300):
        for k in range(5):
            v = x[k] + rng.normal(size=6) * 0.05
            rows.append((f"f{frame}_{k}", "v", frame, (10.0 * k, 0.0, 10.0 * k + 8, 8.0), 0.5, 5 * frame + k, (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "face_id string, video_name string, frame_number int, box struct<x1:double,y1:double,x2:double,y2:double>, quality_score double, row long, vector array<double>")
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    for size in ("10000", "7"):
        spark.conf.set(name, size)
        found[size] = sorted(map(tuple, tracking.assign_tracks(df).drop("vector").collect()))
    spark.conf.set(name, before)
    assert found["7"] == found["10000"] and {r[3] for r in found["7"]} == set(range(5))


def test_large_clusters_choose_alike(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b"]), f"f{i}", r.choice(["v", "w"]), r.randrange(200), r.uniform(-60, 60), round(r.random(), 2), None if r.random() < 0.1 else r.getrandbits(60), i) for i in range(160)] + [("c", "g", "v", None, None, None, 5, 900)]
    df = spark.createDataFrame(rows, "cluster_id string, face_id string, video_name string, frame_number int, yaw double, quality_score double, image_hash long, row long")
    for o in ({"max_per_identity": 5, "duplicate_hamming_threshold": 24}, {"max_per_identity": 4, "minimum_pose_distance": 3.0, "min_frame_gap": 20}):
        few, rounds = ({x["face_id"]: x.asDict() for x in selection.diverse_topk(df, o, n).collect()} for n in (1000, 10))
        assert set(few) == set(rounds)
        for k, a in few.items():
            b = rounds[k]
            assert (a["selected"], a["rank"], a["not_selected_reasons"], a["selection_decision"]) == (b["selected"], b["rank"], b["not_selected_reasons"], b["selection_decision"])
            assert a["selection_value"] == pytest.approx(b["selection_value"]) if a["selected"] else b["selection_value"] is None


def test_pair_quantiles_never_gather_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[40:60] = x[0]  # one similarity stands often
    x[70] *= 1e6  # nearly all pairs fall into few ranges
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    v = np.sort((x @ x.T)[np.triu_indices(90, 1)])
    for few in (5, 100_000):
        got = similarity.pair_quantiles(rows, few=few).first()
        np.testing.assert_allclose(got, [v[0], *np.quantile(v, [0.5, 0.95, 0.99]), v[-1]], rtol=1e-9, atol=1e-9)
    assert similarity.pair_quantiles(rows.limit(1)).first()["q50"] is None
    two = similarity.pair_quantiles(rows.where("id < 2")).first()
    np.testing.assert_allclose(two, [x[0] @ x[1]] * 5)


def test_blocks_meet_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    monkeypatch.setattr(similarity, "TILE", 100)
    got = {(r["src"], r["dst"]) for r in similarity.threshold_edges(rows, 0.5).collect()}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if x[i] @ x[j] >= 0.5}
    near = {r["id"]: r["neighbor"] for r in similarity.nearest(rows).collect()}
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    assert near == dict(enumerate(sim.argmax(1).tolist()))


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.6, 0.999999])
def test_threshold_components_of_repeated_vectors(spark, threshold):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 5))
    x = np.concatenate([np.repeat(x, 10, 0), x + rng.normal(size=x.shape) * 1e-7, np.zeros((3, 5)), rng.normal(size=(20, 5)) * 0.2])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x[:132] /= size[:132]
    x[140] = 0.6 * x[0] / (x[0] @ x[0]) * (1 + 1e-9)  # at the threshold
    x[141] = 0.6 * x[10] / (x[10] @ x[10]) * (1 - 1e-9)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    want = list(range(len(x)))
    sim = x @ x.T
    for _ in want:
        want = [min(want[j] for j in range(len(x)) if j == i or sim[i, j] >= threshold) for i in range(len(x))]
    got = {r["id"]: r["component"] for r in clustering.threshold_components(rows, threshold).collect()}
    assert got == dict(enumerate(want))


def test_repeated_vectors_make_few_edges(spark, monkeypatch):
    seen = []
    held = clustering.threshold_edges
    monkeypatch.setattr(clustering, "threshold_edges", lambda v, t: (seen.append(v.count()), held(v, t))[1])
    tracks = spark.range(600).selectExpr("id", "concat('v', id) video_name", "0 start_frame", "1 end_frame", "if(id % 2 = 0, array(1D, 0D), array(0D, 1D)) vector")
    groups = clustering.constrained_clusters(tracks, 0.6)
    assert {(r["group"], r["n"]) for r in groups.groupBy("group").agg(F.count("*").alias("n")).collect()} == {(0, 300), (1, 300)}
    assert seen == [2]


def test_large_components_need_no_matrix(spark, monkeypatch):
    """Tracks of few vectors are merged without a list of all their pairs, to the result of the matrix."""
    import tracemalloc

    rng = np.random.default_rng(8)
    for d, n in ((6, 3000), (4, 400)):
        x = unit(rng, 30, d) + np.eye(d)[0]
        kind = np.sort(np.concatenate([np.arange(30), rng.integers(0, 30, n - 30)]))
        video, start = rng.integers(0, n // 4, n), rng.integers(0, 50, n)
        end = start + rng.integers(0, 6, n)
        apart = (video[:, None] == video[None]) & (np.maximum(start[:, None], start[None]) <= np.minimum(end[:, None], end[None]))
        np.fill_diagonal(apart, False)
        want = clustering.merge_greedily((x @ x.T)[kind[:, None], kind[None]], apart, 0.6)
        tracemalloc.start()
        got = clustering.merge_sparsely(x, video, start, end, 0.6, kind)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert (got == want).all() and peak < 20
        for pairs in (1, 40):
            monkeypatch.setattr(clustering, "PAIRS", pairs)
            assert (clustering.merge_sparsely(x, video, start, end, 0.6, kind) == want).all()
        monkeypatch.undo()


def test_components_above_the_matrix_bound(spark):
    """The same groups by matrix and by bands; equal vectors go out once."""
    rng = np.random.default_rng(3)
    x = np.repeat(unit(rng, 15, 3), 8, 0)
    spans = [(f"v{rng.integers(9)}", int(s), int(s + rng.integers(1, 4))) for s in rng.integers(0, 30, len(x))]
    tracks = frame(spark, x, ", video_name string, start_frame int, end_frame int", spans)
    got = [{r["id"]: r["group"] for r in clustering.constrained_clusters(tracks, 0.3, dense).collect()} for dense in (1000, 5)]
    assert got[0] == got[1] and len(set(got[0].values())) < len(x)


def test_vector_sums_take_their_norm_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0])], "k long, vector array<double>")
    out = similarity.vector_sum(rows, ["k"], "vector")
    assert out.first()["centroid"] == pytest.approx([0.6, 0.8])
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
