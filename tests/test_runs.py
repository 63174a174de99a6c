"""Sources, experiments, the protocol and streams, end to end on small fixtures."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.errors import CacheError, ConfigError, DataContractError, EvaluationDataError
from lumenframe.plans import config, experiment, protocol
from lumenframe.sources import annotations, runs
from lumenframe.streaming import progress, tracker


def write(path, text):
    path.write_text(text)
    return str(path)


# --- runs --------------------------------------------------------------------------------------


def faces(spark, n=3, **change):
    """A run without pose columns, which it may lack."""
    kind = ", ".join(f"{c} string" for c in "face_id source_frame video_name frame_number face_index bbox_x1 bbox_y1 bbox_x2 bbox_y2 face_width face_height det_score blur_score aligned_path embedding_index".split())
    rows = [(f"f{i}", f"s{i}.jpg", "v", str(i), "0", "0", "0", "10", "12", "10", "12", "0.9", "50", "a.jpg", str(i)) for i in range(n)]
    df = spark.createDataFrame(rows, kind)
    return df.withColumns({k: F.expr(v) for k, v in change.items()})


def vectors(spark, n=3, scale=1.0):
    return spark.createDataFrame([(i, [float(scale) if k == i % 2 else 0.0 for k in range(2)]) for i in range(n)], "embedding_index long, embedding array<float>")


def test_valid_run(spark):
    out = runs.validate_run(faces(spark), vectors(spark))
    assert out.count() == 3 and "embedding" in out.columns
    assert out.where("pitch is null and yaw is null and roll is null").count() == 3  # a run may lack its pose
    assert runs.validate_run(faces(spark, yaw="'12'"), vectors(spark)).where("yaw = '12'").count() == 3


@pytest.mark.parametrize("column", ["face_index", "face_width", "face_height", "blur_score"])
def test_run_without_a_required_column(spark, column):
    with pytest.raises(DataContractError, match=column):
        runs.validate_run(faces(spark).drop(column), vectors(spark))


@pytest.mark.parametrize(
    "change, n, scale, what",
    [
        ({"face_id": "'same'"}, 3, 1, "repeats"), ({"embedding_index": "'1'"}, 3, 1, "permutation"), ({"frame_number": "'-4'"}, 3, 1, "negative"), ({"bbox_x2": "'0'"}, 3, 1, "empty"),
        ({}, 2, 1, "vectors"), ({}, 3, 1.1, "unit"), ({}, 3, float("nan"), "non-finite"),
    ],
)
def test_broken_runs(spark, change, n, scale, what):
    with pytest.raises(DataContractError, match=what):
        runs.validate_run(faces(spark, **change), vectors(spark, n, scale))


def test_empty_and_incomplete_runs(spark):
    with pytest.raises(DataContractError, match="no faces"):
        runs.validate_run(faces(spark, 0), vectors(spark))
    with pytest.raises(DataContractError, match="lack det_score"):
        runs.validate_run(faces(spark).drop("det_score"), vectors(spark))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1), ("b", [], None)], "k string, why array<string>, n int")
    path = runs.write_csv(df, str(tmp_path / "t"), ["k", "why", "n", "none"])
    got = sorted(tuple(r) for r in runs.read_csv(spark, path).collect())
    assert got == [("a", "x;y", "1", ""), ("b", "", "", "")]
    with pytest.raises(DataContractError):
        runs.write_csv(df, str(tmp_path / "t"))
    runs.write_csv(df.limit(1), str(tmp_path / "t"), overwrite=True)
    with pytest.raises(DataContractError):
        runs.read_csv(spark, str(tmp_path / "nothing"))


def test_json_and_npy(spark, tmp_path):
    runs.write_document(spark, {"a": [1, "é"]}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == runs.read_document(spark, str(tmp_path / "d.json")) == {"a": [1, "é"]}
    with pytest.raises(CacheError):
        runs.read_document(spark, str(tmp_path / "no.json"))
    path = runs.write_jsonl(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "l"))
    assert runs.read_jsonl(spark, path, "a string, b int").first()["b"] == 1
    bad = write(tmp_path / "bad.jsonl", '{"a": 1}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        runs.read_jsonl(spark, bad, "a int").collect()
    buf = io.BytesIO()
    np.save(buf, np.arange(6, dtype=np.float32).reshape(3, 2))
    (tmp_path / "m.npy").write_bytes(buf.getvalue())
    assert [list(r["embedding"]) for r in runs.read_npy(spark, str(tmp_path / "m.npy")).orderBy("embedding_index").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_paths(spark):
    rows = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "p string")
    listing = spark.createDataFrame([("/run/a.jpg",), ("/up/a.jpg",), ("/up/b.jpg",)], "path string")
    got = {r["p"]: r["resolved"] for r in runs.resolve_paths(rows, "p", ["/run", "/up"], listing).collect()}
    assert got == {"a.jpg": "/run/a.jpg", "b.jpg": "/up/b.jpg", "c.jpg": None}


# --- annotations -------------------------------------------------------------------------------


def test_boxes(spark, tmp_path):
    text = "a/1.jpg\n2\n1 2 3 4 0 0\n5 5 0 9 0 0\nb/2.jpg\n0\n0 0 0 0 0 0 0 0 0 0\nc/3.jpg\n0\nd/4.jpg\n1\n1 1 1 1\n"
    got = {r["relative_path"]: [tuple(b) for b in r["boxes"]] for r in annotations.read_boxes(spark, write(tmp_path / "b.txt", text)).collect()}
    assert got == {"a/1.jpg": [(1, 2, 4, 6)], "b/2.jpg": [], "c/3.jpg": [], "d/4.jpg": [(1, 1, 2, 2)]}
    with pytest.raises(Exception, match="repeats"):
        annotations.read_boxes(spark, write(tmp_path / "r.txt", "x.jpg\n0\nx.jpg\n0\n")).collect()


def test_pairs(spark, tmp_path):
    lines = ["10 2"]
    for f in range(10):
        lines += [f"P{f} 1 2", f"Q{f} 3 4", f"P{f} 1 Q{f} 2", f"Q{f} 1 P{f} 12"]
    df = annotations.read_pairs(spark, write(tmp_path / "p.txt", "\n".join(lines)), fold_size=4)
    assert df.count() == 40 and df.where("same").count() == 20 and df.where("fold = 9").count() == 4
    assert df.where("right = 'P3/P3_0012.jpg'").first()["left"] == "Q3/Q3_0001.jpg"
    with pytest.raises(EvaluationDataError):
        annotations.read_pairs(spark, write(tmp_path / "q.txt", "\n".join(lines[:-1])), fold_size=4)


def test_identity_records(spark, tmp_path):
    ids, parts = write(tmp_path / "i.txt", "1.jpg 5\n2.jpg 5\n3.jpg 6\n"), write(tmp_path / "p.txt", "1.jpg 0\n2.jpg 0\n3.jpg 2\n")
    box = lambda third: write(tmp_path / "b.txt", f"3\nname x y w h\n1.jpg 1 2 3 4\n2.jpg 0 0 0 0\n{third}\n")
    got = {r["filename"]: r for r in annotations.read_identity_records(spark, ids, parts, box("3.jpg 0 0 5 5")).collect()}
    assert tuple(got["1.jpg"]["bbox"]) == (1, 2, 4, 6) and got["2.jpg"]["bbox"] is None and got["3.jpg"]["partition"] == "test"
    assert annotations.read_identity_records(spark, ids, parts, box("3.jpg 0 0 5 5"), ["train"]).count() == 2
    with pytest.raises(EvaluationDataError):
        annotations.read_identity_records(spark, ids, parts, box("3.jpg 0 0 0 5"))
    with pytest.raises(EvaluationDataError):
        annotations.read_identity_records(spark, ids, write(tmp_path / "p.txt", "1.jpg 0\n2.jpg 1\n3.jpg 2\n"), box("3.jpg 0 0 5 5"))


# --- experiments and protocol ------------------------------------------------------------------


def synthetic(spark, n=120):
    rng = np.random.default_rng(42)
    centres = np.linalg.qr(rng.normal(size=(16, 3)))[0].T
    rows = []
    for i in range(n):
        frame, who = i // 2, (i // 40) if i % 2 else 2
        who = i % 2 if frame < 40 else 2 - i % 2
        v = centres[who] + rng.normal(size=16) * 0.02
        rows.append((f"f{i:03d}", f"s{frame}", "clip", frame, 0.0 + 200 * who, 0.0, 90.0 + 200 * who, 95.0, 0.58 if i % 31 == 0 else 0.93, None, 5.0, 2.0, 12.0 if i % 29 == 0 else 140.0 + 7 * (frame % 17), "", i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(-(2**62), 2**62)), who))
    return spark.createDataFrame(rows, "face_id string, source_frame string, video_name string, frame_number int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, det_score double, pitch double, yaw double, roll double, blur_score double, aligned_path string, embedding_index long, embedding array<double>, image_hash long, who int")


def test_experiment(spark):
    faces = synthetic(spark)
    change = {"policy": config.hard_policy()}
    change["policy"]["rules"]["image_unavailable"]["mode"] = "off"
    change["policy"]["rules"]["pose_unavailable"]["mode"] = "off"
    labels = faces.select("face_id", ((F.col("det_score") >= 0.65) & (F.col("blur_score") >= 20)).alias("positive"), F.col("who").cast("string").alias("identity"))
    out = experiment.run_experiment(faces.drop("who"), change, labels)
    m = out["metrics"].first()
    assert m["total_faces"] == 120 and m["accepted_faces"] + m["rejected_faces"] == 120 and 0 < m["rejected_faces"] < 20
    assert m["classification"]["f1"] == 1.0
    pure = out["faces_clustered"].join(faces.select("face_id", "who"), "face_id").groupBy("cluster_id").agg(F.count_distinct("who").alias("k"))
    assert pure.where("k > 1").count() == 0 and out["clusters"].where("is_unknown = 0").count() == 3
    ranking = out["ranking"]
    assert ranking.count() == 120 and ranking.where("selected").count() == m["selected_faces"]
    assert {r[0] for r in ranking.where("not accepted").select(F.explode("not_selected_reasons")).distinct().collect()} == {"not_selected_by_pipeline"}


def test_feature_cache(spark, tmp_path):
    faces = synthetic(spark, 20).drop("who", "image_hash")
    path = str(tmp_path / "cache")
    assert [experiment.cached_features(faces, path)[1] for _ in range(2)] == [False, True]
    assert not experiment.cached_features(faces, path, {"dark": 20})[1]
    assert not experiment.cached_features(faces.withColumn("det_score", F.lit(0.8)), path, {"dark": 20})[1]
    assert not experiment.cached_features(faces, path, force=True)[1]


def test_store_and_compare(spark, tmp_path):
    folder = str(tmp_path / "x")
    final = experiment.store_experiment(spark, folder, "one", lambda: {"t": spark.range(3)})
    assert spark.read.parquet(f"{final}/t").count() == 3
    with pytest.raises(DataContractError):
        experiment.store_experiment(spark, folder, "one", dict)

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        experiment.store_experiment(spark, folder, "two", broken)
    assert os.path.isdir(f"{folder}/two.failed") and not os.path.exists(f"{folder}/two")
    rows = experiment.compare_experiments(spark, {"a": {"n": 4, "x": {"y": 0.5, "flag": True}, "only": 1}, "b": {"n": 6, "x": {"y": 0.25}}}).collect()
    assert {(r["experiment"], r["metric"]): r["delta"] for r in rows if r["experiment"] == "b"} == {("b", "n"): 2.0, ("b", "x.y"): -0.25}
    with pytest.raises(ConfigError):
        experiment.compare_experiments(spark, {"a": {}})


def test_config_files(tmp_path):
    path = write(tmp_path / "c.json", json.dumps({"clustering": {"threshold": 0.5}, "selection": {"perceptual_hash_size": 4, "duplicate_hamming_threshold": 2}, "paths": {"run_dir": "run", "labels": "l.csv"}}))
    c = config.load_experiment(path, {"labels": "/given.csv"})
    assert c["clustering"] == {"threshold": 0.5, "min_cluster_faces": 3, "corrections": None} and c["selection"]["perceptual_hash_size"] == 4
    assert c["paths"] == {"run_dir": str(tmp_path / "run"), "experiments_dir": str(tmp_path / "run" / "experiments"), "labels": "/given.csv"}
    assert config.fingerprint(c, ("clustering",)) == config.fingerprint({"clustering": {"min_cluster_faces": 3, "threshold": 0.5, "corrections": None}}, ("clustering",))
    for bad in ({"selection": {"hash_size": 8}}, {"run_dir": "run"}, {"policy": {"rules": {"blurry": {"mode": "off"}}}}, {"config_schema_version": "v0"}):
        with pytest.raises(ConfigError):
            config.experiment_config(bad)
    with pytest.raises(ConfigError, match="paths.run_dir"):
        config.load_experiment(write(tmp_path / "d.json", "{}"))
    with pytest.raises(ConfigError, match="b.c"):
        config.require_keys({"a": 1, "b": {}}, ["a", "b.c"])


def test_protocol(spark, tmp_path):
    box = "box struct<x1:double,y1:double,x2:double,y2:double>"
    p = spark.createDataFrame([(1, 0, 0.9, (0.0, 0.0, 9.0, 9.0)), (1, 1, 0.2, (50.0, 50.0, 60.0, 60.0))], f"image long, det int, score double, {box}")
    g = spark.createDataFrame([(1, 0, (0.0, 0.0, 9.0, 9.0))], f"image long, gt int, {box}")
    pairs = spark.createDataFrame([(0.8 if k < 2 else 0.2, k < 2, f) for f in range(10) for k in range(4)], "score double, same boolean, fold int")
    v = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2)]) for i in range(6)], "id long, vector array<double>")
    truth = v.select("id", (F.col("id") % 2).alias("true_label"))
    flow = protocol.Protocol(spark, str(tmp_path / "w"))
    with pytest.raises(ConfigError):
        flow.calibrate(p, g, pairs, fold_size=4)
    with pytest.raises(ConfigError):
        flow.prepare({"pairs": (pairs, 41)})
    assert flow.status()["prepare"] == "failed"
    assert flow.prepare({"pairs": (pairs, 40)}) == {"pairs": 40}
    assert flow.calibrate(p, g, pairs, fold_size=4)["detector"]["precision"] == 1.0
    assert flow.validate(v, truth)["best"] == 0.60
    frozen = flow.freeze()
    assert frozen["verification_threshold"] == 0.8 and len(frozen["digest"]) == 64
    assert flow.evaluate(lambda f: {"t": f["cluster_threshold"]}) == {"t": 0.60} == flow.evaluate(lambda f: {"t": None})
    assert set(flow.status().values()) == {"complete"}
    with pytest.raises(ConfigError):
        protocol.Protocol(spark, str(tmp_path / "w"), {"iou": 0.4}).prepare({})
    with pytest.raises(ConfigError):
        protocol.check_frozen({"schema": protocol.FROZEN_VERSION, "detector_threshold": True})


def test_progress_log(spark):
    lines, now = [], [0.0]
    log = protocol.Progress(lines.append, "prepare", interval=30, clock=lambda: now[0])
    log.begin("scan", 10)
    for k in (1, 2, 4):
        now[0] += 20
        log.update(k)
    log.complete()
    events = [json.loads(x) for x in lines]
    assert [e["event"] for e in events] == ["phase", "progress", "progress", "complete"] and events[2]["percent"] == 40.0
    rolled = protocol.progress_rollup(spark.read.json(spark.sparkContext.parallelize(lines))).first()
    assert (rolled["processed"], rolled["total"], rolled["complete"]) == (4, 10, True)
    assert [protocol.human(s) for s in (5, 65, 3700, 90000)] == ["5s", "1m 05s", "1h 01m", "1d 01h"]


# --- streams -----------------------------------------------------------------------------------


def test_tracker_stream(spark, tmp_path):
    rows = [(f"f{i}", "v", i, 0.0, 0.0, 1.0, 1.0, 0.5, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(8)]
    kind = "face_id string, video_name string, frame_number int, x1 double, y1 double, x2 double, y2 double, quality double, row long, vector array<double>"
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = tracker.track_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(45)
    got = {r["face_id"]: r["local"] for r in spark.table("tracked").collect()}
    assert got == {f"f{i}": i % 2 for i in range(8)}


def test_progress_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:05", "a", 1), ("2024-01-01 00:00:50", "a", 4), ("2024-01-01 00:20:00", "b", 2)], "at string, stage string, processed long").selectExpr("cast(at as timestamp) AS at", "stage", "processed").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, stage string, processed long").parquet(str(tmp_path / "in"))
    q = progress.progress_stream(stream).writeStream.format("memory").outputMode("complete").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["stage"], r["events"], r["processed"]) for r in spark.table("progress").collect()} == {("a", 2, 4), ("b", 1, 2)}
    df, seen = progress.observed_counts(spark.createDataFrame([(True, True), (True, False)], "selected boolean, embedded boolean"))
    df.collect()
    assert seen.get == {"processed": 2, "selected": 2, "embedded": 1}


# --- producer ----------------------------------------------------------------------------------


def test_producer(spark, tmp_path):
    from lumenframe.sources import producer

    def lengths():
        def infer(path, content):
            if content == b"bad":
                raise ValueError("unreadable")
            size = float(len(content))
            return [{"n": len(content), "vector": [size, 1.0]}, {"n": 0, "vector": [0.0, 0.0]}, {"n": -1, "vector": [float("nan"), 1.0]}]

        return infer

    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a.jpg", "four"), ("b.jpg", "bad"), ("c.jpg", "sixsix")):
        (folder / name).write_text(text)
    scan = lambda: spark.read.format("binaryFile").load(str(folder))
    go = lambda mark="m1": producer.produce(scan(), lengths, "n int, vector array<double>", str(tmp_path / "cache"), mark)
    out, stats = go()
    assert stats.first().asDict() == {"items": 3, "cache_hits": 0, "computed": 2, "errors": 1}
    rows = {r["path"].rsplit("/", 1)[1]: r for r in out.collect()}
    assert rows["b.jpg"]["value"] is None and rows["b.jpg"]["error"] == "ValueError: unreadable" and rows["a.jpg"]["value"][0]["n"] == 4
    assert sorted(r["n"] for r in producer.found_rows(out, "vector").collect()) == [4, 6] and producer.found_rows(out).count() == 6
    (folder / "c.jpg").write_text("seven77")
    out, stats = go()
    assert stats.first().asDict() == {"items": 3, "cache_hits": 1, "computed": 1, "errors": 1}
    assert sorted(r["value"][0]["n"] for r in out.where("value is not null").collect()) == [4, 7]
    assert go("m2")[1].first()["cache_hits"] == 0
