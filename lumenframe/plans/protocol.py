"""The evaluation protocol: prepare, calibrate, validate, freeze, evaluate. Stage states are JSON documents."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.errors import CacheError, ConfigError
from lumenframe.operators import cluster_metrics, clustering, detection, verification
from lumenframe.plans.config import EVALUATION, canonical_json, fingerprint, merged, require_keys
from lumenframe.plans.staging import Staged
from lumenframe.sources import runs

STAGES = ("prepare", "calibrate", "validate", "freeze", "evaluate")
FROZEN_VERSION = "baseline_frozen_parameters_v1"
FROZEN_KEYS = ("detector_threshold", "cluster_threshold", "verification_threshold")


def human(seconds: float) -> str:
    """12s, 3m 04s, 1h 02m, 2d 03h."""
    s = max(0, int(seconds))
    if s < 60:
        return f"{s}s"
    if s < 3600:
        return f"{s // 60}m {s % 60:02d}s"
    return f"{s // 3600}h {s % 3600 // 60:02d}m" if s < 86400 else f"{s // 86400}d {s % 86400 // 3600:02d}h"


class Progress:
    """An append-only log of a stage's events as JSON lines, at most one per ``interval`` seconds within a phase."""

    def __init__(self, write: Callable[[str], None], stage: str, interval: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.write, self.stage, self.interval, self.clock = write, stage, interval, clock
        self.phase, self.total, self.began, self.last = "", 0, clock(), float("-inf")

    def event(self, kind: str, **more) -> None:
        self.write(json.dumps({"at": dt.datetime.now(dt.UTC).isoformat(), "stage": self.stage, "event": kind, **more}))

    def begin(self, phase: str, total: int) -> None:
        self.phase, self.total, self.began, self.last = phase, total, self.clock(), float("-inf")
        self.event("phase", phase=phase, total=total)

    def update(self, done: int, force: bool = False) -> None:
        now = self.clock()
        if not force and now - self.last < self.interval and done < self.total:
            return
        self.last, spent = now, now - self.began
        rate = done / spent if spent > 0 else 0.0
        eta = (self.total - done) / rate if rate else None
        self.event("progress", phase=self.phase, processed=done, total=self.total, percent=round(100 * done / self.total, 2) if self.total else 100.0, items_per_second=round(rate, 3), eta=human(eta) if eta is not None else None)

    def metric(self, name: str, value) -> None:
        self.event("metric", name=name, value=value)

    def complete(self) -> None:
        self.event("complete", elapsed=human(self.clock() - self.began))


def progress_rollup(events: DataFrame) -> DataFrame:
    """(stage, events, last, processed, total, percent, complete) from an event log."""
    last = F.max_by(F.struct("processed", "total"), F.when(F.col("event") == "progress", F.col("at")))
    out = events.groupBy("stage").agg(F.count("*").alias("events"), F.max("at").alias("last"), last.alias("p"), F.bool_or(F.col("event") == "complete").alias("complete"))
    return out.select("stage", "events", "last", "p.processed", "p.total", (100 * F.col("p.processed") / F.col("p.total")).alias("percent"), "complete")


class Protocol:
    """The five stages over a working folder; a stage runs only after the one before it, on the same configuration."""

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), merged(EVALUATION, config)
        self.mark = fingerprint(self.config, tuple(sorted(self.config)))

    def state(self, stage: str) -> dict:
        try:
            return runs.read_document(self.spark, f"{self.folder}/{stage}.json")
        except CacheError:
            return {"status": "missing"}

    def status(self) -> dict[str, str]:
        return {s: self.state(s)["status"] for s in STAGES}

    def run(self, stage: str, work: Callable[[], dict]) -> dict:
        """The stage's result, made once; a finished stage of the same configuration is read back."""
        if stage not in STAGES:
            raise ConfigError(f"unknown stage {stage}")
        now = self.state(stage)
        if now["status"] == "complete":
            if now["config"] != self.mark:
                raise ConfigError(f"{stage} was made with another configuration")
            return now["result"]
        k = STAGES.index(stage)
        if k and self.state(STAGES[k - 1])["status"] != "complete":
            raise ConfigError(f"{STAGES[k - 1]} must come before {stage}")
        began = time.monotonic()
        try:
            result = work()
        except Exception as error:
            self._write(stage, {"status": "failed", "config": self.mark, "error": f"{type(error).__name__}: {error}"[:2000]})
            raise
        self._write(stage, {"status": "complete", "config": self.mark, "elapsed_seconds": round(time.monotonic() - began, 3), "result": result})
        return result

    def _write(self, stage: str, doc: dict) -> None:
        runs.write_document(self.spark, doc, f"{self.folder}/{stage}.json")

    def preflight(self, inputs: dict[str, str], required: list[str] | None = None, least_free_bytes: int = 0) -> dict:
        """Demands the configuration's keys, that every named input exists, and room in the working folder."""
        require_keys(self.config, required or [])
        missing = sorted(name for name, path in inputs.items() if not runs.exists(self.spark, path))
        if missing:
            raise ConfigError(f"inputs are missing: {', '.join(missing)}")
        free = runs.free_bytes(self.spark, self.folder)
        if free < least_free_bytes:
            raise ConfigError(f"{self.folder} has {free} free bytes, not {least_free_bytes}")
        return {"inputs": len(inputs), "free_bytes": free}

    def prepare(self, tables: dict[str, tuple[DataFrame, int | None]]) -> dict:
        """Counts every table and demands the expected numbers."""

        def work():
            found = {name: df.count() for name, (df, _) in tables.items()}
            for name, (_, want) in tables.items():
                if want is not None and found[name] != want:
                    raise ConfigError(f"{name} has {found[name]} rows, not {want}")
            return found

        return self.run("prepare", work)

    def calibrate(self, predictions: DataFrame, truth: DataFrame, pairs: DataFrame, folds: int = 10, fold_size: int | None = 600) -> dict:
        """The detector's operating point on the training images; the verification threshold by cross-validation."""

        def work():
            curve = detection.detector_curve(predictions, truth, self.config["confidence_thresholds"], self.config["iou"])
            point = detection.operating_point(curve, self.config["precision_target"]).first() or detection.operating_point(curve).first()
            cv = verification.cross_validation_summary(verification.cross_validation(pairs, folds, fold_size)).first()
            return {"detector": point.asDict(), "verification": cv.asDict()}

        return self.run("calibrate", work)

    def validate(self, vectors: DataFrame, truth: DataFrame) -> dict:
        """Clustering scores of every candidate threshold; the best by B-cubed F1 of repeated identities, pair F1, threshold."""

        def work():
            found = []
            sweep = Staged(clustering.component_sweep(vectors, self.config["cluster_candidates"]), "sweep").df
            for t in self.config["cluster_candidates"]:
                rows = sweep.where(F.col("threshold") == t).join(truth, "id").select(F.col("true_label"), F.col("component").alias("predicted"))
                every, multi = (cluster_metrics.clustering_metrics(rows, at_least=k).first().asDict() for k in (1, 2))
                found.append({"threshold": t, "all": every, "multi": multi})
            return {"candidates": found, "best": max(found, key=lambda r: (r["multi"]["bcubed_f1"], r["all"]["pair_f1"], r["threshold"]))["threshold"]}

        return self.run("validate", work)

    def freeze(self) -> dict:
        """The three thresholds, with a digest of their canonical form."""

        def work():
            a, b = self.state("calibrate")["result"], self.state("validate")["result"]
            values = {"schema": FROZEN_VERSION, "detector_threshold": a["detector"]["threshold"], "cluster_threshold": b["best"], "verification_threshold": a["verification"]["verification_threshold"]}
            return check_frozen(values) | {"digest": fingerprint(values, tuple(sorted(values)))}

        return self.run("freeze", work)

    def evaluate(self, work: Callable[[dict], dict]) -> dict:
        """The final measures, with frozen parameters only."""
        return self.run("evaluate", lambda: work(check_frozen(self.state("freeze")["result"])))


def check_frozen(values: dict) -> dict:
    if values.get("schema") != FROZEN_VERSION:
        raise ConfigError("frozen parameters have another schema")
    for key in FROZEN_KEYS:
        if not isinstance(values.get(key), int | float) or isinstance(values[key], bool):
            raise ConfigError(f"frozen parameter {key} is no number")
    return values


def manifest_digest(payload: dict) -> str:
    """The content hash of a manifest: SHA-256 of its canonical JSON without the hash itself."""
    import hashlib

    return hashlib.sha256(canonical_json({k: v for k, v in payload.items() if k != "content_sha256"}).encode()).hexdigest()


def coverage(records: DataFrame) -> dict:
    """processed, selected and embedded counts of records (selected, embedded booleans), checked against each other."""
    row = records.agg(F.count("*").alias("processed"), F.count_if("selected").alias("selected"), F.count_if("embedded").alias("embedded")).first().asDict()
    if not row["embedded"] <= row["selected"] <= row["processed"]:
        raise ConfigError(f"coverage counts contradict each other: {row}")
    return row
