"""Quality scores from supervised subword embeddings, trained by numpy stochastic gradient descent.

A word's vector is the mean of its learned features: the hashed word and its hashed 3- to 5-byte grams
inside ``<word>``, over the whole word however long; a word that repeats the one before it counts as the word "repeat". A document's vector is the mean over its words; a softmax over two outputs gives the
chance of label 1. As the output is linear in the vectors, scoring folds them to one number a bucket.

The fit uses a bounded sample, at most ``sample_rows`` labelled rows and ``sample_bytes`` of their whole
texts, in the order of a hash of doc_id. A text that is longer than ``TEXT_BYTES``, or that the rest of the
bytes has no room for, isn't learnt from and takes no room. A doc_id whose labels disagree or are null isn't
used. Scores depend on the whole text alone, however long; one text is held whole by a task. Null and empty
texts get the score of the bias, null doc_ids are scored like others and never learnt from. Every row is
scored, repeated rows alike; extra columns aren't read, whatever their names. An empty table gives no rows.
Without any usable label all scores are 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.textkit import bounded_batches, release

BUCKETS, DIM = 1 << 18, 8
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 6000, 32 << 20, 1 << 20
EPOCHS, RATE = 8, 1.0
REPEAT = b"\x00repeat"
CACHE, CACHE_WORD = 300_000, 256
SLICE = 1 << 15


def feature_slices(word: bytes) -> Iterator[list[int]]:
    """Buckets of a word, itself and the byte grams of ``<word>``, for at most ``SLICE`` places at once."""
    full = b"<" + word + b">"
    n, crc = len(full), zlib.crc32
    for lo in range(0, n, SLICE):
        out = [] if lo else [crc(word, 1) % BUCKETS]
        for k in (3, 4, 5):
            out += [crc(full[i : i + k]) % BUCKETS for i in range(lo, min(lo + SLICE, n - k + 1))]
        yield out


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; a word equal to the one before it is replaced by the mark of a repeat."""
    words = (text or "").encode().split()
    return [REPEAT if a == b else b for a, b in zip([b"", *words], words, strict=False)]


def doc_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text; weights sum to one."""
    words: dict[bytes, int] = {}
    for w in tokens(text):
        words[w] = words.get(w, 0) + 1
    total, at, weight = sum(words.values()), [], []
    for w, c in words.items():
        if len(w) + 2 <= SLICE:
            f = next(feature_slices(w))
            at += f
            weight += [c / (total * len(f))] * len(f)
            continue
        times = sum(np.bincount(f, minlength=BUCKETS) for f in feature_slices(w))
        f = np.flatnonzero(times)
        at += f.tolist()
        weight += (times[f] * (c / (total * times.sum()))).tolist()
    ids, back = np.unique(np.array(at, np.int32), return_inverse=True)
    return ids, np.bincount(back, weights=np.array(weight), minlength=len(ids)).astype(np.float32)


class Model:
    """Bucket logits and a bias; ``fit`` learns the vectors behind them."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        rows = [doc_features(t) for t in texts]
        steps, done = epochs * max(1, len(rows)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                (at, weight), now = rows[i], rate * (1 - done / steps)
                done += 1
                part = vectors[at]
                hidden = weight @ part
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = out @ p
                out -= (0.1 * now) * np.outer(hidden, p)
                bias -= (0.02 * now) * p
                vectors[at] = part - (40 * now) * weight[:, None] * back
        return cls(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


class WordLogits(dict):
    """Mean bucket logit of each word met; those of ``CACHE_WORD`` bytes at most are kept, within a bound of entries."""

    def __init__(self, logits: np.ndarray):
        super().__init__()
        self.logits = logits.astype(np.float64).tolist()

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        g, x, n = self.logits, 0.0, 0
        for f in feature_slices(word):
            x += sum(g[i] for i in f)
            n += len(f)
        x /= n
        if len(word) <= CACHE_WORD:
            self[word] = x
        return x


def fit_on(docs: DataFrame, labels: DataFrame, usable: str, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on the labelled rows that the SQL predicate ``usable`` (over doc_id) admits."""
    order = F.xxhash64("doc_id")
    agreed = labels.where(usable).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and quality in (0, 1)")
    picked = agreed.select("doc_id", "quality", order.alias("h")).orderBy("h", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= TEXT_BYTES).join(F.broadcast(picked), "doc_id").orderBy("h", "doc_id", "text").limit(sample_rows)
    fitted = rows.repartition(1).sortWithinPartitions("h", "doc_id", "text").select("quality", "text").mapInArrow(_fitter(sample_bytes), "logits binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(fitted[0]["logits"], np.float32), fitted[0]["bias"])


def _fitter(sample_bytes: int):
    """One task fits on the bounded sample, so the driver holds the folded model only."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for batch in batches:
            for quality, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = len((text or "").encode())
                if size + more <= sample_bytes:
                    size += more
                    texts.append(text or "")
                    labels.append(int(quality))
        model = Model.fit(texts, labels)
        release()
        if labels:
            yield pa.RecordBatch.from_arrays([pa.array([model.logits.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], ["logits", "bias"])

    return fit


def _scorer(model, name: str):
    held: list = []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(WordLogits(model.value.logits))
        get, bias = held[0].__getitem__, model.value.bias
        for batch in batches:
            release()
            out = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                words = tokens(t)
                z = sum(map(get, words)) / max(1, len(words)) + bias
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return score


def score_quality(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of ``docs`` (the text last) and the score, named ``name``."""
    bounded_batches(docs)
    spark = docs.sparkSession
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast(model), name), kind)


def op9_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Quality of every document; labels come only from rows whose crc32 remainder by 5 isn't 0."""
    rest = "crc32(cast(doc_id as string)) % 5"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, fit_on(docs, labels, f"{rest} <> 0"))
    return scored.select("doc_id", F.coalesce(F.expr(f"{rest} = 0"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
