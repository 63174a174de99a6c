"""Results of a model over files: a pluggable producer, a cache table, errors kept beside the item they belong to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.errors import CacheError
from lumenframe.plans.staging import Staged
from lumenframe.sources import runs

#: Makes, once in a worker, the function that turns (path, content) into the rows found, as dicts.
Producer = Callable[[], Callable[[str, bytes], list[dict]]]


def _infer(make: Producer, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = None
        for batch in batches:
            values, errors = [], []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    infer = infer or make()
                    values.append([{n: row.get(n) for n in names} for row in infer(path, content)])
                    errors.append(None)
                except (OSError, RuntimeError, ValueError) as error:  # one bad item doesn't end the others
                    values.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield batch.drop(columns="content").assign(value=values, error=errors)

    return run


def produce(files: DataFrame, make: Producer, row: str, cache: str, fingerprint: str, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, stats) of a producer over ``files`` (path, length, modificationTime, content), as binaryFile scans give them.

    ``row`` is the DDL of one found row. results: path, value (array of rows; null after an error), error, cached.
    An item is taken from the table at ``cache`` only if its path, length, time and ``fingerprint`` agree; all
    others are computed, and what succeeded is added to the cache, in shards by the first two digits of the
    path's digest. ``extra`` (path, content) replaces the content that the producer sees, such as a crop.
    """
    spark = files.sparkSession
    names = [f.name for f in spark.createDataFrame([], row).schema]
    keyed = files.select(F.sha2("path", 256).alias("key"), "path", "length", "modificationTime").dropDuplicates(["path"])
    known = spark.read.parquet(cache).where(F.col("fingerprint") == fingerprint) if runs.exists(spark, cache) else None
    if known is not None and "key" not in known.columns:
        raise CacheError(f"{cache} is no cache of results")
    match = ["key", "path", "length", "modificationTime"]
    hits = keyed.join(known.select(*match, "value").dropDuplicates(match), match) if known is not None else None
    missing = keyed.join(hits.select("key"), "key", "left_anti") if hits is not None else keyed
    content = (extra if extra is not None else files).select("path", "content").dropDuplicates(["path"])
    kind = f"key string, path string, length long, modificationTime timestamp, value array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in spark.createDataFrame([], row).schema)}>>, error string"
    fresh = Staged(missing.join(content, "path").select(*match, "content").mapInPandas(_infer(make, names), kind), "produced").df
    old = Staged(hits.select("path", "value"), "hits").df if hits is not None else None
    done = fresh.where("error is null").withColumns({"fingerprint": F.lit(fingerprint), "shard": F.substring("key", 1, 2)}).drop("error")
    done.repartition("shard").write.mode("append").partitionBy("shard").parquet(cache)
    out = fresh.select("path", "value", "error", F.lit(False).alias("cached"))
    if old is not None:
        out = out.unionByName(old.select("path", "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")))
    stats = out.agg(F.count("*").alias("items"), F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached") & F.col("error").isNull()).alias("computed"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return out, stats


def found_rows(results: DataFrame, vector: str | None = None) -> DataFrame:
    """One row for each found row, numbered by path; rows whose ``vector`` is null, zero or not finite are left out."""
    rows = results.where("value is not null").select("path", F.posexplode("value").alias("index", "v")).select("path", "index", "v.*")
    if vector is None:
        return rows
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))
