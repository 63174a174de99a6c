"""Evaluation annotations: box files, verification pairs, identity records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.errors import EvaluationDataError
from lumenframe.operators.sampling import assert_disjoint, same_keys
from lumenframe.schema import BOXES

FOLDS, FOLD_SIZE = 10, 600
PARTITIONS = {"0": "train", "1": "val", "2": "test"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(no, line): the non-empty lines of a text file, trimmed, numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")).alias("no", "line"))
    return whole


def _boxes_of(text: str) -> Iterator[tuple[str, list[dict]]]:
    """The grammar: a path, a count, count box lines; a count of 0 may be followed by one line of zeros."""
    rows, at = [x.strip() for x in text.splitlines() if x.strip()], 0
    while at < len(rows):
        name = rows[at]
        if at + 1 >= len(rows) or not rows[at + 1].isdigit():
            raise EvaluationDataError(f"{name} has no count of boxes")
        n, boxes = int(rows[at + 1]), []
        at += 2
        if n == 0 and at < len(rows) and set(rows[at].split()) == {"0"} and len(rows[at].split()) >= 4:
            at += 1
        for line in rows[at : at + n]:
            cells = line.split()
            if len(cells) < 4:
                raise EvaluationDataError(f"{name} has a broken box: {line}")
            x, y, w, h = map(float, cells[:4])
            if w > 0 and h > 0:
                boxes.append({"x1": x, "y1": y, "x2": x + w, "y2": y + h})
        if at + n > len(rows):
            raise EvaluationDataError(f"{name} lacks boxes")
        at += n
        yield name, boxes


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, boxes) from box files; boxes without area are left out, a repeated path raises."""

    def parse(batches):
        for part in batches:
            for text in part["value"]:
                found = list(_boxes_of(text))
                names = [n for n, _ in found]
                if len(set(names)) != len(names):
                    raise EvaluationDataError("an image path repeats")
                yield pd.DataFrame({"relative_path": names, "boxes": [b for _, b in found]})

    return spark.read.text(path, wholetext=True).mapInPandas(parse, BOXES)


def missing_files(records: DataFrame, column: str, listing: DataFrame) -> DataFrame:
    """Records whose file is not in ``listing`` (path)."""
    return records.join(listing.select(F.col("path").alias(column)), column, "left_anti")


def read_pairs(spark: SparkSession, path: str, folds: int = FOLDS, fold_size: int = FOLD_SIZE) -> DataFrame:
    """(left, right, same, fold) from a pair file: a header of folds and pairs a class, three cells for one
    person, four for two. Every fold must hold half of each."""
    rows = lines(spark, path)
    head = rows.where("no = 0").first()
    if head is None or head["line"].split() != [str(folds), str(fold_size // 2)]:
        raise EvaluationDataError(f"the header must be {folds} {fold_size // 2}")
    cells = rows.where("no > 0").select((F.col("no") - 1).alias("i"), F.split("line", r"\s+").alias("c"))
    image = lambda who, no: F.concat(who, F.lit("/"), who, F.lit("_"), F.lpad(no, 4, "0"), F.lit(".jpg"))
    same = F.size("c") == 3
    right = F.when(same, image(F.col("c")[0], F.try_element_at("c", F.lit(3)))).otherwise(F.when(F.size("c") == 4, image(F.try_element_at("c", F.lit(3)), F.try_element_at("c", F.lit(4)))))
    pairs = cells.select(image(F.col("c")[0], F.try_element_at("c", F.lit(2))).alias("left"), right.alias("right"), same.alias("same"), F.floor(F.col("i") / fold_size).cast("int").alias("fold"))
    found = pairs.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("same").alias("p"), F.count_if(F.col("right").isNull()).alias("bad")).collect()
    if len(found) != folds or any(r["n"] != fold_size or r["p"] * 2 != fold_size or r["bad"] for r in found):
        raise EvaluationDataError(f"{folds} folds of {fold_size // 2} same and {fold_size // 2} different pairs are needed")
    return pairs


def read_columns(spark: SparkSession, path: str, counted: bool = False) -> DataFrame:
    """(name, value) from lines ``name integer``; with a declared count first where ``counted``. Names are unique."""
    rows = lines(spark, path)
    cells = F.split("line", r"\s+")
    out = rows.where(F.size(cells) == 2).select(cells[0].alias("name"), F.try_element_at(cells, F.lit(2)).try_cast("int").alias("value"))
    broken = rows.where((F.size(cells) != 2) | F.try_element_at(cells, F.lit(2)).try_cast("int").isNull())
    broken = broken.where("no > 0") if counted else broken
    if broken.limit(1).count():
        raise EvaluationDataError(f"{path}: a line is not a name and a number")
    n = out.agg(F.count("*").alias("n"), F.count_distinct("name").alias("d")).first()
    if n["n"] != n["d"]:
        raise EvaluationDataError(f"{path}: a name repeats")
    if counted and (rows.where("no = 0").first() or {"line": ""})["line"] != str(n["n"]):
        raise EvaluationDataError(f"{path}: the declared count is wrong")
    return out


def read_record_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bbox): a count, a header, then ``name x y w h``. No width and no height is no box; else both must be positive."""
    rows = lines(spark, path).where("no > 1")
    c = F.split("line", r"\s+")
    x, y, w, h = (F.try_element_at(c, F.lit(i)).try_cast("double") for i in range(2, 6))
    out = rows.select(c[0].alias("name"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    none = (F.col("w") == 0) & (F.col("h") == 0)
    bad = out.where(F.coalesce(~none & ((F.col("w") <= 0) | (F.col("h") <= 0)), F.lit(True))).limit(1).collect()
    if bad:
        raise EvaluationDataError(f"{bad[0]['name']} has a broken box")
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return out.select("name", F.when(~none, box).alias("bbox"))


def read_identity_records(spark: SparkSession, identities: str, partitions: str, boxes: str, only: list[str] | None = None) -> DataFrame:
    """(filename, identity, partition, bbox): the three files joined by name, which must list the same names."""
    ids, parts, box = read_columns(spark, identities), read_columns(spark, partitions), read_record_boxes(spark, boxes)
    same_keys(ids, parts, box, key="name")
    decode = F.create_map(*(F.lit(x) for kv in PARTITIONS.items() for x in kv))
    out = ids.select("name", F.col("value").alias("identity")).join(parts.select("name", decode[F.col("value").cast("string")].alias("partition")), "name").join(box, "name")
    if out.where("partition is null").limit(1).count():
        raise EvaluationDataError("a partition is none of 0, 1, 2")
    assert_disjoint(out, "identity", "partition")
    out = out if only is None else out.where(F.col("partition").isin(only))
    return out.select(F.col("name").alias("filename"), "identity", "partition", "bbox")


def dataset_summary(records: DataFrame) -> DataFrame:
    """(partition, images, identities)."""
    return records.groupBy("partition").agg(F.count("*").alias("images"), F.count_distinct("identity").alias("identities"))


def file_report(listing: DataFrame) -> DataFrame:
    """(extension, files, bytes) of a folder's listing (path, length)."""
    return listing.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def manifest_groups(records: DataFrame) -> DataFrame:
    """(identity, images): each identity's images in name order, for manifests."""
    return records.groupBy("identity").agg(F.array_sort(F.collect_list("filename")).alias("images"), F.count("*").alias("n"))


def match_manifest(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest entries (image, official_partition, identity) with their records; any that disagrees raises."""
    hit = entries.join(records, entries.image == records.filename, "left")
    bad = hit.where(records.filename.isNull() | (records.identity != entries.identity) | (records.partition != entries.official_partition)).select("image").limit(1).collect()
    if bad:
        raise EvaluationDataError(f"the manifest disagrees with the records about {bad[0][0]}")
    return hit.select("image", "official_partition", entries.identity, "bbox")


def first_rank(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
