"""Counts, distributions and classification reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.errors import DataContractError


def ratio(num, den) -> Column:
    """num / den, 0 where den is 0."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when(d > 0, n / d).otherwise(0.0)


def confusion(actual: Column, predicted: Column) -> list[Column]:
    """The aggregates tp, fp, fn, tn."""
    return [F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn")]


def with_prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn."""
    out = counts.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def load_labels(table: DataFrame, id_column: str = "face_id", positive: str = "is_acceptable", values=("1", "true", "yes", "acceptable", "accepted"), identity: str = "true_person") -> DataFrame:
    """(face_id, positive, identity). The positive column is the named one, else is_acceptable, else not is_noise.

    Empty ids are left out; a repeated id raises.
    """
    have = set(table.columns)
    if id_column not in have:
        raise DataContractError(f"labels need a column {id_column}")
    yes = lambda c: F.lower(F.trim(F.col(c).cast("string"))).isin([v.lower() for v in values])
    name = next((c for c in (positive, "is_acceptable", "is_noise") if c in have), None)
    flag = F.lit(None).cast("boolean") if name is None else ~yes(name) if name == "is_noise" else yes(name)
    who = F.when(F.trim(F.col(identity)) != "", F.trim(F.col(identity))) if identity in have else F.lit(None).cast("string")
    out = table.select(F.trim(F.col(id_column).cast("string")).alias("face_id"), flag.alias("positive"), who.alias("identity")).where("face_id <> ''")
    if out.groupBy("face_id").count().where("count > 1").limit(1).count():
        raise DataContractError("labels repeat an id")
    return out


def classification_report(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labelled, unlabelled, orphan labels, confusion counts, precision, recall, f1, accuracy.

    ``decisions`` has face_id and accepted, ``labels`` face_id and positive. Without any labelled row
    the ratios are null.
    """
    known = labels.where("positive is not null")
    joined = decisions.select("face_id", "accepted").join(known, "face_id", "left")
    counts = joined.agg(F.count("positive").alias("labelled"), F.count_if(F.col("positive").isNull()).alias("unlabelled"), *confusion(F.col("positive"), F.col("accepted")))
    orphans = labels.join(decisions, "face_id", "left_anti").agg(F.count("*").alias("orphans"))
    out = with_prf(counts).crossJoin(F.broadcast(orphans)).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), "labelled"))
    return out.withColumns({c: F.when(F.col("labelled") > 0, F.col(c)) for c in ("precision", "recall", "f1", "accuracy")})


def reason_counts(rows: DataFrame, column: str = "reject_reasons") -> DataFrame:
    """(reason, n, rate): how many rows list each reason, and their share of all rows."""
    total = rows.agg(F.count("*").alias("_n"))
    counts = rows.select(F.explode(F.array_distinct(column)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", ratio("n", "_n").alias("rate"))


def reason_intersections(rows: DataFrame, column: str = "reject_reasons") -> DataFrame:
    """(reasons, n): rows that list every reason of a set, for all sets of two or more that occur.

    Rows are first counted by their distinct sorted reasons, so subsets are made once a distinct set.
    """
    sets = rows.select(F.array_sort(F.array_distinct(column)).alias("r")).groupBy("r").agg(F.count("*").alias("n")).where(F.size("r") >= 2)
    picks = F.expr("filter(transform(sequence(1, shiftleft(1, size(r)) - 1), m -> filter(r, (x, i) -> (shiftright(m, i) & 1) = 1)), p -> size(p) >= 2)")
    subset = sets.select("n", F.explode(picks).alias("p"))
    return subset.groupBy(F.array_join("p", "&").alias("reasons")).agg(F.sum("n").alias("n"))


def distribution(column: str | Column) -> list[Column]:
    """The aggregates count, sum, min, max, mean, median, rounded to six digits."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    six = lambda x, name: F.round(x, 6).alias(name)
    return [F.count(c).alias("count"), six(F.coalesce(F.sum(c), F.lit(0.0)), "sum"), six(F.min(c), "min"), six(F.max(c), "max"), six(F.avg(c), "mean"), six(F.median(c), "median")]


def identity_counts(identities: DataFrame, members: DataFrame, key: str = "identity") -> DataFrame:
    """(key, n) for every identity, those without a member included."""
    counts = members.groupBy(key).agg(F.count("*").alias("n"))
    return identities.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def face_identities(faces: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(face_id, identity): the labelled identity of a face where it has one, else its cluster."""
    found = faces.select("face_id", F.col("cluster_id").alias("_c"))
    if labels is None:
        return found.select("face_id", F.col("_c").alias("identity")).where("identity is not null")
    known = labels.where("identity is not null").select("face_id", F.col("identity").alias("_i"))
    return found.join(known, "face_id", "full").select("face_id", F.coalesce("_i", "_c").alias("identity")).where("identity is not null")


def identity_stages(identities: DataFrame, decisions: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(identity, before, after, selected): faces of every identity before the filter, after it, and after selection."""
    rows = identities.join(decisions.select("face_id", "accepted"), "face_id", "left")
    if selected is not None:
        rows = rows.join(selected.where("selected").select("face_id", F.lit(True).alias("_s")), "face_id", "left")
    chosen = F.count_if(F.coalesce("_s", F.lit(False))) if selected is not None else F.lit(None).cast("long")
    return rows.groupBy("identity").agg(F.count("accepted").alias("before"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("after"), chosen.alias("selected"))


def experiment_metrics(decisions: DataFrame, faces: DataFrame | None = None, selected: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """One row of an experiment's metrics: totals, rates, reasons, ratings, selection, identities and classification.

    ``decisions``: face_id, source_frame, accepted, reject_reasons, shadow_reasons, soft_rating. Identities are
    those of the labels, else the clusters of ``faces``.
    """
    as_map = lambda df, k, v, name: df.agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))), F.expr("map()").cast("map<string,bigint>")).alias(name))
    base = decisions.agg(
        F.count("*").alias("total_faces"), F.count_distinct("source_frame").alias("source_images"), F.count_if("accepted").alias("accepted_faces"), F.count_if(~F.col("accepted")).alias("rejected_faces"),
        F.struct(*distribution(F.when(F.col("accepted"), F.col("soft_rating")))).alias("rating"),
    )
    base = base.withColumns({"acceptance_rate": ratio("accepted_faces", "total_faces"), "rejection_rate": ratio("rejected_faces", "total_faces")})
    parts = [as_map(reason_counts(decisions, c).select("reason", "n"), "reason", "n", name) for c, name in (("reject_reasons", "reject_counts"), ("shadow_reasons", "shadow_counts"))]
    parts.append(as_map(reason_intersections(decisions).select("reasons", "n"), "reasons", "n", "reject_intersections"))
    if selected is not None:
        chosen = selected.agg(F.count_if("selected").alias("selected_faces"), F.count_distinct(F.when(F.col("selected"), F.col("cluster_id"))).alias("selected_identities"))
        why = as_map(reason_counts(selected.where("not selected"), "not_selected_reasons").select("reason", "n"), "reason", "n", "exclusion_counts")
        parts += [chosen, why]
    if faces is not None:
        known = labels if labels is not None and "identity" in labels.columns else None
        stages = identity_stages(face_identities(faces, known), decisions, selected)
        steps = ("before", "after", *(["selected"] if selected is not None else []))
        gone = [F.count_if(F.col(c) == 0).alias(f"identities_without_{c}") for c in steps[1:]]
        spread = [F.struct(*distribution(c)).alias(f"identities_{c}") for c in steps]
        counts = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("identity", c)))).alias(f"counts_{c}") for c in steps]
        source = F.lit("labels_and_clusters" if known is not None else "resulting_clusters").alias("identity_source")
        parts.append(stages.agg(F.count("*").alias("identities"), *gone, *spread, *counts).withColumn("identity_source", source))
    if labels is not None:
        parts.append(classification_report(decisions, labels).select(F.struct("*").alias("classification")))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, base)


def histogram(values: DataFrame, column: str, low: float = -1.0, high: float = 1.0, bins: int = 80) -> DataFrame:
    """(bin, n) for every bin, empty ones included; the last bin is closed, values outside are left out."""
    x, width = F.col(column), (high - low) / bins
    spot = F.least(F.floor((x - low) / width).cast("int"), F.lit(bins - 1))
    counts = values.where((x >= low) & (x <= high)).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def contact_layout(items: DataFrame, order: list[Column], columns: int = 8, page_size: int = 80, group: list[str] | None = None) -> DataFrame:
    """Adds page, row and col of every item on contact sheets of ``page_size`` thumbnails, by group."""
    rank = F.row_number().over(Window.partitionBy(*(group or [])).orderBy(*order)) - 1
    return items.withColumn("_r", rank).withColumns({"page": F.floor(F.col("_r") / page_size), "row": F.floor(F.col("_r") % page_size / columns), "col": F.col("_r") % columns}).drop("_r")


def metric_delta(metrics: DataFrame, baseline: str) -> DataFrame:
    """(experiment, metric, value, baseline_value, delta) over metrics that the baseline has too."""
    base = metrics.where(F.col("experiment") == baseline).select("metric", F.col("value").alias("baseline_value"))
    return metrics.join(base, "metric").withColumn("delta", F.col("value") - F.col("baseline_value")).select("experiment", "metric", "value", "baseline_value", "delta")


def flat_metrics(document: dict, prefix: str = "") -> dict[str, float]:
    """Nested numbers as dotted keys; booleans and text are left out."""
    out: dict[str, float] = {}
    for key, value in document.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            out |= flat_metrics(value, f"{name}.")
        elif isinstance(value, int | float) and not isinstance(value, bool):
            out[name] = float(value)
    return out
