"""Source mixing along a time-varying curriculum.

Each source gets a target number of words: shares by weight, none above ``most`` times the source, the
excess reshared by weight (a water level, in closed form). A source's documents are ordered by a hash;
all are taken floor(target / size) times, and what is left of the target goes to a prefix of that order,
then to what still fits among the rest. Each copy stands at an offset of its source's stream of words.
A source's weight schedule g(t), piecewise linear over training time t in [0, 1], is integrated, and the
inverse of that cumulative demand turns offsets into training positions; documents are range-sorted by
position.

Prefix sums run in two levels, over ``BUCKETS`` hash ranges a source, and what a source has is joined by
parts of it, so one source may hold most rows. Sources themselves meet in one task, one row each.
Rows that agree in doc_id, source and size move together. Null texts have size 0 and are taken as often
as their source's whole passes. Null doc_ids are rows like others. Null sources form one source, ordered
last. A text counts whole, however long. An empty table gives no rows. Extra columns pass through ``mix``,
whatever their names but for those that begin with ``__mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.plans.prefix import running_sums
from lumenframe.plans.staging import Staged

MOST = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 1024
#: Parts of a source in joins with its sums.
PARTS = 32
PASSES = 4
#: Schedules by place in WEIGHTS: knots (time, weight). Early, steady and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def size_of(text: str = "text") -> Column:
    """Words of a text: runs of characters outside 0x20 and 0x09-0x0D."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def invert_schedule(u: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear weight reaches the share u of its total."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for i, ((t0, a), (t1, b)) in enumerate(zip(knots, knots[1:], strict=False)):
        need, slope = u * total - done, (b - a) / (t1 - t0)
        inside = need / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * need)) - a) / slope
        at = F.least(F.lit(float(t1)), t0 + inside)
        done += areas[i]
        out = F.when(u * total <= done, at) if out is None else out.when(u * total <= done, at)
    return out.otherwise(float(knots[-1][0]))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, src, kind, target)."""
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("kind", F.col("src") % len(weights)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "src")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.col("source_size") * most
    total, capped = F.sum("source_size").over(every), F.coalesce(F.sum(cap).over(before), F.lit(0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levels = ranked.withColumn("level", (total - capped) / left).withColumn("holds", F.col("level") <= cap / F.col("w"))
    level = F.min(F.when(F.col("holds"), F.struct(F.col("source_size") / F.col("w"), "src", "level"))).over(every)["level"]
    return levels.withColumn("target", F.least(cap.cast("double"), level * F.col("w"))).select("source", "source_size", "src", "kind", "target")


def _prefix(units: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the units of the source that stand before, in two levels."""
    sums = units.groupBy("src", "bucket").agg(F.sum(value).alias("s"))
    offsets = sums.select("src", "bucket", (F.sum("s").over(Window.partitionBy("src").orderBy("bucket")) - F.col("s")).alias("offset"))
    order = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = units.withColumn("inner", F.sum(value).over(order) - value)
    return inner.join(offsets, ["src", "bucket"]).withColumn(name, F.col("offset") + F.col("inner")).drop("offset", "inner")


def _by_part(sums: DataFrame) -> DataFrame:
    """One row a source as one row for each of its parts."""
    return sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def plan_mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, size, source_size, target, rows, copies, positions): one row for each
    doc_id, source and size; ``rows`` rows of it are taken ``copies`` times each, at ``positions``."""
    narrow = docs.select("doc_id", "source", size_of().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    narrow = Staged(narrow, "sizes").df
    aims = Staged(targets(narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most), "aims").df
    h = F.xxhash64("doc_id", F.lit(8))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    bucket = F.shiftrightunsigned(h, 54).cast("int")
    units, each = narrow.withColumns({"h": h, "bucket": bucket, "part": bucket % PARTS}), _by_part(aims)
    units = units.join(each, units.source.eqNullSafe(each.source) & (units.part == each.part)).drop(each.source, each.part)
    units = units.withColumns({"unit": F.col("size") * F.col("rows"), "whole": whole, "extra": F.lit(0)})
    units = Staged(_prefix(units, F.col("unit"), "before"), "units").df
    for step in range(PASSES):
        slack = F.col("unit") / 2 if step == PASSES - 1 else F.col("unit")  # only the last pass may pass its target
        taken = units.groupBy("src").agg(F.max(F.col("target") - F.col("whole") * F.col("source_size")).alias("room"), F.sum(F.col("extra") * F.col("unit")).alias("got"))
        gap = taken.select("src", (F.col("room") - F.col("got")).alias("gap"))
        fits = (F.col("extra") == 0) & (F.col("unit") > 0) & (slack <= F.col("gap"))
        tried = _prefix(units.join(_by_part(gap), ["src", "part"]), F.when(fits, F.col("unit")).otherwise(0), "ahead")
        more = fits & (F.col("ahead") + slack <= F.col("gap"))
        units = Staged(tried.withColumn("extra", F.when(more, 1).otherwise(F.col("extra"))).drop("ahead", "gap"), "units").df
    units = _prefix(units, F.col("extra") * F.col("unit"), "extra_before")
    sums = units.groupBy("src").agg(F.sum((F.col("whole") + F.col("extra")) * F.col("unit")).alias("stream"))
    units = units.join(_by_part(sums), ["src", "part"]).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    offset = lambda j: F.when(j < F.col("whole"), j * F.col("source_size") + F.col("before")).otherwise(F.col("whole") * F.col("source_size") + F.col("extra_before"))

    def place(j: Column) -> Column:
        u = F.coalesce(F.least(F.lit(1.0), F.try_divide(offset(j).cast("double"), F.col("stream").cast("double"))), F.lit(0.0))
        out = F.when(F.col("kind") == 0, invert_schedule(u, schedules[0]))
        for k in range(1, len(weights)):
            out = out.when(F.col("kind") == k, invert_schedule(u, schedules[k % len(schedules)]))
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place)).otherwise(F.array().cast("array<double>"))
    return units.select("doc_id", "source", "size", "source_size", "target", "rows", "copies", positions.alias("positions"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, repeated as planned, range-sorted by training position; same columns."""
    plan = plan_mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias("__mix_d"), F.col("source").alias("__mix_s"), F.col("size").alias("__mix_n"), F.col("positions").alias("__mix_p"))
    sized = docs.withColumn("__mix_size", size_of())
    hit = sized.doc_id.eqNullSafe(plan["__mix_d"]) & sized.source.eqNullSafe(plan["__mix_s"]) & (sized["__mix_size"] == plan["__mix_n"])
    rows = sized.join(plan, hit).withColumn("__mix_at", F.explode("__mix_p"))
    return rows.repartitionByRange("__mix_at").sortWithinPartitions("__mix_at", "doc_id").select(*(F.col(f"`{c}`") for c in docs.columns))


def training_order(plan: DataFrame) -> DataFrame:
    """The rows of a plan with ``starts`` beside ``positions``: words of the whole mix before each copy.

    All copies are range-sorted by position, and their words are summed in that order.
    """
    row = ("doc_id", "source", "size", "source_size", "target", "rows", "copies")
    copies = plan.select(*row, F.explode_outer("positions").alias("at"))
    words = F.when(F.col("at").isNotNull(), F.col("size") * F.col("rows")).otherwise(0)
    order = [F.col("at").asc_nulls_last(), "doc_id", "source", "size"]
    placed = running_sums(copies.withColumn("words", words), order, {"upto": "words"})
    one = F.when(F.col("at").isNotNull(), F.struct("at", (F.col("upto") - F.col("words")).alias("start")))
    sorted_ = placed.groupBy(*row).agg(F.array_sort(F.collect_list(one)).alias("each"))
    return sorted_.select(*row, F.col("each.at").alias("positions"), F.col("each.start").alias("starts"))


def op8_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with its source's size and target, and where its copies stand in training.

    ``positions`` are the copies' training times, and ``starts`` the words of the mix before each.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = training_order(plan_mix(docs))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return plan.withColumn("_", F.explode(F.sequence(F.lit(1), "rows"))).select("doc_id", "size", "source_size", "target", taken, "positions", "starts")
