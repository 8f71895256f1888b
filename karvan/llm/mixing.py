"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words. Its documents are put into a seeded order and read
in passes; the last pass stops where the target is met. Each source also has a weight schedule
``w(t) = 1 + a(2t - 1)`` over training time t in [0, 1]; its integral is the cumulative token
demand ``D(t) = (1 - a)t + at^2``. The k-th word of a source is asked for at the time t with
``D(t) = k / target``, so inverting D gives every document its training position, and a range
sort by position gives the training order of the whole mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karvan.llm.common import word_count

#: Weights of the sources, in code point order of their names (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Slopes of the weight schedules, assigned likewise; -1 < a < 1.
SLOPES = (-0.5, 0.0, 0.5)
#: No source, and so no document, is read more often than this.
MAX_PASSES = 3
#: Hex digits of the order key that cut a source into pieces (16^3 of them) for its prefix sum.
PIECE_DIGITS = 3


def order_key(doc_id: Column) -> Column:
    """Seeded order of the documents of a source: a digest of the id, the same in every run."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_passes: int = MAX_PASSES) -> DataFrame:
    """``(source, source_size)`` -> the same with ``target`` and ``slope``.

    The weights share the total size. A target stops at ``max_passes`` times its source and the
    excess is shared again by weight, until none is above: the level L with
    ``sum(min(cap, L * weight)) = total``, found along the sources sorted by cap per weight.
    One row per source meets in one task here, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("_fills_at", "_rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", _cycle(weights, F.col("_rank")))
        .withColumn("slope", _cycle(slopes, F.col("_rank")))
        .withColumn("_cap", F.col("source_size").cast("double") * max_passes)
        .withColumn("_fills_at", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum(F.col("source_size").cast("double")).over(every))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
    )
    level = F.min(F.when(F.col("_fills_at") >= F.col("_level"), F.struct("_fills_at", "_rank", "_level"))).over(every)
    return ranked.withColumn("_found", level).select(
        "source", "source_size", F.least("_cap", F.coalesce(F.col("_found._level"), F.lit(0.0)) * F.col("_weight")).alias("target"), "slope"
    )


def position(offset: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source asks for its word number ``offset``: D inverted."""
    y = F.least(F.lit(1.0), offset.cast("double") / target)
    b = 1 - slope
    return F.when(slope == 0, y).otherwise((F.sqrt(b * b + 4 * slope * y) - b) / (2 * slope))


def plan_mix(sized: DataFrame) -> DataFrame:
    """Add ``source_size, target, taken, passes, first_position`` to rows with ``size``.

    ``sized`` needs ``doc_id, source, size`` and keeps its other columns; it is read twice, so
    give a cheap frame or a written table. Own columns start with ``_mix_``. A document is read
    ``passes`` times in whole; the last pass of a source takes the documents whose middle word
    lies before the end of the target, so a source misses its target by half a document at most.
    A hot source is cut into 4096 pieces of the order key; only piece sums are added up in one
    place. Null ids share one place in the order, repeated rows count each, null sources are a
    source of their own, empty texts have size 0 and take part in every pass that reaches them.
    """
    keyed = sized.withColumn("_mix_key", order_key(F.col("doc_id"))).withColumn("_mix_piece", F.substring("_mix_key", 1, PIECE_DIGITS))
    pieces = keyed.groupBy("source", "_mix_piece").agg(F.sum("size").alias("_mix_sum"))
    targets = source_targets(pieces.groupBy("source").agg(F.sum("_mix_sum").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("_mix_piece").rowsBetween(Window.unboundedPreceding, -1)
    p = pieces.withColumn("_mix_start", F.coalesce(F.sum("_mix_sum").over(earlier), F.lit(0).cast("long"))).alias("p")
    t = targets.alias("t")
    starts = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("_mix_source"), F.col("_mix_piece").alias("_mix_at"), "_mix_start", "source_size", "target", "slope"
    )
    drop = [c for c in ("source_size", "target", "slope", "taken", "passes", "first_position") if c in sized.columns]
    inside = Window.partitionBy("source", "_mix_piece").orderBy("_mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.drop(*drop)
        .withColumn("_mix_to", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_piece") == F.col("_mix_at")))
        .withColumn("_mix_offset", F.col("_mix_start") + F.col("_mix_to") - F.col("size"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = F.col("target") - F.col("_mix_whole") * F.col("source_size")
    return (
        placed.withColumn("_mix_whole", whole)
        .withColumn("passes", (F.col("_mix_whole") + ((rest > 0) & (F.col("_mix_offset") + F.col("size") / 2 <= rest)).cast("long")))
        .withColumn("taken", F.col("passes") * F.col("size"))
        .withColumn("first_position", F.when(F.col("passes") > 0, position(F.col("_mix_offset"), F.col("target"), F.col("slope"))))
    )


def in_order(plan: DataFrame, at: str = "first_position") -> DataFrame:
    """Range sort by training position; rows without one come last, spread by id."""
    keys = (F.coalesce(F.col(at), F.lit(2.0)), F.col("doc_id"))
    return plan.repartitionByRange(*keys).sortWithinPartitions(*keys)


def curriculum(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: one row per reading of a document, in training order.

    Same columns as ``docs``; a document read twice appears twice, one not read is left out.
    """
    sized = docs.withColumn("size", word_count(F.col("text"))) if "size" not in docs.columns else docs.withColumn("_doc_size", F.col("size")).withColumn("size", word_count(F.col("text")))
    plan = plan_mix(sized).where(F.col("passes") > 0)
    offset = F.col("_mix_offset") + F.col("_mix_pass") * F.col("source_size")
    readings = plan.withColumn("_mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))).withColumn(
        "_mix_position", position(offset, F.col("target"), F.col("slope"))
    )
    if "size" in docs.columns:
        readings = readings.withColumn("size", F.col("_doc_size"))
    return in_order(readings, "_mix_position").select(*docs.columns)
