"""Time-varying source mix: weight schedules integrated, token demand inverted into training positions.

A source's weight is a piecewise-linear function of training progress u in [0, 1]. Its integral, scaled
to the source's target, is its cumulative demand D(u). Each source's documents stand in a fixed shuffled
order (by MD5 of the doc_id); the copy that starts after c words of its source is trained on at position D^-1(c), and a source's
documents are read round and round until its demand is met at position 1. Documents are range-sorted by position.
Targets: sources weigh ``weights`` in turn and share all words; a target stops at ``most`` times its source's
size and the excess is shared again by weight (water filling, solved in closed form).

Defined cases: a null text has size 0; the null source is a source of its own, last. Repeated rows are
separate documents (ties in the order are broken by size); a null doc_id is ordered by its text's MD5. Documents of size 0 are
taken 0 times and stand at the position of their place in the order; those that the demand doesn't reach have none. An empty table gives an empty result. Extra columns
are kept by ``mixed`` and ignored by ``plan``.

Prefix sums go by bucket first (4096 hash ranges a source), so a source with a third of all rows is
never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import Scratch

WEIGHTS = (5, 2, 1)
#: Weight shape at progress 0, 1/2 and 1, in turn over the sources: heavy sources fade, light ones grow.
SHAPES = ((1.5, 1.0, 0.5), (0.75, 1.25, 0.75), (0.5, 1.0, 1.5))
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes(source, z) -> source, place, weight, z, target. One row for each source; sorts sources alone.

    With sources in ascending order of z / weight, those before some place are full (target = most * z)
    and the rest share what is left by weight: the first place at which nobody later is above is the answer.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_code) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    fill = Window.orderBy((F.lit(most) * F.col("z")).cast("double") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.sum("z").over(everyone) - most * F.coalesce(F.sum("z").over(before), F.lit(0))
    shares = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / shares.cast("double")
    filled = ranked.withColumn("level", level).withColumn("full", level * F.col("weight") > F.lit(most) * F.col("z"))
    # Full sources come first; the level of the first source that is not full holds for it and all after it.
    water = F.min(F.when(~F.col("full"), F.struct(((F.lit(most) * F.col("z")).cast("double") / F.col("weight")).alias("r"), F.col("place"), F.col("level")))).over(everyone)
    target = F.when(F.col("full"), (F.lit(most) * F.col("z")).cast("double")).otherwise(F.col("water.level") * F.col("weight"))
    return filled.withColumn("water", water).select("source", "place", "weight", "z", target.alias("target"))


def position(done: Column, target: Column, place: Column, shapes: Sequence[Sequence[float]] = SHAPES) -> Column:
    """Progress at which a source's cumulative demand reaches ``done`` words: the integral inverted on its segment."""
    y = done.cast("double") / target
    column = F.lit(None).cast("double")
    for turn, shape in enumerate(shapes):
        steps = len(shape) - 1
        areas = [(a + b) / 2 / steps for a, b in zip(shape, shape[1:])]
        whole = sum(areas)
        value, begun = F.lit(1.0), 0.0
        pieces = []
        for i, area in enumerate(areas):
            a, b = shape[i], shape[i + 1]
            pieces.append((begun, area, a, b, i))
            begun += area
        for begun, area, a, b, i in reversed(pieces):
            need = y * F.lit(whole) - F.lit(begun)  # area wanted within this segment
            slope = (b - a) * steps
            if slope == 0:
                within = need / F.lit(a)
            else:
                within = (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            value = F.when(need <= F.lit(area), F.lit(i / steps) + within).otherwise(value)
        column = F.when(place % len(shapes) == turn, value).otherwise(column)
    return column


def plan(documents: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, size, source, source_size, target, place, start, copies, taken, position, last_position.

    ``start``: words of its source before the document; ``copies``: how often the document begins before the demand of
    floor(target) words is met, reading the source round and round; ``taken``: its words until then (the last copy may be cut), so every
    source's taken words add up to floor(target); ``position`` and ``last_position``: where its first and last copy begin.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")))
    sized = scratch.write(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)),
        "sized",
    )
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bz"))
    within = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bz").over(within), F.lit(0)))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("bz").alias("z")), weights, most)
    offsets = (
        buckets.alias("b")
        .join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .select(F.col("b.source").alias("osource"), F.col("b.bucket").alias("obucket"), "before", "place", "z", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("osource")) & (F.col("bucket") == F.col("obucket")))
        .withColumn("start", F.col("before") + F.col("inner"))
    )
    demand, z, start, size = F.floor("target").cast("long"), F.col("z"), F.col("start"), F.col("size")
    # The copies whose begin, c * z + start, lies before the demand: the positions below 1.
    copies = F.when((size > 0) & (demand > start), F.expr("(cast(floor(target) as bigint) - start - 1) div z") + 1).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("copies", copies).withColumn("last", (F.col("copies") - 1) * z + start)
    at = lambda done: position(done, F.col("target"), F.col("place"))
    stands = (F.col("copies") > 0) | (size == 0) & (F.col("target") > 0)
    return placed.select(
        "doc_id",
        "size",
        "source",
        z.alias("source_size"),
        "target",
        "place",
        "start",
        "copies",
        F.when(F.col("copies") > 0, (F.col("copies") - 1) * size + F.least(size, demand - F.col("last"))).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.when(stands, at(F.least(start.cast("double"), F.col("target")))).alias("position"),
        F.when(F.col("copies") > 0, at(F.col("last"))).alias("last_position"),
    )


def by_position(planned: DataFrame) -> DataFrame:
    """A plan in training order: range-partitioned and sorted by the first copy's position; documents that are not taken come first."""
    return planned.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "size")


def mixed(documents: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, range-sorted by training position.

    Whole copies only: the copy that crosses its source's target counts if at least half of it is taken.
    Documents of no words stay once (there is nothing to weigh). Columns are those of ``documents``.
    """
    planned = plan(documents, scratch, weights, most)
    # Repeated rows of one doc_id are told apart by their number among equals, on both sides.
    same = Window.partitionBy("doc_id", "source", "size").orderBy("start")
    planned = planned.withColumn("turn", F.row_number().over(same)).select(*[F.col(c).alias(f"__p_{c}") for c in ("doc_id", "source", "size", "turn", "taken", "start", "source_size", "target", "place")])
    turn = Window.partitionBy("doc_id", "source", "__size").orderBy("text")
    rows = documents.withColumn("__size", word_count(F.col("text"))).withColumn("__turn", F.row_number().over(turn))
    copies = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.floor(F.col("__p_taken") / F.col("__size") + 0.5)).cast("int")
    begun = F.col("__copy") * F.col("__p_source_size") + F.col("__p_start")
    at = F.coalesce(position(F.least(begun.cast("double"), F.col("__p_target")), F.col("__p_target"), F.col("__p_place")), F.lit(0.0))
    return (
        rows.join(
            planned,
            F.col("doc_id").eqNullSafe(F.col("__p_doc_id"))
            & F.col("source").eqNullSafe(F.col("__p_source"))
            & (F.col("__size") == F.col("__p_size"))
            & (F.col("__turn") == F.col("__p_turn")),
        )
        .withColumn("__copies", copies)
        .filter("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .withColumn("__at", at)
        .repartitionByRange("__at", "doc_id")
        .sortWithinPartitions("__at", "doc_id")
        .select(*documents.columns)
    )
