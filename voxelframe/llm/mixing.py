"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given as knots
``(time, weight)`` that are joined by straight lines.  The integral of a
schedule is the source's cumulative token demand; inverting it gives the
training position of each of the source's tokens.  Documents are put in order
by those positions.  Everything here is DataFrame expressions.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own and comes last; rows with the same doc_id are told apart by
a hash of the whole row, and equal rows share a bucket in any order (they are
the same row); an empty table gives an empty mix.  Extra columns do not shape
the mix; ``mixed_documents`` hashes them to tell rows apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import row_hash, set_aside, written

WORD = r"[^\x20\x09-\x0D]+"
Schedule = Sequence[tuple[float, float]]

#: By rank of the source, repeating: mean weights 5, 2 and 1.  The first kind
#: fades as training goes on, the third grows, the second stays.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 7.0), (0.5, 5.0), (1.0, 3.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SHARE = 1.5
LIMIT = 2.0


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def inverse_demand(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` (0..1) of the schedule's integral is used up.

    Within a piece from (t0, w0) to (t1, w1), the demand is quadratic in time;
    the root is taken in the form that does not cancel.
    """
    whole, before, out = integral(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        rest = F.greatest(share * F.lit(whole) - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.try_divide(F.lit(2.0) * rest, F.lit(w0) + root)
        time = F.least(F.coalesce(time, F.lit(t0)), F.lit(t1))
        before += area
        out = time if out is None else F.when(share * F.lit(whole) <= F.lit(before - area), out).otherwise(time)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(source, source_size)`` -> rank, weight and target of each source.

    With every target at most ``limit`` times its source, the excess is shared
    again by weight until none is above: in order of room per weight, sources
    are full up to the first whose room holds its part of what is left.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("kind", (F.col("rank") % len(schedules)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(weights, F.col("kind") + 1)).withColumn("room", F.lit(limit) * F.col("source_size"))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    until = by_room.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("wanted", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("left", F.col("wanted") - F.coalesce(F.sum("room").over(until), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(until), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("left_weight"))
        .withColumn("full", F.col("room") <= F.col("level") * F.col("weight"))
    )
    # full sources come first; the level of the first that is not full holds for the rest
    first = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("room")).otherwise(first * F.col("weight"))
    return filled.select("source", "source_size", "rank", "kind", target.alias("target"))


def mix(documents: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, limit: float = LIMIT, bits: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """One row per document: how many of its words the mix takes, and when.

    Columns: doc_id, source, *columns*, size, source_size, target, taken
    (words, repeats counted), positions (training times of its passes).

    Within a source, documents follow a hash order.  A pass over the source
    takes them in that order until the target is reached; the last document
    of a budget is taken in part.  The running size comes from sums of
    2 ** ``bits`` hash ranges for each source (by default several for each
    shuffle partition), so no task holds a source.  The order is that of the
    hash alone, whatever the number of ranges.
    """
    bits = bits or max(8, math.ceil(math.log2(4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    order = F.shiftrightunsigned(F.xxhash64("doc_id", "text", "source", F.lit("mix")), 1)
    rows = documents.select("doc_id", "source", *columns, size.alias("size"), order.alias("_order"))
    rows = written(rows.withColumn("_bucket", F.shiftright("_order", 63 - bits).cast("int")))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(running), F.lit(0))).drop("_sum")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, schedules, share, limit)
    # a row for each source and bucket; both joins are on null-safe keys
    plan = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b._bucket", "b._start", "t.source_size", "t.kind", "t.target")
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._bucket") == F.col("p._bucket")))
    before = F.col("_inside") + F.col("_start")
    wanted = F.round("target").cast("long")
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(int(limit + 0.999) - 1)),
        lambda k: F.struct(
            (k * F.col("source_size") + F.col("_before")).alias("begin"),
            F.greatest(F.least(F.col("_wanted") - k * F.col("source_size") - F.col("_before"), F.col("size")), F.lit(0)).alias("words"),
        ),
    )
    used = joined.select("doc_id", "r.source", *columns, "size", "source_size", "kind", "target", before.alias("_before"), wanted.alias("_wanted"))
    used = used.withColumn("_passes", F.filter(passes, lambda p: p["words"] > 0))

    def time(p: Column) -> Column:
        part = F.try_divide(p["begin"].cast("double"), F.col("target"))
        out = inverse_demand(part, schedules[-1])
        for kind in range(len(schedules) - 2, -1, -1):
            out = F.when(F.col("kind") == kind, inverse_demand(part, schedules[kind])).otherwise(out)
        return out

    taken = F.aggregate("_passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return used.select("doc_id", "source", *columns, "size", "source_size", "target", taken.alias("taken"), F.transform("_passes", time).alias("positions"), F.transform("_passes", lambda p: p["words"]).alias("words"))


def in_position_order(rows: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Range-sorted: rows of all files in a row are in the order of ``keys``."""
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each pass over a document, range-sorted by training position."""
    passes = mixed.withColumn("_pass", F.explode(F.arrays_zip("positions", "words")))
    passes = passes.withColumn("position", F.col("_pass.positions")).withColumn("pass_words", F.col("_pass.words")).drop("_pass", "positions", "words")
    return in_position_order(passes, "position", "doc_id", partitions=partitions)


def by_first_position(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix``, range-sorted by the training position of their first pass; those never taken come last."""
    first = F.get("positions", F.lit(0))
    keyed = mixed.withColumn("first_position", first).withColumn("_never", first.isNull().cast("int"))
    return in_position_order(keyed, "_never", "first_position", "doc_id").drop("_never")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each pass that takes at least half of a document, range-sorted by training position.

    Whole texts only, so each source's words differ from its target by at most
    half of one document; the copies of a document are equal rows.  Rows that
    were equal before share their copies, evenly between the first and the
    last of their positions.
    """
    documents, back = set_aside(documents)
    keyed = documents.withColumns({"_id": F.xxhash64("doc_id"), "_row": row_hash(documents)})
    mixed = mix(keyed, columns=("_id", "_row"), **options)
    kept = F.filter(F.arrays_zip("positions", "words"), lambda p: p["words"] * 2 >= F.col("size"))
    passes = mixed.select("_id", "_row", F.transform(kept, lambda p: p["positions"]).alias("_at"))
    counts = passes.groupBy("_id", "_row").agg(F.sum(F.size("_at")).cast("long").alias("_copies"), F.count("*").alias("_n"), F.max("_at").alias("_at"), F.min(F.array_min("_at")).alias("_from"), F.max(F.array_max("_at")).alias("_to")).where("_copies > 0")
    # the join leaves the rows dealt and sorted by the key, so the window moves nothing
    number = F.row_number().over(Window.partitionBy("_id", "_row").orderBy("_row")) - 1
    each = F.floor(F.col("_copies") / F.col("_n")) + F.when(number < F.col("_copies") % F.col("_n"), 1).otherwise(0)
    copy = lambda k: F.col("_from") + (F.col("_to") - F.col("_from")) * (number + k * F.col("_n")) / F.col("_copies")
    shared = F.when(each > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(each - 1, F.lit(0))), copy)).otherwise(F.array().cast("array<double>"))
    dealt = keyed.join(counts, ["_id", "_row"]).withColumn("_positions", F.when(F.col("_n") == 1, F.col("_at")).otherwise(shared))
    return back(in_position_order(dealt.withColumn("_position", F.explode("_positions")), "_position", "_id", "_row"))
