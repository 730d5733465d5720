"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of a token budget.  Training time runs from 0 to 1 and each
source's sampling weight follows a piecewise linear schedule over it.  The integral of
that schedule, scaled to the source's target, is its cumulative token demand; inverting
it gives each document occurrence the position in time at which its source has used up
the tokens before it.  Range-sorting occurrences by position yields the training order,
and their places in it are their ranks.

Scale.  Documents of a source are laid out in the order of the MD5 of their id.  Its
first three digits cut each source into 4096 even buckets, so that a source with a third
of all rows is as parallel as the rest: sums by (source, bucket) are aggregated first,
running offsets are taken over that small table, and the only windows over documents are
inside one bucket.

Defined results.  A null text has size 0.  A null source is a source of its own, last in
order.  A null id is laid out under its own key.  Repeated rows are separate documents;
among equal ids the smaller size comes first, and rows equal in both are interchangeable.
An empty table gives an empty result.  Sources whose texts hold no word get target 0.
Other columns pass through untouched; columns of the input whose names start with
``mix_`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: (time, weight) knots by weight class: the heavy sources fade, the light ones rise.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source with its size and target.

    ``sizes`` has a row per source: mix_source, mix_source_size.  A target is at most
    ``most`` times its source's size and the excess is reshared by weight until none is
    above.  That fixed point is found in closed form: sources saturate in the order of
    size over weight, so the saturated ones are a prefix of that order.  The table of
    sources is a dimension, and its windows run over one partition.
    """
    n = len(weights)
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("k", F.row_number().over(everything.orderBy(F.col("mix_source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % n + 1).cast("int"))
    ranked = ranked.withColumn("mix_class", (F.col("k") % n).cast("int")).withColumn("w", w)
    ranked = ranked.withColumn("cap", (F.col("mix_source_size") * most).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = everything.orderBy("ratio", "k")
    ranked = (
        ranked.withColumn("budget", F.sum("mix_source_size").over(everything).cast("double") * share)
        .withColumn("full", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = (F.col("budget") - F.coalesce("full", F.lit(0.0))) / F.col("open_w")
    ranked = ranked.withColumn("level", F.when(F.col("ratio") > level, level))
    # In that order the level rises as long as sources saturate and falls from then on.
    ranked = ranked.withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return ranked.select("mix_source", "mix_source_size", "mix_class", target.alias("mix_target"))


def _inverse(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches a fraction of its whole."""
    pieces, total = [], 0.0
    for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
        pieces.append((total, t0, v0, (v1 - v0) / (t1 - t0)))
        total += (v0 + v1) / 2 * (t1 - t0)
    demand = fraction * total
    out = None
    for before, t0, v0, slope in pieces:
        rest = demand - before
        root = F.sqrt(F.greatest(F.lit(v0 * v0) + rest * (2 * slope), F.lit(0.0)))
        here = F.lit(t0) + F.try_divide(rest * 2, root + v0)
        out = here if out is None else F.when(demand >= before, here).otherwise(out)
    return F.least(F.greatest(F.coalesce(out, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, keep: Sequence[str] | None = None) -> DataFrame:
    """Decide for each document how often and when the mix takes it.

    Returns one row per row of ``docs`` with the columns ``keep`` (all, if None), mix_row
    (which tells rows apart, also those of one id) and mix_size, mix_source_size, mix_target (its source's), mix_positions: an ascending
    array of the training positions in [0, 1] of its 0 to ``most`` occurrences.  An
    occurrence is taken if the middle of its words lies within its source's target, so
    a source misses its target by half a document at most.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if not c.startswith("mix_")]
    base = docs.select(*keep, F.col(source_col).alias("mix_source"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("mix_key"), word_count(F.col(text_col)).alias("mix_size"))
    base = base.withColumn("mix_bucket", F.substring("mix_key", 1, 3)).withColumn("mix_null", F.col("mix_source").isNull()).withColumn("mix_name", F.coalesce("mix_source", F.lit("")))
    sums = written(base.groupBy("mix_source", "mix_null", "mix_name", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum")), "mix-sums")
    sizes = sums.groupBy("mix_source").agg(F.sum("mix_sum").alias("mix_source_size"))
    targets = source_targets(sizes, weights, share, most)
    before = Window.partitionBy("mix_null", "mix_name").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("mix_offset", F.coalesce(F.sum("mix_sum").over(before), F.lit(0)))
    offsets = offsets.select("mix_null", "mix_name", "mix_bucket", "mix_offset").join(targets.select(F.col("mix_source").isNull().alias("mix_null"), F.coalesce("mix_source", F.lit("")).alias("mix_name"), "mix_source_size", "mix_class", "mix_target"), ["mix_null", "mix_name"])
    placed = base.join(offsets, ["mix_null", "mix_name", "mix_bucket"])
    inside = Window.partitionBy("mix_null", "mix_name", "mix_bucket").orderBy("mix_key", "mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("mix_start", F.col("mix_offset") + F.sum("mix_size").over(inside) - F.col("mix_size"))
    placed = placed.withColumn("mix_row", F.struct("mix_source", "mix_bucket", F.row_number().over(inside).alias("mix_number")))

    def position(pass_: Column) -> Column:
        middle = F.col("mix_start") + pass_ * F.col("mix_source_size") + F.col("mix_size") / 2
        part = F.coalesce(F.try_divide(middle, F.col("mix_target")), F.lit(0.0))
        out = _inverse(part, schedules[0])
        for k, knots in enumerate(schedules[1:], 1):
            out = F.when(F.col("mix_class") == k, _inverse(part, knots)).otherwise(out)
        return out

    taken = [F.when(2 * (F.col("mix_start") + e * F.col("mix_source_size")) + F.col("mix_size") <= 2 * F.col("mix_target"), position(F.lit(e))) for e in range(most)]
    placed = placed.withColumn("mix_positions", F.array_compact(F.array(*taken)))
    return placed.select(*keep, "mix_row", "mix_size", "mix_source_size", "mix_target", "mix_positions")


def training_order(mixed: DataFrame, ties: Sequence[str] = (), absent: bool = False) -> DataFrame:
    """One row per occurrence, range-sorted by mix_position and then ``ties``; the pass is mix_epoch (from 0).

    With ``absent``, documents that the mix never takes follow at the end, with null positions.
    """
    columns = [c for c in mixed.columns if c != "mix_positions"]
    explode = F.posexplode_outer if absent else F.posexplode
    out = mixed.select(*columns, explode("mix_positions").alias("mix_epoch", "mix_position"))
    by = [F.col("mix_position").asc_nulls_last(), *ties]
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


def ranked(ordered: DataFrame) -> DataFrame:
    """Adds mix_rank, the place in the training order, gapless from 0; null for documents never taken.

    The order is written once, so the partitions that are counted are those that are numbered.
    """
    placed = written(ordered.withColumn("mix_at", F.monotonically_increasing_id()), "mix-order")
    placed = placed.withColumn("mix_part", F.shiftright("mix_at", 33))  # the upper bits are the partition, the lower the row
    before = Window.orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("mix_part").agg(F.count(F.lit(1)).alias("n")).select("mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    rank = F.when(F.col("mix_position").isNotNull(), F.col("mix_before") + F.col("mix_at").bitwiseAND((1 << 33) - 1))
    return placed.join(F.broadcast(parts), "mix_part").withColumn("mix_rank", rank).drop("mix_part", "mix_at", "mix_before")


def per_document(order: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per document of a ranked order: the words taken by its occurrences and the position of the first."""
    taken = F.sum(F.when(F.col("mix_rank").isNotNull(), F.col("mix_size")).otherwise(0))
    first = F.min_by("mix_position", "mix_rank")
    return order.groupBy("mix_row", *keep, "mix_size", "mix_source_size", "mix_target").agg(taken.alias("mix_taken"), first.alias("mix_position"))
