"""Places of rows in an order, within groups or overall, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.segments import durable

INSIDE = (1 << 33) - 1


def placed(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), place: str = "place", size: str | None = None) -> DataFrame:
    """Adds each row's place from 0 in its group, and with ``size`` the group's number of rows.

    Rows are sorted by ranges of group and order, so a group of any size lies over as many partitions as it needs. A row's
    place is its distance from its group's first row in its partition, and the group's rows in the partitions before; that table has a row per
    partition and group. Ties in all of ``order`` fall as they come: end it with a key.
    """
    keys = [*group, *order]
    ranged = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(INSIDE))})
    runs = ranged.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    if size:
        runs = runs.withColumn("_size", F.sum("_n").over(Window.partitionBy(*group)))
    named = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", "_before", *(["_size"] if size else []))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.join(named, same)
    added = [(F.col("_before") + F.col("_at") - F.col("_first")).alias(place), *([F.col("_size").alias(size)] if size else [])]
    return out.select(*df.columns, *added)


def quartiles_within(df: DataFrame, value: str, group: Sequence[str], tie: Sequence[str], m: int = 4, out: str = "quartile") -> DataFrame:
    """Adds the row's quartile by place within its group, cut at floor(n q / m); -1 in groups under m rows; rows without a value get -1."""
    ranked = placed(df.where(F.col(value).isNotNull()), [value, *tie], group, "_place", "_n")
    q = F.floor((m * F.col("_place") + m - 1) / F.col("_n")).cast("int")
    known = ranked.select(*df.columns, F.when(F.col("_n") < m, -1).otherwise(q).alias(out))
    return known.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(-1)))


def quantiles_by(df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles of a value per group, or of all rows: group columns and one column per name.

    They are read off at the places where they lie, so no aggregate holds a group's values.
    """
    known = placed(df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v")), ["_v"], group, "_place", "_n")
    at = lambda k: F.max(F.when(F.col("_place") == k, F.col("_v")))
    spot = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    ends = [c for name, x in spot.items() for c in (at(F.floor(x)).alias(f"_lo_{name}"), at(F.ceil(x)).alias(f"_hi_{name}"), F.max(x - F.floor(x)).alias(f"_part_{name}"))]
    out = known.groupBy(*group).agg(*ends)
    return out.select(*group, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in probs])
