"""Ranks and order statistics that do not put a whole hot group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import checkpointed

def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where NULL is a group of its own; right-hand key columns are dropped."""
    renamed = right.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(renamed["_r_" + k]) for k in keys]
    return left.join(renamed, cond, how).drop(*["_r_" + k for k in keys])


def _offset(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beside the offsets of their group. There can be as many groups as rows, of which the planner, who guesses from the size of
    compressed files, would send all to every task by way of the driver."""
    return join_groups(rows, offsets.hint("merge"), keys)


def ranked(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "seq", descending: bool = False) -> DataFrame:
    """``row_number() over (partition by <by> order by <bucket>, <order>)`` in two levels.

    ``bucket`` is a coarse, order-preserving cut of the sort key (a day, a block of numbers). Rows are
    numbered inside (group, bucket); the counts of the earlier buckets are added. Only the counts of
    a group, never its rows, meet in one task.
    """
    by = list(by)
    b = df.withColumn("__bucket", bucket)
    inner = Window.partitionBy(*by, "__bucket").orderBy(*order)
    numbered = b.withColumn("__n", F.row_number().over(inner))
    counts = b.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy(F.desc("__bucket") if descending else F.asc("__bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    joined = _offset(numbered, offsets, by + ["__bucket"])
    return joined.withColumn(out, F.col("__n") + F.col("__before")).drop("__bucket", "__n", "__before")


def range_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, out: str, deal: Sequence[Column] = ()) -> DataFrame:
    """Sum of a value up to and including each row of a group, in ``order``, for sort keys that no cheap cut fits (texts).

    One exchange by ranges of (group, order), whose cuts Spark takes from the data, spreads the rows evenly whatever prefixes
    the keys share; sums run inside (group, range), and the ranges' totals of a group are added up. The ranges are
    stored before they are used, so a lost executor cannot move a row into another one. Rows that tie in ``order``
    stay in one range, so it should end with columns that tell rows apart. ``deal`` names a coarser order to cut the ranges
    by: the cuts come from a sample that the driver sorts, so what is dealt by should be short.
    """
    by = list(by)
    dealt = df.repartitionByRange(*[F.col(c) for c in by], *(deal or order))
    placed = checkpointed(dealt.withColumn("__range", F.spark_partition_id()).withColumn("__value", value))
    inner = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "__range").agg(F.sum("__value").alias("__c"))
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    summed = placed.withColumn("__n", F.sum("__value").over(inner))
    joined = _offset(summed, offsets, by + ["__range"])
    return joined.withColumn(out, F.col("__n") + F.col("__before")).drop("__range", "__value", "__n", "__before")


def range_ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "seq") -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` by ranges of the data (``range_running``)."""
    return range_running(df, by, order, F.lit(1).cast("bigint"), out)


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, positions: dict[str, Callable[[Column], Column]], weight: str | None = None
) -> DataFrame:
    """Exact elements of the sorted values of each group at 0-based positions computed from the count.

    Values are counted first, so a value held by a third of the rows is one row. The counts are dealt by ranges of (group,
    value), whose cuts come from the data, so that an outlier costs nothing; the ranges' totals tell which of them
    hold a wanted position, and only those are looked into.
    """
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    one = F.lit(1) if weight is None else F.col(weight)
    counts = src.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(one).alias("_c"))
    dealt = counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value))
    placed = checkpointed(dealt.withColumn("_cut", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_cut").agg(F.sum("_c").alias("_s"))
    # A group's ranges, not its values, meet in one task.
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_total", F.sum("_s").over(group))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), at(F.col("_total")).cast("bigint").alias("at")) for k, at in positions.items()])
    inside = lambda t, low, size: (t.at >= low) & (t.at < low + size)
    held = sums.select(*keys, "_cut", "_base", F.filter(wanted, lambda t: inside(t, F.col("_base"), F.col("_s"))).alias("_ws")).where(F.size("_ws") > 0)
    inner = Window.partitionBy(*keys, "_cut").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    walked = join_groups(placed, held, keys + ["_cut"]).withColumn("_lo", F.col("_base") + F.coalesce(F.sum("_c").over(inner), F.lit(0)))
    hit = lambda k: F.exists("_ws", lambda t: (t.k == k) & inside(t, F.col("_lo"), F.col("_c")))
    picks = [F.max(F.when(hit(k), F.col(value))).alias(k) for k in positions]
    return walked.groupBy(*keys).agg(*picks).drop("_all")


def at_fraction(p: float) -> Callable[[Column], Column]:
    """Position ``round((n-1)*p)``, half to even: an element, not an interpolation."""
    return lambda n: F.bround((n - 1) * F.lit(p))


def at_floor(p: float) -> Callable[[Column], Column]:
    """Position ``int((n-1)*p)``."""
    return lambda n: F.floor((n - 1) * F.lit(p))


#: Positions of the two middle elements, whose mean is the median.
MIDDLE: dict[str, Callable[[Column], Column]] = {"_lo_mid": at_floor(0.5), "_hi_mid": lambda n: F.ceil((n - 1) * F.lit(0.5))}


def middle_mean() -> Column:
    return (F.col("_lo_mid") + F.col("_hi_mid")) / 2


def median_of(df: DataFrame, by: Sequence[str], value: str, out: str = "median", weight: str | None = None) -> DataFrame:
    """Exact median: mean of the lower and upper middle elements."""
    return order_statistics(df, by, value, MIDDLE, weight).select(*by, middle_mean().alias(out))


def running_total(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Sum of a value up to and including each row in (bucket, order), in the same two levels as ``ranked``."""
    by = list(by)
    b = df.withColumn("__bucket", bucket).withColumn("__value", value)
    inner = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = b.withColumn("__n", F.sum("__value").over(inner))
    totals = b.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    joined = _offset(summed, offsets, by + ["__bucket"])
    return joined.withColumn(out, F.col("__n") + F.col("__before")).drop("__bucket", "__value", "__n", "__before")
