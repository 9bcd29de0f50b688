"""As-of join: each left row with the nearest right row of its key in time, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(left: DataFrame, right: DataFrame, by: str, ts: str, *, direction: str = "backward", tolerance: int | None = None, bucket: int = 86_400) -> DataFrame:
    """All rows of ``left`` with ``matched``, a struct of the right row before, after or nearest to it in time, or null.

    Both sides have the key ``by`` and the timestamp ``ts``. Right rows at the same time as the left one match in
    every direction; of several at one time the greatest row counts; of two equally near the earlier. A match further away
    than ``tolerance`` seconds is none. Rows whose key or time is null stay without a match.

    Rows are grouped by key and time bucket of ``bucket`` seconds, so a hot key lies in as many groups as it has
    buckets. Each bucket's first and last right rows are found by a partial aggregate and carried over the
    buckets of the key, one row each; they stand in for all right rows outside a bucket.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    names = [c for c in left.columns if c != "matched"]
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket * 1_000_000))
    point = F.struct(F.col(ts).alias("__at"), F.struct(*right.columns).alias("__point"))
    rights = right.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(F.col(by).alias("__by"), slot.alias("__slot"), point.alias("__right"))
    lefts = left.select(F.col(by).alias("__by"), slot.alias("__slot"), F.struct(*names).alias("__left"), F.col(ts).alias("__ts"))
    timed = F.col("__by").isNotNull() & F.col("__ts").isNotNull()
    # Of equal times the greatest row, on both ends of a bucket.
    ends = rights.groupBy("__by", "__slot").agg(F.max("__right").alias("__last"))
    first = rights.groupBy("__by", "__slot", F.col("__right.__at").alias("__at")).agg(F.max("__right").alias("__right"))
    first = first.groupBy("__by", "__slot").agg(F.min("__right").alias("__first"))
    slots = lefts.where(timed).select("__by", "__slot").distinct().join(ends, ["__by", "__slot"], "full_outer").join(first, ["__by", "__slot"], "left")
    along = Window.partitionBy("__by").orderBy("__slot")
    carried = slots.select(
        "__by", "__slot",
        F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
        F.first("__first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__later"),
    )
    both = lefts.where(timed).withColumn("__right", F.lit(None).cast(rights.schema["__right"].dataType)).unionByName(
        rights.select("__by", "__slot", F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"), F.col("__right.__at").alias("__ts"), "__right")
    )
    inside = Window.partitionBy("__by", "__slot").orderBy("__ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("__by", "__slot").orderBy(F.col("__ts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # A point's time comes first in it, so the greatest before and the least after are the nearest.
    back = F.max("__right").over(inside)
    same = Window.partitionBy("__by", "__slot", "__ts")
    found = both.withColumns({"__back": back, "__here": F.max("__right").over(same)})
    found = found.withColumn("__ahead", F.min("__here").over(after))
    rows = found.where(F.col("__left").isNotNull()).join(carried, ["__by", "__slot"], "left")
    earlier, later = F.coalesce("__back", "__earlier"), F.coalesce("__ahead", "__later")
    away = lambda r: F.abs(F.unix_micros(r["__at"].cast("timestamp")) - F.unix_micros(F.col("__ts").cast("timestamp")))
    chosen: Column = {
        "backward": earlier,
        "forward": later,
        "nearest": F.when(later.isNull() | (away(earlier) <= away(later)), earlier).otherwise(later),
    }[direction]
    rows = rows.withColumn("__chosen", chosen)
    near = F.col("__chosen") if tolerance is None else F.when(away(F.col("__chosen")) <= tolerance * 1_000_000, F.col("__chosen"))
    done = rows.select("__left", near["__point"].alias("matched"))
    rest = lefts.where(~timed).select("__left", F.lit(None).cast(done.schema["matched"].dataType).alias("matched"))
    return done.unionByName(rest).select(*[F.col("__left")[c].alias(c) for c in names], "matched")
