"""Gapless numbers over sorted rows, from counts of ranges and their running sums; no window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apertura.sources.worktables import written

#: How monotonically_increasing_id is made up: the partition's number above a row's place in it.
PLACE_BITS = 33


def numbered(df: DataFrame, *order: Column, name: str = "seq", start: int = 1) -> DataFrame:
    """``df`` with a number, from ``start`` on and without gaps, in the order of ``order``.

    Rows are sorted into ranges of about equal size and written with their place in the range, so that a
    task done again can't give them other numbers. Only the ranges' counts, a row for each, are then added
    up. The numbers don't depend on partitions where ``order`` tells all rows apart; rows that it doesn't
    tell apart share a range and get any order among them. An empty table stays empty; a column called
    ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    placed = df.select(*kept).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    table = written(placed, "numbered")
    range_no = F.shiftright("__place", PLACE_BITS)
    counts = table.groupBy(range_no.alias("__range")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    within = F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # One row for each range, at most as many as shuffle partitions.
    joined = table.withColumn("__range", range_no).join(F.broadcast(offsets), "__range")
    return joined.select(*kept, (F.col("__before") + within + F.lit(start)).alias(name))


def load_order(batch: DataFrame, *order: Column, loaded: DataFrame | None = None, name: str = "load_seq") -> DataFrame:
    """A batch with its load sequence, which continues after the highest number of what is ``loaded``.

    Without rows loaded before it starts at 1. Numbers of rows without one (null) are passed over.
    """
    last = loaded.agg(F.max(name)).first()[0] if loaded is not None else None
    return numbered(batch, *order, name=name, start=(last or 0) + 1)


def numbered_within(df: DataFrame, group: str, *order: Column, name: str = "nth") -> DataFrame:
    """``df`` with each row's number within its ``group``, from 1 on, in the order of ``order``.

    Rows are sorted by group and order into ranges, so that a group of any size lies in as many ranges as
    it fills. A group's counts in earlier ranges are carried on; no task holds more of a group than one
    range. A null group is a group; a column called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    by = F.col(group).asc_nulls_first()
    placed = df.select(*kept).repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__place", F.monotonically_increasing_id())
    table = written(placed, "numbered").withColumn("__range", F.shiftright("__place", PLACE_BITS))
    counts = table.groupBy("__range", F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__rows"), F.min("__place").alias("__first"))
    # One row for each range that a group reaches into.
    before = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(F.col("__range").alias("__at"), "__group", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    same = (F.col("__range") == F.col("__at")) & F.col(group).eqNullSafe(F.col("__group"))
    nth = F.col("__before") + F.col("__place") - F.col("__first") + 1
    return table.join(carried, same).select(*kept, nth.alias(name))


#: What numbered file names look like; names that look so already are always numbered, so none can meet another's.
NUMBERED_NAME = r" \([0-9]+\)(\.[^.]*)?$"


def unique_names(df: DataFrame, column: str, *order: Column, name: str = "unique_name") -> DataFrame:
    """``df`` with ``name``: the file name in ``column``, with `` (2)``, `` (3)`` ... before the extension where it came before.

    Names that end in such a number already always get one more, so all results differ. Null names stay null.
    """
    kept = [c for c in df.columns if c not in (name, "__nth")]
    done = numbered_within(df.select(*kept), column, *order, name="__nth")
    text, ending = F.col(column), F.regexp_extract(column, r"(\.[^.]*)$", 1)
    stem = F.substring(text, F.lit(1), F.length(text) - F.length(ending))
    plain = (F.col("__nth") == 1) & ~F.regexp_like(text, F.lit(NUMBERED_NAME))
    return done.select(*kept, F.when(plain, text).otherwise(F.concat(stem, F.lit(" ("), F.col("__nth").cast("string"), F.lit(")"), ending)).alias(name))
