"""Item states over a stream of operations (Spark's own addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apertura.operators.workflow import latest_state


def stream_states(ops: DataFrame, key: str = "item_id", order: list[str] = ["ts", "op_id"], state: list[str] = ["status"]) -> DataFrame:  # noqa: B006
    """Each item's state after its last operation so far; write it in update or complete mode. State is one row an item."""
    return latest_state(ops, key, order, state)


def windowed_operations(ops: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Operations and failures by window and kind; rows later than the watermark are left out, windows come once they are over."""
    return (
        ops.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "op")
        .agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Error").alias("n_failed"))
        .select(F.col("window.start").alias("start"), "op", "n", "n_failed")
    )
