"""Helpers that several operators share: work tables, the held-out fold, source keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from apertura.sources.worktables import shared_dir, written  # noqa: F401


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; rows without an id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The type that a column has in the batches of mapInArrow."""
    return to_arrow_type(df.schema[column].dataType)


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """Sorted rows, in ranges of about equal size whatever a key's share of the rows."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def runs(batches: Iterator[pa.RecordBatch], size: int, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of sorted ones with the same first column, at most ``size`` at a time.

    With ``weight`` the values of that column are added up to ``size`` instead; a row that is above by itself comes alone.
    """
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        cuts = [0, *(np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        upto = np.arange(batch.num_rows + 1) if weight is None else np.append(0, np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = key[a].as_py()
            if held and own != last:
                yield joined()
                held, n = [], 0
            last = own
            while a < b:
                end = min(b, int(np.searchsorted(upto, upto[a] + size - n, side="right")) - 1)
                if end <= a:
                    if held:
                        yield joined()
                        held, n = [], 0
                        continue
                    end = a + 1
                held.append(batch.slice(a, end - a))
                n, a = n + int(upto[end] - upto[a]), end
    if held:
        yield joined()
