"""Positions of turns in their conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.blocks import prefix
from tidewheel.session import settle


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """Number rows from 1 within `keys` by `order` (NULL first). Equal rows are counted first and dealt out again, so they get positions of their own.

    Rows are dealt by ranges of keys and order, so one key may hold any share of them.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    ranged = settle(counted.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    ended = prefix(ranged, keys, {"_end": ("sum", "_n")}, order=order, block=F.col("_range"))
    each = F.explode(F.sequence(F.col("_end") - F.col("_n") + 1, F.col("_end")))
    return ended.select(*rows.columns, each.alias(out))
