"""Bounded top-k per group that stays safe when one group holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, salt_on: list[str], buckets: int = SALT_BUCKETS) -> DataFrame:
    """Rows ranked ``<= k`` within each group by ``order`` (ties must be broken by ``order``).

    Two rounds: first inside ``(group, salt)`` slices, then over the at most
    ``k * buckets`` survivors per group, so no task ever ranks a whole hot group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    first = salted.withColumn("_rk", F.row_number().over(w1)).filter(F.col("_rk") <= k).drop("_rk", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return first.withColumn("_rank", F.row_number().over(w2)).filter(F.col("_rank") <= k)
