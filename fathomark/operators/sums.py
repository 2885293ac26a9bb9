"""Sums of arrays over all rows, in two levels: per task, per salt, and at last per key.

A partial is an array of fixed length (a gradient, a block of moments), so what moves depends on the model and on the
number of tasks, and no group is larger than the square root of that number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salts_for(df: DataFrame) -> int:
    """About the square root of the number of tasks that a shuffle has, a bound for the partials in one group."""
    return max(2, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def added(parts: DataFrame, keys: Sequence[str], part: str = "part") -> DataFrame:
    """(keys, part): the element-wise sum of the arrays of each key."""
    keys = list(keys)
    total = Summarizer.metrics("sum").summary(F.col("_v")).alias("_s")
    rows = parts.select(*keys, array_to_vector(F.col(part)).alias("_v"), F.pmod(F.spark_partition_id(), F.lit(salts_for(parts))).alias("_salt"))
    half = rows.groupBy(*keys, "_salt").agg(total).select(*keys, F.col("_s.sum").alias("_v"))
    return half.groupBy(*keys).agg(total).select(*keys, vector_to_array("_s.sum").alias(part))
