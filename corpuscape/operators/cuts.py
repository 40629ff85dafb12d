"""The n-th smallest key of a table of any size, as a value to filter by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Key ranges of one round, and the keys that are few enough to be ordered in one task.
RANGES = 64
FEW_KEYS = 5_000


def _literal(value) -> Column:
    if isinstance(value, Row):
        return F.struct(*[F.lit(v).alias(name) for name, v in value.asDict().items()])
    return F.lit(value)


def nth_smallest(keys: DataFrame, n: int) -> Column:
    """Scalar: the n-th smallest value of the one column of ``keys`` (n >= 1), whose values are
    unique; the largest where there are fewer.

    Row counts per key range locate the range in which the n-th key lies, and the same is done
    within that range until few keys are left. Each round moves only the keys of the open range, one
    row per range reaches the driver, and what the last task orders does not grow with the table.
    """
    key = keys.columns[0]
    inside, left = keys, n
    while True:
        ranged = inside.repartitionByRange(RANGES, F.col(key))
        counts = ranged.groupBy(F.spark_partition_id().alias("range")).agg(
            F.count("*").alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        found = None
        for found in sorted(counts.where("low is not null").collect(), key=lambda r: r["low"]):
            if left <= found["n_rows"]:
                break
            left -= found["n_rows"]
        else:
            return _literal(found["high"]) if found else F.lit(None)
        inside = keys.where(F.col(key).between(_literal(found["low"]), _literal(found["high"])))
        if found["n_rows"] <= FEW_KEYS or found["low"] == found["high"]:
            return inside.orderBy(key).limit(left).agg(F.max(key)).scalar()
