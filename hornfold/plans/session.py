"""Session settings the plans rely on when keys are skewed."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Shuffle partitions that adaptive execution starts from and then merges up to the size after it, so that a
#: task's share of a large shuffle doesn't grow with the data.
WIDE, TASK_BYTES = 1000, "16m"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when the next operator then has to shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Switch adaptive execution and its skew handling on; sizes that the session states are left as they are."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    wide = str(max(WIDE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sizes = {"coalescePartitions.initialPartitionNum": wide, "advisoryPartitionSizeInBytes": TASK_BYTES}
    for name, value in sizes.items():
        if spark.conf.get(f"spark.sql.adaptive.{name}", None) is None:
            spark.conf.set(f"spark.sql.adaptive.{name}", value)
    return spark
