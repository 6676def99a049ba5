"""Plan tiers: limits and retentions as a three-row table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIB, DAY = 1024**3, 86400
#: Tier, storage bytes, nodes, vaults, versions, snapshots, age limit of versions, snapshots and trash.
TIERS = [
    ("free", 5 * GIB, 2, 1, 5, 2, 7 * DAY),
    ("pro", 100 * GIB, 10, 5, 30, 20, 90 * DAY),
    ("team", 1024 * GIB, 50, 20, 100, 100, 365 * DAY),
]


def plan_tiers(spark: SparkSession) -> DataFrame:
    """plan_tier with its limits (storage, nodes, vaults) and retentions (versions, snapshots, age)."""
    return spark.createDataFrame(
        TIERS, "plan_tier string, max_storage_bytes long, max_nodes int, max_vaults int, max_versions int, max_snapshots int, max_age_secs long"
    )


def parse_tier(raw: Column) -> Column:
    """Canonical tier name, whatever the case; null for an unknown one."""
    low = F.lower(raw)
    return F.when(low.isin([t[0] for t in TIERS]), low)


def with_limits(rows: DataFrame, tier: str = "plan_tier") -> DataFrame:
    """Rows with the limits of their tier, in any case; a null tier counts as free, an unknown one has null limits."""
    dim = plan_tiers(rows.sparkSession).withColumnRenamed("plan_tier", "__tier")  # three rows
    return rows.join(F.broadcast(dim), parse_tier(F.coalesce(F.col(tier), F.lit("free"))) == F.col("__tier"), "left").drop("__tier")
