"""An object catalog: upsert, prefix listing, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import upsert


def object_put(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """``catalog`` with ``incoming`` put in by path; a known object keeps the time it was created at."""
    return upsert(catalog, incoming, ["path"], preserve=["created_at_ns"])


def object_list(catalog: DataFrame, prefix: str, limit: int = 1000) -> DataFrame:
    """Objects whose path starts with ``prefix`` (taken literally, case counts), by path, ``limit`` at most."""
    return catalog.where(F.startswith("path", F.lit(prefix))).orderBy("path").limit(limit)


def object_rename(catalog: DataFrame, moves: DataFrame, as_of_ns: int) -> tuple[DataFrame, DataFrame]:
    """(catalog after, moves with status): status is not_found, already_exists or ok.

    ``moves`` (source, target). A target is taken if the catalog has it or an earlier move (by source) goes there.
    """
    from pyspark.sql import Window

    paths = catalog.select("path")
    rows = moves.join(paths.select(F.col("path").alias("source"), F.lit(True).alias("__has")), "source", "left")
    rows = rows.join(paths.select(F.col("path").alias("target"), F.lit(True).alias("__taken")), "target", "left")
    able = F.col("__has").isNotNull() & F.col("__taken").isNull()
    first = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(able), "source")) == 1
    status = F.when(F.col("__has").isNull(), "not_found").when(F.col("__taken").isNotNull() | ~first, "already_exists").otherwise("ok")
    judged = rows.select(*moves.columns, status.alias("status"))
    done = judged.where("status = 'ok'").groupBy("source").agg(F.min("target").alias("__to"))
    after = catalog.join(done, catalog["path"] == done["source"], "left")
    moved = F.col("__to").isNotNull()
    values = {"path": F.coalesce("__to", "path"), "mtime_ns": F.when(moved, F.lit(as_of_ns).cast("long")).otherwise(F.col("mtime_ns"))}
    return after.select(*[values[c].alias(c) if c in values else F.col(c) for c in catalog.columns]), judged
