"""Keyed state kept as tables: streams on which one key may bring most of a micro-batch.

Here a micro-batch is judged as a table, sorted and cut by Spark, so a key's rows of one trigger need not fit in memory as they
must for ``streaming.state``. Under ``path`` lie the judged rows (``rows/batch=<n>``) and what keys stand at (``state/v=<n>``): the keys of
each micro-batch, and every ``compact``-th time all of them. A batch done again writes its folders again, so a restart leaves
one result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.governance import revision_bump
from ..operators.keys import join_on, latest_wins, running
from .events import COMPACT, drop_versions, index_versions, last_whole

Judge = Callable[[DataFrame, DataFrame | None], DataFrame]


def judged_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows judged so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def state_after(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int | None = None, compact: int = COMPACT) -> DataFrame | None:
    """What keys stand at after a micro-batch that is still kept, by default the newest; null before the first."""
    if batch_id is None:
        batch_id = index_versions(spark, f"{path}/state")[-1]
    if batch_id < 0:
        return None
    folders = [f"{path}/state/v={v}" for v in range(last_whole(batch_id, compact), batch_id + 1)]
    return latest_wins(spark.read.option("basePath", f"{path}/state").parquet(*folders), keys, ["v"]).drop("v")


def judged_stream(stream: DataFrame, keys: Sequence[str], judge: Judge, settle: Judge, path: str, checkpoint: str, compact: int = COMPACT):
    """Start a query: ``judge(batch, state)`` gives a micro-batch's rows, ``settle(rows, state)`` where its keys then stand.

    The state is null in the first micro-batch. Rows are written before they are settled, so a batch is judged once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = state_after(spark, path, keys, batch_id - 1, compact)
        rows, folder = judge(batch, before), f"{path}/rows/batch={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        after = settle(spark.read.schema(rows.schema).parquet(folder), before)
        if before is not None and batch_id % compact == 0:
            after = after.unionByName(join_on(before, after, keys, "left_anti"))
        after.write.mode("overwrite").parquet(f"{path}/state/v={batch_id}")
        drop_versions(spark, f"{path}/state", last_whole(batch_id - 1, compact))  # this batch, done again, would read from there

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_guard_table(messages: DataFrame, path: str, checkpoint: str, segments: int = 1, compact: int = COMPACT):
    """Judge messages (key, event_id, sequence), accepted when above all that the key has shown; ``segments`` as in ``replay_check``.

    A null sequence is not accepted and leaves none behind.
    """

    def judge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        seen = running(batch, ["key"], ["event_id"], F.col("sequence"), "max", "__seen", segments)
        seen = join_on(seen, before, ["key"]) if before is not None else seen.withColumn("__last", F.lit(None).cast("long"))
        above = F.col("sequence") > F.greatest(F.coalesce("__seen", F.lit(0)), F.coalesce("__last", F.lit(0)))
        return seen.select(*batch.columns, F.coalesce(above, F.lit(False)).alias("accepted"))

    def settle(rows: DataFrame, before: DataFrame | None) -> DataFrame:
        top = rows.groupBy("key").agg(F.max("sequence").cast("long").alias("__top"))
        met = join_on(top, before, ["key"]) if before is not None else top.withColumn("__last", F.lit(None).cast("long"))
        return met.select("key", F.greatest("__top", "__last").alias("__last"))

    return judged_stream(messages, ["key"], judge, settle, path, checkpoint, compact)


def revision_table(writes: DataFrame, path: str, checkpoint: str, segments: int = 1, compact: int = COMPACT):
    """Judge writes (path, event_id, expected) with the event to send and the path's revision; ``segments`` as in ``revision_bump``."""

    def judge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        judged = revision_bump(batch, ["path"], ["event_id"], before, segments)
        event = F.when(F.col("status") == "applied", "agent.write_ok").otherwise("agent.write_conflict")
        return judged.select(*batch.columns, event.alias("event"), "revision")

    def settle(rows: DataFrame, before: DataFrame | None) -> DataFrame:
        return rows.groupBy("path").agg(F.max("revision").alias("revision"))  # a conflict's row has the current one

    return judged_stream(writes, ["path"], judge, settle, path, checkpoint, compact)
