"""Versions, snapshots, trash and blobs: numbering, retention, restore plans, storage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_violation
from ..functions.tiers import with_limits
from ..schemas import KEY, SCOPE
from .keys import in_segments, join_on, latest_wins, paginate


def assign_versions(writes: DataFrame, keys: Sequence[str] = tuple(KEY), order: Sequence[str] = ("seq",), segments: int = 1) -> DataFrame:
    """``writes`` with version_id, parent_version_id and archived (superseded by a later version).

    In order within a key: the first write is version 1 of parent 0; one whose hash differs from a live prior row's adds
    a version with that one as parent; an equal hash or a deleted prior row keeps the version.

    With more than one of ``segments``, a key's writes are cut by the first column of ``order`` and each segment is a task's; what
    lies on either side of a cut, and the versions before it, come from a row a key and segment. Both give the same.
    """
    if segments <= 1:
        w = Window.partitionBy(*keys).orderBy(*order)
        bump = _bumps(F.lag("content_hash").over(w), F.lag("deleted").over(w))
        flagged = writes.withColumn("__bump", bump)
        flagged = flagged.withColumns({"version_id": F.lit(1) + F.sum(F.col("__bump").cast("long")).over(w), "__next": F.lead("__bump").over(w)})
    else:
        cut = in_segments(writes, order[0], segments)
        place, sides = F.struct(*order), F.struct("content_hash", "deleted")
        ends = cut.groupBy(*keys, "__segment").agg(F.min_by(sides, place).alias("__first"), F.max_by(sides, place).alias("__end"))
        by_segment = Window.partitionBy(*keys).orderBy("__segment")
        ends = ends.select(*keys, "__segment", F.lag("__end").over(by_segment).alias("__above"), F.lead("__first").over(by_segment).alias("__below"))
        w = Window.partitionBy(*keys, "__segment").orderBy(*order)
        met = join_on(cut, ends, [*keys, "__segment"]).withColumn("__prior", F.coalesce(F.lag(sides).over(w), F.col("__above")))
        met = met.withColumn("__bump", _bumps(F.col("__prior")["content_hash"], F.col("__prior")["deleted"]))
        after = F.coalesce(F.lead(sides).over(w), F.col("__below"))
        met = met.withColumn("__next", after.isNotNull() & F.coalesce((after["content_hash"] != F.col("content_hash")) & ~F.col("deleted"), F.lit(False)))
        sums = met.groupBy(*keys, "__segment").agg(F.sum(F.col("__bump").cast("long")).alias("__sum"))
        carried = sums.select(*keys, "__segment", F.sum("__sum").over(by_segment.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
        version = F.lit(1) + F.coalesce("__carried", F.lit(0)) + F.sum(F.col("__bump").cast("long")).over(w)
        flagged = join_on(met, carried, [*keys, "__segment"]).withColumn("version_id", version)
    numbered = flagged.withColumns({"parent_version_id": F.col("version_id") - 1, "archived": F.coalesce("__next", F.lit(False))})
    return numbered.select(*writes.columns, "version_id", "parent_version_id", "archived")


def _bumps(hash_before: Column, deleted_before: Column) -> Column:
    return F.coalesce((hash_before != F.col("content_hash")) & ~deleted_before, F.lit(False))


def _pruned(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], tiers: DataFrame, most: str, as_of: int) -> DataFrame:
    limited = with_limits(join_on(rows, tiers.select("tenant_id", "plan_tier"), ["tenant_id"]))
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    stale = (F.col("created_at") < as_of - F.col("max_age_secs")) | (F.col("__rank") > F.col(most))
    drop = F.coalesce(stale, F.lit(False))
    return limited.withColumn("__rank", rank).select(*rows.columns, drop.alias("pruned"))


def prune_versions(history: DataFrame, tiers: DataFrame, as_of: int) -> DataFrame:
    """``history`` with ``pruned``: older than the tenant's tier keeps, or beyond its number of versions a path.

    A tenant without a tier has the free one; of a tenant of an unknown tier nothing is pruned.
    """
    return _pruned(history, KEY, [F.desc("version_id")], tiers, "max_versions", as_of)


def prune_snapshots(snapshots: DataFrame, tiers: DataFrame, as_of: int) -> DataFrame:
    """As prune_versions, for a vault's snapshots, newest (created_at, then snapshot_id) first."""
    return _pruned(snapshots, SCOPE, [F.desc("created_at"), F.desc("snapshot_id")], tiers, "max_snapshots", as_of)


def expire_trash(files: DataFrame, tiers: DataFrame, as_of: int) -> DataFrame:
    """Deleted rows with expires_at and ``purged`` (deleted before what the tier keeps; never without deleted_at)."""
    trash = with_limits(join_on(files.where("deleted"), tiers.select("tenant_id", "plan_tier"), ["tenant_id"]))
    purged = F.coalesce(F.col("deleted_at") < as_of - F.col("max_age_secs"), F.lit(False))
    return trash.select(*files.columns, (F.col("deleted_at") + F.col("max_age_secs")).alias("expires_at"), purged.alias("purged"))


def cleanup_conflicts(conflicts: DataFrame, as_of: int, ttl: int = 30 * 86400) -> DataFrame:
    """Conflicts without those resolved ``ttl`` seconds ago or earlier; unresolved ones stay for ever."""
    return conflicts.where(F.col("resolved_at").isNull() | (F.col("resolved_at") > as_of - ttl))


def active_tombstones(tombstones: DataFrame, as_of: int) -> DataFrame:
    return tombstones.where(F.col("ttl_expires") > as_of)


def latest_tombstone(tombstones: DataFrame) -> DataFrame:
    return latest_wins(tombstones, KEY, ["created_at"])


def version_history(history: DataFrame, live: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of every path's history, newest first, before it the current row (position 0, is_current)."""
    columns = [*KEY, "version_id", "content_hash", "size", "created_at"]
    page = paginate(history.select(*columns), KEY, [F.desc("version_id")], limit, offset).withColumn("is_current", F.lit(False))
    totals = history.groupBy(*KEY).agg(F.count("*").alias("total"))
    current = join_on(live.where("not deleted").select(*columns), totals, KEY)
    shown = min(max(limit, 1), 200) + min(max(offset, 0), 10_000)
    total = F.coalesce("total", F.lit(0))
    now = current.select(*columns, F.lit(0).cast("long").alias("position"), total.alias("total"), (total > shown).alias("has_more"), F.lit(True).alias("is_current"))
    return page.unionByName(now)




def listing(rows: DataFrame, kind: str, scope: Sequence[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of trash, snapshots, conflicts, consents, devices or vaults, in the order that each is shown in."""
    orders = {
        "trash": [F.desc("deleted_at"), F.asc("path")],
        "snapshots": [F.desc("created_at"), F.desc("snapshot_id")],
        "conflicts": [F.asc("created_at"), F.asc("conflict_id")],
        "consents": [F.asc("recorded_at"), F.asc("id")],
        "devices": [F.asc("registered_at"), F.asc("node_id")],
        "vaults": [F.asc("created_at"), F.asc("vault_id")],
    }
    source = rows.where("deleted") if kind == "trash" else rows
    return paginate(source, scope, orders[kind], limit, offset)


def snapshot_create(files: DataFrame, label: str, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(header per vault, rows): all rows are frozen and counted, bytes count live ones only."""
    header = files.groupBy(*SCOPE).agg(
        F.lit(label).alias("label"), F.lit(as_of).cast("long").alias("created_at"), F.count("*").alias("file_count"),
        F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("size"))), F.lit(0)).alias("bytes_total"),
    )
    rows = files.select(*KEY, F.coalesce("version_id", F.lit(1)).alias("version_id"), "content_hash", "size", "deleted")
    return header, rows


def blob_put(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """New blobs of ``incoming`` (content_hash, data), one for each hash, with the fan-out columns hh and rest.

    Append them with ``write.partitionBy("hh")``; what the store has is left alone.
    """
    fresh = incoming.join(store.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    return fresh.withColumns({"hh": F.substring("content_hash", 1, 2), "rest": F.substring(F.col("content_hash"), F.lit(3), F.lit(62))})


def with_blob_available(rows: DataFrame, store: DataFrame) -> DataFrame:
    known = store.select("content_hash").distinct().withColumn("blob_available", F.lit(True))
    return rows.join(known, "content_hash", "left").select(*rows.columns, F.coalesce("blob_available", F.lit(False)).alias("blob_available"))


def unreferenced_blobs(blobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Blobs whose hash no catalog row has; the catalog's hashes are made distinct first, for some repeat without end."""
    return blobs.join(catalog.select("content_hash").distinct(), "content_hash", "left_anti")


def restore_snapshot_plan(frozen: DataFrame, blobs: DataFrame, versions: DataFrame, live: DataFrame) -> DataFrame:
    """``frozen`` rows with status (restored, skipped, failed) and source (store, version, live).

    Deleted rows are skipped, unsafe paths fail; then the bytes come from the store by hash, from the hash of the same
    path and version, or from a live file of equal hash.
    """
    have = blobs.select("content_hash").distinct()
    old = versions.where("version_id > 0").select(*KEY, "version_id", F.col("content_hash").alias("__vh"))
    old = old.join(have.withColumnRenamed("content_hash", "__vh"), "__vh").select(*KEY, "version_id").distinct().withColumn("__version", F.lit(True))
    same = live.where("not deleted").select(*KEY, "content_hash").distinct().withColumn("__live", F.lit(True))
    out = frozen.join(have.withColumn("__blob", F.lit(True)), "content_hash", "left")
    out = join_on(join_on(out, old, [*KEY, "version_id"]), same, [*KEY, "content_hash"])
    fair = ~F.col("deleted") & path_violation(F.col("path")).isNull()
    source = F.when(fair & F.col("__blob").isNotNull(), "store").when(fair & F.col("__version").isNotNull(), "version").when(fair & F.col("__live").isNotNull(), "live")
    status = F.when(F.col("deleted"), "skipped").when(F.col("source").isNull(), "failed").otherwise("restored")
    return out.withColumn("source", source).withColumn("status", status).select(*frozen.columns, "status", "source")


def _packed(hash_: Column) -> Column:
    """A hash as bytes that are equal where hashes are: half as long where it is hexadecimal, for it to move in."""
    data = F.unhex(hash_)
    return F.when(F.lower(F.hex(data)) == hash_, F.concat(F.lit(bytearray(b"\0")), data)).otherwise(F.concat(F.lit(bytearray(b"\1")), F.encode(hash_, "UTF-8")))


def restore_version_plan(requests: DataFrame, live: DataFrame, versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """``requests`` (KEY, version_id) with status: invalid_id, already_current, not_found, blob_missing, content_equal, ok."""
    out = join_on(requests, versions.select(*KEY, "version_id", _packed(F.col("content_hash")).alias("__old")), [*KEY, "version_id"])
    out = join_on(out, live.select(*KEY, F.col("version_id").alias("__now"), _packed(F.col("content_hash")).alias("__hash")), KEY)
    known = (
        F.when(F.col("version_id") == 0, "invalid_id")
        .when(F.col("version_id") == F.col("__now"), "already_current")
        .when(F.col("__old").isNull(), "not_found")
    )
    found = F.when(F.col("__old") == F.col("__hash"), "content_equal").otherwise("ok")
    out = out.select(*requests.columns, known.alias("__known"), found.alias("__found"), F.when(known.isNull(), F.col("__old")).alias("__asked"))
    # Of what is settled no hash is looked for: a number deals those rows out, or a null hash would make them one task's.
    by = F.struct(F.col("__asked").alias("hash"), F.when(F.col("__asked").isNull(), F.xxhash64(*KEY, "version_id")).alias("number")).alias("__by")
    have = blobs.select(F.struct(_packed(F.col("content_hash")).alias("hash"), F.lit(None).cast("long").alias("number")).alias("__by"), F.lit(True).alias("__blob")).distinct()
    out = out.select(*requests.columns, "__known", "__found", by).join(have, "__by", "left")
    status = F.coalesce("__known", F.when(F.col("__blob").isNull(), "blob_missing").otherwise(F.col("__found")))
    return out.select(*requests.columns, status.alias("status"))


def restore_trash_plan(requests: DataFrame, live: DataFrame, blobs: DataFrame) -> DataFrame:
    """``requests`` (KEY) with status: not_found, not_in_trash, blob_missing, ok."""
    out = join_on(requests, live.select(*KEY, "deleted", "content_hash"), KEY)
    out = out.join(blobs.select("content_hash", F.lit(True).alias("__blob")).distinct(), "content_hash", "left")
    status = F.when(F.col("deleted").isNull(), "not_found").when(~F.col("deleted"), "not_in_trash").when(F.col("__blob").isNull(), "blob_missing").otherwise("ok")
    return out.select(*requests.columns, status.alias("status"))


def dedup_report(files: DataFrame) -> DataFrame:
    """Per vault: files, logical bytes, distinct contents and the bytes that storing each content once takes."""
    each = files.where("not deleted").groupBy(*SCOPE, "content_hash").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("one"))
    return each.groupBy(*SCOPE).agg(F.sum("n").alias("files"), F.sum("b").alias("logical_bytes"), F.count("*").alias("distinct_contents"), F.sum("one").alias("stored_bytes"))


def trash_scopes(files: DataFrame) -> DataFrame:
    """Scopes that hold trash."""
    return files.where("deleted").select(*SCOPE).distinct()
