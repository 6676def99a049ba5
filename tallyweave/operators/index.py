"""Health of a file index: seeding, repair against the disk, audits, and table mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_violation
from ..schemas import KEY, SCOPE, ZERO_HASH
from .keys import insert_ignore, join_on, upsert


def fastpath_hash(scan: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the prior hash, rows to hash): a prior row of equal size and mtime spares reading the file."""
    known = prior.select(*KEY, *[F.col(c).alias(f"__{c}") for c in ("size", "mtime_ns", "content_hash", "vector_clock")])
    joined = join_on(scan.drop("content_hash", "vector_clock"), known, KEY)
    same = F.coalesce((F.col("size") == F.col("__size")) & (F.col("mtime_ns") == F.col("__mtime_ns")), F.lit(False))
    drop = ["__size", "__mtime_ns", "__content_hash", "__vector_clock"]
    clock = F.coalesce("__vector_clock", F.create_map().cast("map<string,long>")).alias("vector_clock")
    base = [F.col(c) for c in joined.columns if c not in drop]
    return joined.where(same).select(*base, F.col("__content_hash").alias("content_hash"), clock), joined.where(~same).select(*base, clock)


def seed_index(manifest: DataFrame, vault_id: str, node_id: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index rows, report): a tree's files as live rows of one vault; unsafe paths are counted and left out."""
    bad = path_violation(F.col("path")).isNotNull()
    rows = manifest.where(~bad).withColumns({"vault_id": F.lit(vault_id), "node_id": F.lit(node_id), "deleted": F.lit(False)})
    n = F.count_if(~bad)
    report = manifest.agg(
        n.alias("files_seen"), F.coalesce(F.sum(F.when(~bad, F.col("size"))), F.lit(0)).alias("bytes_total"),
        (F.lit(0).cast("long") if dry_run else n).alias("files_imported"), F.count_if(bad).alias("escapes_blocked"),
    )
    return rows, report


def index_repair(disk: DataFrame, index: DataFrame) -> DataFrame:
    """KEY, action: what brings an index in line with a disk listing.

    upsert (new or changed), revive (a deleted row whose file is there), tombstone (a live row without file), keep.
    """
    left = disk.select(*KEY, F.struct("content_hash", "size").alias("d"))
    right = index.select(*KEY, F.struct("content_hash", "size", "deleted").alias("i"))
    d, i = F.col("d"), F.col("i")
    action = (
        F.when(d.isNotNull() & i.isNull(), "upsert")
        .when(d.isNotNull() & i["deleted"], "revive")
        .when(d.isNotNull() & (d["content_hash"] == i["content_hash"]) & (d["size"] == i["size"]), "keep")
        .when(d.isNotNull(), "upsert")
        .when(~i["deleted"], "tombstone")
        .otherwise("keep")
    )
    return join_on(left, right, KEY, "full_outer").select(*KEY, action.alias("action"))


def repair_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy(*SCOPE, "action").agg(F.count("*").alias("n"))


def sweep_shadowed(files: DataFrame, shares: DataFrame, default: str = "default") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows of the default vault whose path also lives in a configured share of the tenant go.

    ``shares`` (tenant_id, vault_id) are the configured ones; where the default vault is one of them nothing goes.
    """
    own = shares.where(F.col("vault_id") == default).select("tenant_id").distinct()
    shadow = join_on(files.where(F.col("vault_id") == default), own, ["tenant_id"], "left_anti")
    claimed = join_on(files.where(F.col("vault_id") != default), shares.distinct(), SCOPE, "left_semi").select("tenant_id", "path").distinct()
    removed = join_on(shadow, claimed, ["tenant_id", "path"], "left_semi")
    return join_on(files, removed.select(*KEY), KEY, "left_anti"), removed


def audit_index(index: DataFrame, listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Per scope: live, tombstoned, tombstoned_but_present, tombstoned_dirs, live_but_missing, behind_symlink, unrooted, bad_hash.

    ``listing`` (KEY, kind: file, dir or symlink) is what is on the disk; ``roots`` (SCOPE) the vaults with a root. Rows
    behind a link are counted there only, rows of a vault without a root as unrooted only.
    """
    seen = join_on(join_on(index, listing.select(*KEY, "kind"), KEY), roots.select(*SCOPE, F.lit(True).alias("rooted")), SCOPE)
    rooted = F.coalesce("rooted", F.lit(False))
    link = rooted & F.coalesce(F.col("kind") == "symlink", F.lit(False))
    counted = rooted & ~link
    gone, file, folder = F.col("deleted"), F.coalesce(F.col("kind") == "file", F.lit(False)), F.coalesce(F.col("kind") == "dir", F.lit(False))
    return seen.groupBy(*SCOPE).agg(
        F.count_if(counted & ~gone).alias("live"),
        F.count_if(counted & gone).alias("tombstoned"),
        F.count_if(counted & gone & file).alias("tombstoned_but_present"),
        F.count_if(counted & gone & folder).alias("tombstoned_dirs"),
        F.count_if(counted & ~gone & F.col("kind").isNull()).alias("live_but_missing"),
        F.count_if(link).alias("behind_symlink"),
        F.count_if(~rooted).alias("unrooted"),
        F.count_if(F.length("content_hash") != 64).alias("bad_hash"),
    )


def tombstone(index: DataFrame, paths: DataFrame, as_of: int) -> DataFrame:
    """The index with ``paths`` (KEY) deleted: known rows keep hash, size and clock, unknown ones get a zero hash."""
    known = join_on(paths.select(*KEY).distinct(), index, KEY)
    values = {"deleted": F.lit(True), "deleted_at": F.lit(as_of).cast("long"), "content_hash": F.coalesce("content_hash", F.lit(ZERO_HASH)), "size": F.coalesce("size", F.lit(0))}
    return upsert(index, known.withColumns({k: v for k, v in values.items() if k in index.columns}), KEY)


def register_vaults(vaults: DataFrame, seen: DataFrame) -> DataFrame:
    """Vaults with the scopes of ``seen`` added where they are new; known ones keep their rows."""
    return insert_ignore(vaults, seen, SCOPE)


def restore_rows(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index with trashed rows of ``paths`` alive again; live rows stay as they are."""
    marked = join_on(index, paths.select(*KEY, F.lit(True).alias("__back")).distinct(), KEY)
    back = F.coalesce("__back", F.lit(False)) & F.col("deleted")
    return marked.withColumns({"deleted": F.col("deleted") & ~back, "deleted_at": F.when(~back, F.col("deleted_at"))}).drop("__back")


def empty_trash(files: DataFrame, scopes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): deleted rows of the named scopes (all, if none are) go."""
    gone = files.where("deleted")
    removed = join_on(gone, scopes.select(*SCOPE).distinct(), SCOPE, "left_semi") if scopes is not None else gone
    return join_on(files, removed.select(*KEY), KEY, "left_anti"), removed


def delete_trash_items(files: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the deleted rows among ``items`` (KEY) go."""
    removed = join_on(files.where("deleted"), items.select(*KEY).distinct(), KEY, "left_semi")
    return join_on(files, removed.select(*KEY), KEY, "left_anti"), removed
