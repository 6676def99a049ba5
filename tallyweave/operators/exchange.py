"""What follows from reconciled actions: client lists, baselines, tombstones, conflict records, include rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, fork_filename, is_ephemeral_marker, normalize_rel
from ..schemas import KEY, SCOPE
from .keys import join_on, upsert

#: How each conflict kind is best resolved.
SUGGESTED = {"concurrent": "merge", "modified_deleted": "keep-local", "rename_rename": "fork-local", "dir_delete_child_modify": "keep-local"}
#: Roles that may write to a share, and roles that may read from it.
WRITE_ROLES, READ_ROLES = ("bidirectional", "send_only", "publisher"), ("bidirectional", "receive_only")


def filter_includes(rows: DataFrame, includes: DataFrame, scope: list[str]) -> DataFrame:
    """Rows whose scope has no include rule, or whose path is one of its rules or lies below one.

    ``includes`` has ``scope`` and ``prefix``. Rules below other rules of their scope say nothing more and go, so a path has at
    most one rule left among its ancestors: rows are read once, meet their scope's depths, are repeated for the ancestors between these,
    and the one that is a rule stays. A null path or prefix lies nowhere, but a null prefix makes its scope a ruled one.
    """
    rules = includes.select(*scope, F.col("prefix").alias("__rule")).distinct()
    above = rules.select(*scope, F.col("__rule").alias("__below"), F.explode(F.filter(ancestors(F.col("__rule")), lambda a: a != F.col("__rule"))).alias("__rule"))
    nested = join_on(above, rules, [*scope, "__rule"], "left_semi").select(*scope, F.col("__below").alias("__rule")).distinct()
    top = join_on(rules, nested, [*scope, "__rule"], "left_anti").withColumn("__hit", F.lit(True))
    depth = F.coalesce(F.size(F.split("__rule", "/")), F.lit(1))
    scopes = rules.groupBy(*scope).agg(F.min(depth).alias("__least"), F.max(depth).alias("__most"))
    met = join_on(rows, scopes, scope)
    able = F.slice(ancestors(F.col("path")), F.col("__least"), F.col("__most") - F.col("__least") + 1)
    spread = met.withColumn("__rule", F.explode(F.when(F.col("__least").isNull(), F.array(F.lit(None).cast("string"))).otherwise(able)))
    return join_on(spread, top, [*scope, "__rule"]).where("__hit or __least is null").select(*rows.columns)


def replace_includes(current: DataFrame, wanted: DataFrame, scope: list[str]) -> DataFrame:
    """Rule sets after ``wanted`` (scope, prefixes: array): each named scope's set is replaced whole.

    Prefixes are normalised, sorted and made distinct; one that cannot be rejects its whole set, and the old one stays.
    """
    cleaned = wanted.withColumn("clean", F.transform("prefixes", lambda p: normalize_rel(p))).where(~F.exists("clean", lambda p: p.isNull()))
    kept = join_on(current.select(*scope, "prefix"), cleaned.select(*scope), scope, "left_anti")
    return kept.unionByName(cleaned.select(*scope, F.explode(F.array_sort(F.array_distinct("clean"))).alias("prefix")))


def exchange_response(actions: DataFrame, client: DataFrame, roles: DataFrame | None = None, includes: DataFrame | None = None) -> DataFrame:
    """SCOPE, path, list, resolution: the server's actions as a client's lists.

    An upload of the server is a download of the client and the other way round; deletions of either side go to
    to_delete; forks and merges are conflicts with a suggestion. Markers are dropped. ``roles`` (SCOPE, role): a receive_only
    client uploads nothing and takes forks as downloads. Include rules bind all lists but the conflicts.
    """
    rows = actions.where(~is_ephemeral_marker(F.col("path")))
    rows = join_on(rows, roles.select(*SCOPE, "role"), SCOPE) if roles is not None else rows.withColumn("role", F.lit(None).cast("string"))
    rows = join_on(rows, client.select(*KEY, F.lit(True).alias("__client")), KEY)
    quiet = F.coalesce(F.col("role") == "receive_only", F.lit(False))
    forked = F.col("action").isin("conflict_fork", "conflict_merge")
    route = (
        F.when(F.col("action") == "upload", "to_download")
        .when((F.col("action") == "download") & ~quiet, "to_upload")
        .when(F.col("action").isin("delete_local", "delete_remote"), "to_delete")
        .when(forked & quiet, "to_download")
        .when(forked, "conflicts")
    )
    suggestion: Column = F.lit(None).cast("string")
    for kind, fix in SUGGESTED.items():
        suggestion = F.when(F.col("conflict.kind") == kind, fix).otherwise(suggestion)
    routed = rows.withColumn("list", route).where("list is not null")
    out = routed.select(*KEY, "list", F.when(F.col("list") == "conflicts", suggestion).alias("resolution"))
    if includes is None:
        return out
    return filter_includes(out.where("list <> 'conflicts'"), includes, SCOPE).unionByName(out.where("list = 'conflicts'"))


def post_sync_baseline(server: DataFrame, client: DataFrame, actions: DataFrame, as_of: int) -> DataFrame:
    """The baseline a client has once it acted: server rows, client rows for downloads, tombstones for deletions.

    Forks and renames leave none; nor do paths without the row they would come from.
    """
    columns = [c for c in server.columns if c not in KEY]
    row = lambda df, name: df.select(*KEY, F.struct(*columns).alias(name))
    both = join_on(join_on(actions.select(*KEY, "action"), row(server, "s"), KEY), row(client, "c"), KEY)
    removed = F.col("action").isin("delete_local", "delete_remote")
    pick = F.when(F.col("action").isin("upload", "skip") | removed, F.col("s")).when(F.col("action") == "download", F.col("c"))
    picked = both.withColumn("b", pick).where("b is not null")
    values = {c: F.col("b")[c] for c in columns}
    values["deleted"] = F.col("b.deleted") | removed
    if "deleted_at" in columns:
        values["deleted_at"] = F.when(removed, F.lit(as_of).cast("long")).otherwise(F.col("b.deleted_at"))
    return picked.select(*KEY, *[v.alias(c) for c, v in values.items()]).select(*server.columns)


def tombstone_fanout(server: DataFrame, actions: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(server after, events): live rows that a delete_local action removes, and an event for each."""
    gone = actions.where("action = 'delete_local'").select(*KEY).distinct()
    hit = join_on(server.where("not deleted"), gone, KEY, "left_semi").withColumns({"deleted": F.lit(True), "deleted_at": F.lit(as_of).cast("long")})
    events = hit.select(*KEY, F.lit("sync.file_deleted").alias("event"), F.lit(as_of).cast("long").alias("at"))
    return upsert(server, hit, KEY), events


def record_conflicts(actions: DataFrame, node_id: str, as_of: int) -> DataFrame:
    """A conflict row for each conflicting action, with the name a fork would get and no resolution yet.

    conflict_id is a digest of tenant (null: empty), vault and path, each on its line, so ids need no order within a vault.
    """
    rows = actions.where("conflict is not null")
    fork = F.when(F.col("action") == "conflict_fork", fork_filename(F.col("path"), F.lit(node_id), F.lit(as_of).cast("long")))
    return rows.select(
        *KEY,
        F.sha2(F.concat_ws("\n", F.coalesce("tenant_id", F.lit("")), "vault_id", "path"), 256).alias("conflict_id"),
        F.col("conflict.kind").alias("conflict_type"),
        *[F.col(f"conflict.{s}_hash").alias(f"{s}_hash") for s in ("local", "remote", "base")],
        fork.alias("fork_path"),
        F.lit(None).cast("string").alias("resolution"),
        F.lit(as_of).cast("long").alias("created_at"),
    )


def overlay_versions(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Scan rows with the version ids of the index row of their normalised path."""
    ids = index.select(*SCOPE, normalize_rel(F.col("path")).alias("__norm"), F.col("version_id").alias("__v"), F.col("parent_version_id").alias("__p"))
    ids = ids.groupBy(*SCOPE, "__norm").agg(F.max(F.struct("__v", "__p")).alias("__ids"))
    joined = join_on(scan.withColumn("__norm", normalize_rel(F.col("path"))), ids, [*SCOPE, "__norm"]).drop("__norm")
    return joined.withColumns({"version_id": F.col("__ids.__v"), "parent_version_id": F.col("__ids.__p")}).drop("__ids")


def overlay_wire_hash(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Scan rows with cached hash and nonce where size and mtime agree and the nonce is not empty; else needs_encrypt."""
    known = cache.select(*KEY, *[F.col(c).alias(f"__{i}") for i, c in enumerate(("size", "mtime_ns", "content_hash", "encryption_nonce"))])
    hit = F.coalesce((F.col("__0") == F.col("size")) & (F.col("__1") == F.col("mtime_ns")) & (F.octet_length("__3") > 0), F.lit(False))
    out = join_on(scan, known, KEY)
    return out.withColumns(
        {"needs_encrypt": ~hit, "content_hash": F.when(hit, F.col("__2")).otherwise(F.col("content_hash")), "encryption_nonce": F.when(hit, F.col("__3")).otherwise(F.col("encryption_nonce"))}
    ).drop("__0", "__1", "__2", "__3")


def resolve_roles(requests: DataFrame, acl: DataFrame, healthy: Column | None = None, allowed: tuple[str, ...] = WRITE_ROLES) -> tuple[DataFrame, DataFrame]:
    """(decisions, audit rows): the role of (cert_fp, share), or why there is none.

    An unhealthy table answers ``unavailable``, a missing entry ``share_unknown``; a role outside ``allowed`` is a
    role_mismatch. Whatever is not ok becomes an audit row.
    """
    keys = ["cert_fp", "share"]
    joined = join_on(requests, acl.select(*keys, "role"), keys)
    ok = healthy if healthy is not None else F.lit(True)
    verdict = F.when(~ok, "unavailable").when(F.col("role").isNull(), "share_unknown").when(~F.col("role").isin(*allowed), "role_mismatch").otherwise("ok")
    decided = joined.withColumn("verdict", verdict)
    kind = F.when(F.col("verdict") == "share_unknown", "share.unknown").when(F.col("verdict") == "role_mismatch", "acl.role_mismatch").otherwise("acl.load_failure")
    audits = decided.where("verdict <> 'ok'").select(kind.alias("kind"), *keys, F.to_json(F.struct("role", "verdict")).alias("payload_json"))
    return decided, audits
