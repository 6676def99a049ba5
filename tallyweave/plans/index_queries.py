"""Registered queries on index health, versions, snapshots, trash and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tiers import with_limits
from ..operators import index, versions
from ..operators.keys import upsert
from ..schemas import KEY, SCOPE, ZERO_HASH
from .fixtures import AS_OF, query, view
from .reconcile_queries import same
from .registry import register

_TIER = """tier AS (SELECT t.tenant_id, t.plan_tier AS raw, l.* FROM tenants t LEFT JOIN (VALUES ('free', 5368709120, 2, 1, 5, 2, 604800), ('pro', 107374182400, 10, 5, 30, 20, 7776000), ('team', 1099511627776, 50, 20, 100, 100, 31536000))
  l(name, storage, max_nodes, max_vaults, versions, snapshots, age) ON l.name = lower(coalesce(t.plan_tier, 'free')))"""


# Index


def _scan_prior(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scan = view(spark, sf_dir, "local_files").withColumn("content_hash", F.lit(None).cast("string")).select(*KEY, "size", "mtime_ns", "content_hash", "vector_clock")
    prior = view(spark, sf_dir, "indexed_files").withColumn("mtime_ns", F.expr("if(doc_id % 4 = 0, mtime_ns + 1, mtime_ns)")).select(*KEY, "size", "mtime_ns", "content_hash", "vector_clock")
    return scan, prior


@register(
    f"""SELECT l.tenant_id, l.vault_id, l.path, coalesce(i.size = l.size AND i.doc_id % 4 <> 0, false) AS reused, CASE WHEN i.size = l.size AND i.doc_id % 4 <> 0 THEN i.content_hash END AS content_hash
    FROM local_files l LEFT JOIN indexed_files i ON {same('l', 'i')}"""
)
def fastpath_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, miss = index.fastpath_hash(*_scan_prior(spark, sf_dir))
    return hit.select(*KEY, F.lit(True).alias("reused"), "content_hash").unionByName(miss.select(*KEY, F.lit(False).alias("reused"), F.lit(None).cast("string").alias("content_hash")))


_TREE = "SELECT CASE WHEN doc_id % 10 = 0 THEN '../' || path ELSE path END AS path, size FROM local_files"


@register(
    f"""SELECT CAST(count(*) FILTER (path NOT LIKE '..%') AS BIGINT) AS files_seen, CAST(sum(size) FILTER (path NOT LIKE '..%') AS BIGINT) AS bytes_total, count(*) FILTER (path NOT LIKE '..%') AS files_imported, count(*) FILTER (path LIKE '..%') AS escapes_blocked FROM ({_TREE}) t"""
)
def seed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.seed_index(query(spark, sf_dir, _TREE), "seeded", "node-1")[1]


_PAIR = f"listing d FULL JOIN index_rows i ON {same('d', 'i')}"
_REPAIR = """CASE WHEN d.path IS NOT NULL AND i.path IS NULL THEN 'upsert' WHEN d.path IS NOT NULL AND i.deleted THEN 'revive' WHEN d.path IS NOT NULL AND d.content_hash = i.content_hash AND d.size = i.size THEN 'keep'
  WHEN d.path IS NOT NULL THEN 'upsert' WHEN NOT i.deleted THEN 'tombstone' ELSE 'keep' END"""


@register(f"SELECT coalesce(d.tenant_id, i.tenant_id) AS tenant_id, coalesce(d.vault_id, i.vault_id) AS vault_id, coalesce(d.path, i.path) AS path, {_REPAIR} AS action FROM {_PAIR}")
def index_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_repair(view(spark, sf_dir, "listing"), view(spark, sf_dir, "index_rows"))


@register(f"SELECT coalesce(d.tenant_id, i.tenant_id) AS tenant_id, coalesce(d.vault_id, i.vault_id) AS vault_id, {_REPAIR} AS action, count(*) AS n FROM {_PAIR} GROUP BY ALL")
def index_repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.repair_counts(index_repair(spark, sf_dir))


_SHADOW = """SELECT tenant_id, vault_id, path FROM base UNION ALL SELECT tenant_id, 'default' AS vault_id, path FROM base WHERE doc_id % 10 IN (0, 5)
UNION ALL SELECT tenant_id, 'default' AS vault_id, 'only/' || path AS path FROM base WHERE doc_id % 10 = 1"""
_SHARES = "SELECT DISTINCT tenant_id, vault_id FROM base WHERE vault_id <> 'v1' UNION ALL SELECT DISTINCT 't3' AS tenant_id, 'default' AS vault_id FROM base"


@register(
    f"""WITH f AS ({_SHADOW}), s AS ({_SHARES}) SELECT tenant_id, vault_id, path FROM f WHERE NOT (vault_id = 'default' AND tenant_id IS DISTINCT FROM 't3'
      AND EXISTS (SELECT 1 FROM f o JOIN s ON {same('s', 'o', 'tenant_id vault_id')} WHERE o.vault_id <> 'default' AND o.tenant_id IS NOT DISTINCT FROM f.tenant_id AND o.path = f.path))"""
)
def sweep_shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sweep_shadowed(query(spark, sf_dir, _SHADOW), query(spark, sf_dir, _SHARES))[0].select(*KEY)


@register(
    f"""WITH x AS (SELECT i.*, l.kind, i.vault_id <> 'v2' AS rooted FROM index_rows i LEFT JOIN listing l ON {same('i', 'l')}), y AS (SELECT *, rooted AND coalesce(kind = 'symlink', false) AS link FROM x), z AS (SELECT *, rooted AND NOT link AS c FROM y)
    SELECT tenant_id, vault_id, count(*) FILTER (c AND NOT deleted) AS live, count(*) FILTER (c AND deleted) AS tombstoned, count(*) FILTER (c AND deleted AND kind = 'file') AS tombstoned_but_present,
      count(*) FILTER (c AND deleted AND kind = 'dir') AS tombstoned_dirs, count(*) FILTER (c AND NOT deleted AND kind IS NULL) AS live_but_missing, count(*) FILTER (link) AS behind_symlink, count(*) FILTER (NOT rooted) AS unrooted,
      count(*) FILTER (length(content_hash) <> 64) AS bad_hash FROM z GROUP BY ALL"""
)
def audit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "index_rows")
    return index.audit_index(rows, view(spark, sf_dir, "listing"), rows.select(*SCOPE).distinct().where("vault_id <> 'v2'"))


@register(
    f"""WITH p AS (SELECT tenant_id, vault_id, path FROM base WHERE doc_id % 3 = 0) SELECT coalesce(p.tenant_id, i.tenant_id) AS tenant_id, coalesce(p.vault_id, i.vault_id) AS vault_id, coalesce(p.path, i.path) AS path,
      coalesce(i.content_hash, '{ZERO_HASH}') AS content_hash, coalesce(i.size, 0) AS size, p.path IS NOT NULL OR i.deleted AS deleted, CASE WHEN p.path IS NOT NULL THEN {AS_OF} ELSE i.deleted_at END AS deleted_at
    FROM index_rows i FULL JOIN p ON {same('i', 'p')}"""
)
def tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = view(spark, sf_dir, "base").where("doc_id % 3 = 0").select(*KEY)
    return index.tombstone(view(spark, sf_dir, "index_rows").drop("doc_id"), paths, AS_OF)


@register("SELECT tenant_id, vault_id, created_at FROM vaults UNION ALL SELECT * FROM (SELECT tenant_id, vault_id, CAST(-1 AS BIGINT) AS created_at FROM files GROUP BY ALL) f WHERE NOT EXISTS (SELECT 1 FROM vaults v WHERE " + same("v", "f", "tenant_id vault_id") + ")")
def register_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.register_vaults(view(spark, sf_dir, "vaults"), view(spark, sf_dir, "files").select(*SCOPE, F.lit(-1).cast("long").alias("created_at")))


@register("SELECT tenant_id, vault_id, path, deleted AND o_orderkey % 2 <> 0 AS deleted, CASE WHEN NOT (deleted AND o_orderkey % 2 = 0) THEN deleted_at END AS deleted_at FROM files")
def restore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    return index.restore_rows(files, files.where("o_orderkey % 2 = 0")).select(*KEY, "deleted", "deleted_at")


@register("SELECT tenant_id, vault_id, count(*) AS kept, count(*) FILTER (deleted) AS trash FROM files WHERE NOT (deleted AND vault_id = '1-URGENT') GROUP BY ALL")
def empty_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    kept, _ = index.empty_trash(files, files.where("vault_id = '1-URGENT'"))
    return kept.groupBy(*SCOPE).agg(F.count("*").alias("kept"), F.count_if("deleted").alias("trash"))


@register("SELECT tenant_id, vault_id, path FROM files WHERE deleted AND o_orderkey % 7 = 0")
def delete_trash_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    return index.delete_trash_items(files, files.where("o_orderkey % 7 = 0"))[1].select(*KEY)


@register(
    f"""SELECT coalesce(r.tenant_id, i.tenant_id) AS tenant_id, coalesce(r.vault_id, i.vault_id) AS vault_id, coalesce(r.path, i.path) AS path, coalesce(r.content_hash, i.content_hash) AS content_hash, coalesce(r.size, i.size) AS size,
      coalesce(i.mtime_ns, r.mtime_ns) AS mtime_ns FROM indexed_files i FULL JOIN remote_files r ON {same('i', 'r')}"""
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*KEY, "content_hash", "size", "mtime_ns"]
    remote = view(spark, sf_dir, "remote_files").select(*columns).withColumn("mtime_ns", F.col("mtime_ns"))
    return upsert(view(spark, sf_dir, "indexed_files").select(*columns), remote, KEY, preserve=["mtime_ns"])


# Versions, snapshots, trash


@register(
    """WITH w AS (SELECT *, coalesce(lag(content_hash) OVER p <> content_hash AND NOT lag(deleted) OVER p, false) AS bump FROM writes WINDOW p AS (PARTITION BY tenant_id, vault_id, path ORDER BY seq)), v AS (
      SELECT *, 1 + CAST(sum(CAST(bump AS INTEGER)) OVER (PARTITION BY tenant_id, vault_id, path ORDER BY seq) AS BIGINT) AS version_id, coalesce(lead(bump) OVER (PARTITION BY tenant_id, vault_id, path ORDER BY seq), false) AS archived FROM w)
    SELECT tenant_id, vault_id, path, seq, version_id, version_id - 1 AS parent_version_id, archived FROM v"""
)
def assign_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.assign_versions(view(spark, sf_dir, "writes")).select(*KEY, "seq", "version_id", "parent_version_id", "archived")


@register(
    f"""WITH {_TIER}, h AS (SELECT h.*, row_number() OVER (PARTITION BY h.tenant_id, h.vault_id, path ORDER BY version_id DESC) AS rn FROM history h)
    SELECT h.tenant_id, h.vault_id, count(*) AS n, count(*) FILTER (CASE WHEN tier.raw IS NULL THEN created_at < {AS_OF} - 604800 OR rn > 5 ELSE created_at < {AS_OF} - age OR rn > tier.versions END) AS pruned FROM h LEFT JOIN tier ON tier.tenant_id IS NOT DISTINCT FROM h.tenant_id GROUP BY ALL"""
)
def prune_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = versions.prune_versions(view(spark, sf_dir, "history"), view(spark, sf_dir, "tenants"), AS_OF)
    return out.groupBy(*SCOPE).agg(F.count("*").alias("n"), F.count_if("pruned").alias("pruned"))


_SNAPS = "SELECT tenant_id, vault_id, doc_id AS snapshot_id, 990000000 + (doc_id % 40) * 604800 - 604800 * 20 AS created_at FROM base"


@register(
    f"""WITH {_TIER}, s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, vault_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM ({_SNAPS}) q)
    SELECT s.tenant_id, s.vault_id, s.snapshot_id, coalesce(created_at < {AS_OF} - age OR rn > snapshots, false) AS pruned FROM s LEFT JOIN tier ON tier.tenant_id IS NOT DISTINCT FROM s.tenant_id"""
)
def prune_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.prune_snapshots(query(spark, sf_dir, _SNAPS), view(spark, sf_dir, "tenants"), AS_OF).drop("created_at")


@register(
    f"""WITH {_TIER} SELECT f.tenant_id, f.vault_id, f.path, deleted_at + age AS expires_at, coalesce(deleted_at < {AS_OF} - age, false) AS purged FROM files f LEFT JOIN tier ON tier.tenant_id IS NOT DISTINCT FROM f.tenant_id WHERE deleted"""
)
def expire_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.expire_trash(view(spark, sf_dir, "files"), view(spark, sf_dir, "tenants"), AS_OF).select(*KEY, "expires_at", "purged")


@register(f"SELECT conflict_id, resolution, resolved_at FROM conflicts WHERE resolved_at IS NULL OR resolved_at > {AS_OF} - 2592000")
def cleanup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.cleanup_conflicts(view(spark, sf_dir, "conflicts"), AS_OF).select("conflict_id", "resolution", "resolved_at")


_TOMBS = "SELECT tenant_id, vault_id, path, seq, created_at, created_at + 259200 AS ttl_expires FROM writes"


@register(f"SELECT tenant_id, vault_id, path, created_at FROM ({_TOMBS}) t WHERE ttl_expires > 500000")
def active_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.active_tombstones(query(spark, sf_dir, _TOMBS), 500000).select(*KEY, "created_at")


@register(f"SELECT tenant_id, vault_id, path, max(created_at) AS created_at, max(ttl_expires) AS ttl_expires FROM ({_TOMBS}) t GROUP BY tenant_id, vault_id, path")
def latest_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_tombstone(query(spark, sf_dir, _TOMBS)).select(*KEY, "created_at", "ttl_expires")


@register(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, vault_id, path ORDER BY version_id DESC) AS position, count(*) OVER (PARTITION BY tenant_id, vault_id, path) AS total FROM history)
    SELECT tenant_id, vault_id, path, version_id, position, total, 15 < total AS has_more, false AS is_current FROM r WHERE position BETWEEN 6 AND 15
    UNION ALL SELECT tenant_id, vault_id, path, max(version_id) + 1, 0, count(*), 15 < count(*), true FROM history GROUP BY tenant_id, vault_id, path"""
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = view(spark, sf_dir, "history")
    live = history.groupBy(*KEY).agg((F.max("version_id") + 1).alias("version_id")).withColumns({"content_hash": F.lit(""), "size": F.lit(0).cast("long"), "created_at": F.lit(0).cast("long"), "deleted": F.lit(False)})
    return versions.version_history(history, live, 10, 5).select(*KEY, "version_id", "position", "total", "has_more", "is_current")


def _page(source: str, scope: str, order: str, columns: str) -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {order}) AS position, count(*) OVER (PARTITION BY {scope}) AS total FROM ({source}) q)
    SELECT {columns}, position, total, 20 < total AS has_more FROM r WHERE position <= 20"""


@register(_page("SELECT * FROM files WHERE deleted", "tenant_id, vault_id", "deleted_at DESC NULLS LAST, path", "tenant_id, vault_id, path"))
def trash_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing(view(spark, sf_dir, "files"), "trash", SCOPE, 20).select(*KEY, "position", "total", "has_more")


@register(_page(_SNAPS, "tenant_id, vault_id", "created_at DESC, snapshot_id DESC", "tenant_id, vault_id, snapshot_id"))
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing(query(spark, sf_dir, _SNAPS), "snapshots", SCOPE, 20).select(*SCOPE, "snapshot_id", "position", "total", "has_more")


@register(_page("SELECT * FROM conflicts", "tenant_id", "created_at, conflict_id", "tenant_id, conflict_id"))
def conflict_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing(view(spark, sf_dir, "conflicts"), "conflicts", ["tenant_id"], 20).select("tenant_id", "conflict_id", "position", "total", "has_more")


_CONSENTS = "SELECT user_id, event_id AS id, event_id % 50 AS recorded_at FROM $events"


@register(_page(_CONSENTS, "user_id", "recorded_at, id", "user_id, id"))
def consent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing(query(spark, sf_dir, _CONSENTS), "consents", ["user_id"], 20).select("user_id", "id", "position", "total", "has_more")


@register(_page("SELECT * FROM nodes", "tenant_id", "registered_at, node_id", "tenant_id, node_id"))
def device_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing(view(spark, sf_dir, "nodes"), "devices", ["tenant_id"], 20).select("tenant_id", "node_id", "position", "total", "has_more")


@register(_page("SELECT * FROM vaults", "tenant_id", "created_at, vault_id", "tenant_id, vault_id"))
def vault_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing(view(spark, sf_dir, "vaults"), "vaults", ["tenant_id"], 20).select(*SCOPE, "position", "total", "has_more")


@register(f"SELECT tenant_id, vault_id, 'weekly' AS label, CAST({AS_OF} AS BIGINT) AS created_at, count(*) AS file_count, CAST(coalesce(sum(size) FILTER (NOT deleted), 0) AS BIGINT) AS bytes_total FROM files GROUP BY ALL")
def snapshot_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.snapshot_create(view(spark, sf_dir, "files"), "weekly", AS_OF)[0]


@register("SELECT tenant_id, vault_id, path, coalesce(version_id, 1) AS version_id, content_hash, size, deleted FROM files")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.snapshot_create(view(spark, sf_dir, "files"), "weekly", AS_OF)[1]


_STORE = "SELECT DISTINCT content_hash FROM files WHERE o_orderkey % 997 < 400"


@register(f"WITH s AS ({_STORE}) SELECT DISTINCT content_hash, left(content_hash, 2) AS hh, substr(content_hash, 3) AS rest FROM files WHERE content_hash NOT IN (SELECT content_hash FROM s)")
def blob_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.blob_put(query(spark, sf_dir, _STORE), view(spark, sf_dir, "files").select("content_hash"))


@register(f"WITH s AS ({_STORE}) SELECT tenant_id, vault_id, path, content_hash IN (SELECT content_hash FROM s) AS blob_available FROM files")
def with_blob_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.with_blob_available(view(spark, sf_dir, "files").select(*KEY, "content_hash"), query(spark, sf_dir, _STORE)).drop("content_hash")


@register("SELECT DISTINCT content_hash FROM files WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE o_orderkey % 13 = 0 AND o_orderkey % 997 < 500)")
def unreferenced_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    return versions.unreferenced_blobs(files.select("content_hash").distinct(), files.where("o_orderkey % 13 = 0 and o_orderkey % 997 < 500"))


_FROZEN = "SELECT tenant_id, vault_id, CASE WHEN o_orderkey % 29 = 0 THEN '/' || path ELSE path END AS path, coalesce(version_id, 1) AS version_id, content_hash, size, deleted FROM files"
_OLD = "SELECT tenant_id, vault_id, path, coalesce(version_id, 1) AS version_id, sha2(CAST(o_orderkey % 350 AS STRING), 256) AS content_hash FROM files WHERE o_orderkey % 2 = 0"


@register(
    f"""WITH b AS ({_STORE}), f AS ({_FROZEN}), v AS ({_OLD.replace("sha2(CAST(o_orderkey % 350 AS STRING), 256)", "sha256(CAST(o_orderkey % 350 AS STRING))")}), l AS (SELECT * FROM files WHERE NOT deleted AND o_orderkey % 5 <> 0), m AS (
      SELECT f.*, f.content_hash IN (SELECT content_hash FROM b) AS has, EXISTS (SELECT 1 FROM v WHERE {same('v', 'f', 'tenant_id vault_id path version_id')} AND v.version_id > 0 AND v.content_hash IN (SELECT content_hash FROM b)) AS ver,
        EXISTS (SELECT 1 FROM l WHERE {same('l', 'f')} AND l.content_hash = f.content_hash) AS liv FROM f)
    SELECT tenant_id, vault_id, path, CASE WHEN deleted THEN 'skipped' WHEN path LIKE '/%' OR NOT (has OR ver OR liv) THEN 'failed' ELSE 'restored' END AS status,
      CASE WHEN deleted OR path LIKE '/%' THEN NULL WHEN has THEN 'store' WHEN ver THEN 'version' WHEN liv THEN 'live' END AS source FROM m"""
)
def restore_snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = view(spark, sf_dir, "files").where("o_orderkey % 5 <> 0")
    return versions.restore_snapshot_plan(query(spark, sf_dir, _FROZEN), query(spark, sf_dir, _STORE), query(spark, sf_dir, _OLD), live).select(*KEY, "status", "source")


_REQ = "SELECT tenant_id, vault_id, path, version_id - 1 AS version_id FROM history"
_LIVE = "SELECT tenant_id, vault_id, path, max(version_id) - 2 AS version_id, max(content_hash) AS content_hash FROM history GROUP BY tenant_id, vault_id, path"


@register(
    f"""WITH q AS ({_REQ}), l AS ({_LIVE}), b AS (SELECT content_hash FROM history WHERE size % 3 <> 0), j AS (SELECT q.*, l.version_id AS now, l.content_hash AS lh, v.content_hash AS vh FROM q LEFT JOIN l ON {same('q', 'l')} LEFT JOIN history v ON {same('q', 'v', 'tenant_id vault_id path version_id')})
    SELECT tenant_id, vault_id, CASE WHEN version_id = 0 THEN 'invalid_id' WHEN version_id = now THEN 'already_current' WHEN vh IS NULL THEN 'not_found' WHEN vh NOT IN (SELECT content_hash FROM b) THEN 'blob_missing' WHEN vh = lh THEN 'content_equal' ELSE 'ok' END AS status, count(*) AS n
    FROM j GROUP BY ALL"""
)
def restore_version_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = view(spark, sf_dir, "history")
    plan = versions.restore_version_plan(query(spark, sf_dir, _REQ), query(spark, sf_dir, _LIVE), history, history.where("size % 3 <> 0"))
    return plan.groupBy(*SCOPE, "status").agg(F.count("*").alias("n"))


@register(
    f"""WITH b AS ({_STORE}), q AS (SELECT tenant_id, vault_id, CASE WHEN o_orderkey % 17 = 0 THEN 'x' || path ELSE path END AS path FROM files)
    SELECT q.tenant_id, q.vault_id, q.path, CASE WHEN f.path IS NULL THEN 'not_found' WHEN NOT f.deleted THEN 'not_in_trash' WHEN f.content_hash NOT IN (SELECT content_hash FROM b) THEN 'blob_missing' ELSE 'ok' END AS status
    FROM q LEFT JOIN files f ON {same('q', 'f')}"""
)
def restore_trash_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = query(spark, sf_dir, "SELECT tenant_id, vault_id, CASE WHEN o_orderkey % 17 = 0 THEN 'x' || path ELSE path END AS path FROM files")
    return versions.restore_trash_plan(requests, view(spark, sf_dir, "files"), query(spark, sf_dir, _STORE))


@register(
    """WITH h AS (SELECT tenant_id, vault_id, content_hash, count(*) AS n, sum(size) AS b, max(size) AS one FROM indexed_files WHERE NOT deleted GROUP BY ALL)
    SELECT tenant_id, vault_id, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS logical_bytes, count(*) AS distinct_contents, CAST(sum(one) AS BIGINT) AS stored_bytes FROM h GROUP BY tenant_id, vault_id"""
)
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.dedup_report(view(spark, sf_dir, "indexed_files"))


@register("SELECT DISTINCT tenant_id, vault_id FROM files WHERE deleted")
def trash_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.trash_scopes(view(spark, sf_dir, "files"))


@register(f"WITH {_TIER} SELECT tenant_id, raw AS plan_tier, storage AS max_storage_bytes, max_nodes, max_vaults, versions AS max_versions, snapshots AS max_snapshots, CAST(age AS BIGINT) AS max_age_secs FROM tier")
def tier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_limits(view(spark, sf_dir, "tenants"))
