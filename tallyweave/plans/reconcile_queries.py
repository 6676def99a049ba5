"""Registered queries on reconciliation and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import vc_advance, vc_get, vc_happens_before, vc_merge, vc_text
from ..functions.clocks import vc_compare as compare
from ..operators import exchange, reconcile
from ..operators.keys import latest_wins as last_rows
from ..schemas import KEY, SCOPE
from .fixtures import AS_OF, query, view
from .registry import register


def same(a: str, b: str, keys: str = "tenant_id vault_id path") -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys.split())


def three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, sf_dir, f"{s}_files").drop("text", "doc_id", "node_id") for s in ("local", "remote", "indexed"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*three(spark, sf_dir), fold=True)


#: The decision table over outer joins, and rename folding, as the oracle sees them.
_SIDES = f"""
keys AS (SELECT tenant_id, vault_id, path FROM local_files UNION SELECT tenant_id, vault_id, path FROM remote_files UNION SELECT tenant_id, vault_id, path FROM indexed_files),
s AS (
  SELECT k.*, l.content_hash AS lh, r.content_hash AS rh, i.content_hash AS ih, l.inode AS linode, i.inode AS iinode,
    CASE WHEN l.path IS NULL THEN 'N' WHEN l.deleted THEN 'T' ELSE 'P' END || CASE WHEN r.path IS NULL THEN 'N' WHEN r.deleted THEN 'T' ELSE 'P' END || CASE WHEN i.path IS NULL THEN 'N' WHEN i.deleted THEN 'T' ELSE 'P' END AS st,
    coalesce(l.content_hash = r.content_hash, false) AS lr, coalesce(l.content_hash = i.content_hash, false) AS li, coalesce(r.content_hash = i.content_hash, false) AS ri,
    (l.ca < r.ca OR l.cb < r.cb) AS lt, (l.ca > r.ca OR l.cb > r.cb) AS gt
  FROM keys k LEFT JOIN local_files l ON {same('k', 'l')} LEFT JOIN remote_files r ON {same('k', 'r')} LEFT JOIN indexed_files i ON {same('k', 'i')}
), raw AS (
  SELECT *, CASE
    WHEN st = 'PNN' THEN 'upload' WHEN st IN ('NPN', 'NPT') THEN 'download' WHEN st = 'PPN' THEN CASE WHEN lr THEN 'skip' ELSE 'conflict_fork' END
    WHEN st = 'PPP' THEN CASE WHEN li AND ri THEN 'skip' WHEN ri THEN 'upload' WHEN li THEN 'download' WHEN lr THEN 'skip' WHEN lt AND NOT gt THEN 'download' WHEN gt AND NOT lt THEN 'upload' ELSE 'conflict_fork' END
    WHEN st = 'TPP' THEN CASE WHEN ri THEN 'delete_remote' ELSE 'download' END WHEN st = 'PTP' THEN CASE WHEN li THEN 'delete_local' ELSE 'upload' END
    WHEN st LIKE 'TT_' THEN 'skip' WHEN st = 'PNT' THEN CASE WHEN li THEN 'skip' ELSE 'upload' END WHEN st = 'PPT' THEN CASE WHEN lr THEN 'skip' ELSE 'download' END
    WHEN st IN ('PTN', 'PTT') THEN 'upload' WHEN st IN ('TPN', 'TPT') THEN 'download' WHEN st LIKE 'NT_' THEN 'delete_local' WHEN st = 'TNT' THEN 'skip'
    WHEN st IN ('TNN', 'TNP') THEN 'delete_remote' WHEN st LIKE 'NN_' THEN 'skip' WHEN st = 'PNP' THEN CASE WHEN li THEN 'delete_local' ELSE 'upload' END
    WHEN st = 'NPP' THEN CASE WHEN ri THEN 'delete_remote' ELSE 'download' END END AS act
  FROM s
), judged AS (
  SELECT *, CASE
    WHEN act = 'conflict_fork' THEN 'concurrent'
    WHEN st = 'TPP' AND NOT ri OR st = 'PTP' AND NOT li OR st = 'PPT' AND NOT lr OR st IN ('PTN', 'PTT', 'TPN') OR st = 'PNP' AND NOT li OR st = 'NPP' AND NOT ri THEN 'modified_deleted' END AS kind
  FROM raw
)"""
_ACTIONS = f"""{_SIDES},
up AS (SELECT tenant_id, vault_id, linode AS inode, lh AS h, max(path) AS p FROM judged WHERE act = 'upload' AND linode IS NOT NULL GROUP BY ALL),
del AS (SELECT tenant_id, vault_id, iinode AS inode, ih AS h, max(path) AS p FROM judged WHERE act = 'delete_remote' AND iinode IS NOT NULL GROUP BY ALL),
pairs AS (SELECT up.tenant_id, up.vault_id, up.p AS new_path, del.p AS old_path FROM up JOIN del ON {same('up', 'del', 'tenant_id vault_id inode h')}),
actions AS (
  SELECT j.tenant_id, j.vault_id, coalesce(a.old_path, j.path) AS path, CASE WHEN a.old_path IS NOT NULL THEN 'rename_remote' WHEN b.old_path IS NOT NULL THEN 'skip' ELSE act END AS action,
    CASE WHEN a.old_path IS NOT NULL THEN j.path END AS rename_to, kind, CASE WHEN kind IS NOT NULL THEN lh END AS local_hash, CASE WHEN kind IS NOT NULL THEN rh END AS remote_hash, CASE WHEN kind IS NOT NULL THEN ih END AS base_hash,
    rh AS server_hash
  FROM judged j LEFT JOIN pairs a ON {same('a', 'j', 'tenant_id vault_id')} AND a.new_path = j.path AND j.act = 'upload'
  LEFT JOIN pairs b ON {same('b', 'j', 'tenant_id vault_id')} AND b.old_path = j.path AND j.act = 'delete_remote'
)"""


@register(f"WITH {_ACTIONS} SELECT tenant_id, vault_id, action, count(*) AS n FROM actions GROUP BY ALL")
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).groupBy(*SCOPE, "action").agg(F.count("*").alias("n"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        *KEY, "action", "rename_to", F.col("conflict.kind").alias("kind"), *[F.col(f"conflict.{s}_hash").alias(f"{s}_hash") for s in ("local", "remote", "base")],
        F.col("server_version.content_hash").alias("server_hash"),
    )


@register(
    f"WITH {_SIDES} SELECT tenant_id, vault_id, path, act AS action, CAST(NULL AS VARCHAR) AS rename_to, kind, CASE WHEN kind IS NOT NULL THEN lh END AS local_hash, "
    "CASE WHEN kind IS NOT NULL THEN rh END AS remote_hash, CASE WHEN kind IS NOT NULL THEN ih END AS base_hash, rh AS server_hash FROM judged"
)
def reconcile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reconcile.reconcile(*three(spark, sf_dir)))


@register(f"WITH {_ACTIONS} SELECT * FROM actions")
def fold_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, indexed = three(spark, sf_dir)
    return _flat(reconcile.fold_renames(reconcile.reconcile(local, remote, indexed), local, indexed))


@register(f"WITH {_ACTIONS} SELECT * FROM actions")
def reconcile_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(actions(spark, sf_dir))


@register(
    f"""WITH last AS (SELECT tenant_id, vault_id, inode, content_hash, max(path) AS p FROM indexed_files WHERE inode IS NOT NULL GROUP BY ALL)
    SELECT c.tenant_id, c.vault_id, last.p AS from_path, c.path AS to_path, c.inode, c.content_hash FROM local_files c JOIN last ON {same('c', 'last', 'tenant_id vault_id inode content_hash')}
    WHERE NOT EXISTS (SELECT 1 FROM local_files x WHERE {same('x', 'c', 'tenant_id vault_id')} AND x.path = last.p) AND NOT EXISTS (SELECT 1 FROM indexed_files y WHERE {same('y', 'c')})"""
)
def detect_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _, indexed = three(spark, sf_dir)
    return reconcile.detect_renames(indexed, local)


@register("SELECT tenant_id, vault_id, path FROM local_files UNION SELECT tenant_id, vault_id, path FROM remote_files UNION SELECT tenant_id, vault_id, path FROM indexed_files")
def union_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.union_paths(*three(spark, sf_dir))


@register("SELECT tenant_id, vault_id, 'nodeA=' || max(ca) || ',nodeB=' || max(cb) AS vector_clock FROM remote_files GROUP BY ALL")
def merged_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.merged_clock(three(spark, sf_dir)[1], SCOPE).select(*SCOPE, vc_text(F.col("vector_clock")).alias("vector_clock"))


@register(
    f"""WITH c AS (SELECT l.tenant_id, l.vault_id, l.ca < r.ca OR l.cb < r.cb AS lt, l.ca > r.ca OR l.cb > r.cb AS gt FROM local_files l JOIN remote_files r ON {same('l', 'r')})
    SELECT tenant_id, vault_id, count(*) FILTER (NOT lt AND NOT gt) AS equal, count(*) FILTER (lt AND NOT gt) AS before, count(*) FILTER (gt AND NOT lt) AS after, count(*) FILTER (lt AND gt) AS concurrent FROM c GROUP BY ALL"""
)
def causality_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = three(spark, sf_dir)
    return reconcile.causality_matrix(local, remote)


@register(
    f"""SELECT l.tenant_id, l.vault_id, l.path, CASE WHEN l.ca < r.ca OR l.cb < r.cb THEN CASE WHEN l.ca > r.ca OR l.cb > r.cb THEN 'concurrent' ELSE 'before' END WHEN l.ca > r.ca OR l.cb > r.cb THEN 'after' ELSE 'equal' END AS causality,
    NOT (l.ca > r.ca OR l.cb > r.cb) AND (l.ca < r.ca OR l.cb < r.cb) AS happens_before, 'nodeA=' || greatest(l.ca, r.ca) || ',nodeB=' || greatest(l.cb, r.cb) AS merged, 'nodeA=' || (l.ca + 1) || ',nodeB=' || l.cb AS advanced, l.cb AS tick, CAST(0 AS BIGINT) AS no_tick
    FROM local_files l JOIN remote_files r ON {same('l', 'r')}"""
)
def vector_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = three(spark, sf_dir)
    both = reconcile.join_on(local.select(*KEY, F.col("vector_clock").alias("a")), remote.select(*KEY, F.col("vector_clock").alias("b")), KEY, "inner")
    a, b = F.col("a"), F.col("b")
    return both.select(
        *KEY, compare(a, b).alias("causality"), vc_happens_before(a, b).alias("happens_before"), vc_text(vc_merge(a, b)).alias("merged"), vc_text(vc_advance(a, F.lit("nodeA"))).alias("advanced"),
        vc_get(a, F.lit("nodeB")).alias("tick"), vc_get(a, F.lit("nodeZ")).alias("no_tick"),
    )


@register("SELECT tenant_id, vault_id, path, max(seq) AS seq, arg_max(content_hash, seq) AS content_hash FROM writes GROUP BY tenant_id, vault_id, path")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_rows(view(spark, sf_dir, "writes").select(*KEY, "seq", "content_hash"), KEY, ["seq"])


_INCLUDED = f"""(NOT EXISTS (SELECT 1 FROM rules r WHERE {same('r', 'x', 'tenant_id vault_id')})
  OR EXISTS (SELECT 1 FROM rules r WHERE {same('r', 'x', 'tenant_id vault_id')} AND (x.path = r.prefix OR starts_with(x.path, r.prefix || '/'))))"""


@register(f"SELECT tenant_id, vault_id, path, size FROM local_files x WHERE {_INCLUDED}")
def filter_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.filter_includes(view(spark, sf_dir, "local_files").select(*KEY, "size"), view(spark, sf_dir, "rules"), SCOPE)


@register(
    """WITH scopes AS (SELECT DISTINCT tenant_id, vault_id FROM base)
    SELECT tenant_id, vault_id, prefix FROM rules WHERE vault_id <> 'v0' UNION ALL SELECT tenant_id, vault_id, unnest(['src3', 'src4/x']) AS prefix FROM scopes WHERE vault_id = 'v0'"""
)
def replace_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = view(spark, sf_dir, "base").select(*SCOPE).distinct()
    good = F.array(F.lit("/src4\\x"), F.lit(" src3/ "), F.lit("src3"))
    wanted = scopes.where("vault_id <> 'v2'").withColumn("prefixes", F.when(F.col("vault_id") == "v0", good).otherwise(F.array(F.lit("fine"), F.lit("../bad"))))
    return exchange.replace_includes(view(spark, sf_dir, "rules"), wanted, SCOPE)


@register(
    f"""WITH {_ACTIONS}, routed AS (
      SELECT tenant_id, vault_id, path, CASE WHEN action = 'upload' THEN 'to_download' WHEN action = 'download' AND tenant_id IS DISTINCT FROM 't1' THEN 'to_upload' WHEN action IN ('delete_local', 'delete_remote') THEN 'to_delete'
        WHEN action = 'conflict_fork' THEN CASE WHEN tenant_id IS NOT DISTINCT FROM 't1' THEN 'to_download' ELSE 'conflicts' END END AS list, kind FROM actions)
    SELECT tenant_id, vault_id, path, list, CASE WHEN list = 'conflicts' THEN CASE kind WHEN 'concurrent' THEN 'merge' ELSE 'keep-local' END END AS resolution
    FROM routed x WHERE list IS NOT NULL AND (list = 'conflicts' OR {_INCLUDED})"""
)
def exchange_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = view(spark, sf_dir, "base").select(*SCOPE).distinct().where("tenant_id = 't1'").withColumn("role", F.lit("receive_only"))
    return exchange.exchange_response(actions(spark, sf_dir), view(spark, sf_dir, "remote_files"), roles, view(spark, sf_dir, "rules"))


@register(
    f"""WITH {_ACTIONS} SELECT a.tenant_id, a.vault_id, a.path, CASE WHEN action = 'download' THEN c.content_hash ELSE s.content_hash END AS content_hash,
      CASE WHEN action = 'download' THEN c.size ELSE s.size END AS size, CASE WHEN action = 'download' THEN c.deleted ELSE s.deleted OR action LIKE 'delete%' END AS deleted,
      CASE WHEN action LIKE 'delete%' THEN {AS_OF} WHEN action = 'download' THEN c.deleted_at ELSE s.deleted_at END AS deleted_at
    FROM actions a LEFT JOIN local_files s ON {same('a', 's')} LEFT JOIN remote_files c ON {same('a', 'c')}
    WHERE action IN ('upload', 'skip', 'delete_local', 'delete_remote') AND s.path IS NOT NULL OR action = 'download' AND c.path IS NOT NULL"""
)
def post_sync_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = three(spark, sf_dir)
    return exchange.post_sync_baseline(local, remote, actions(spark, sf_dir), AS_OF).select(*KEY, "content_hash", "size", "deleted", "deleted_at")


_DEL = f"EXISTS (SELECT 1 FROM actions a WHERE {same('a', 'l')} AND a.action = 'delete_local')"


@register(
    f"WITH {_ACTIONS} SELECT tenant_id, vault_id, path, content_hash, deleted OR {_DEL} AS deleted, CASE WHEN NOT deleted AND {_DEL} THEN {AS_OF} ELSE deleted_at END AS deleted_at FROM local_files l"
)
def tombstone_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = exchange.tombstone_fanout(three(spark, sf_dir)[0], actions(spark, sf_dir), AS_OF)
    return after.select(*KEY, "content_hash", "deleted", "deleted_at")


@register(f"WITH {_ACTIONS} SELECT tenant_id, vault_id, path, 'sync.file_deleted' AS event, CAST({AS_OF} AS BIGINT) AS at FROM local_files l WHERE NOT deleted AND {_DEL}")
def tombstone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.tombstone_fanout(three(spark, sf_dir)[0], actions(spark, sf_dir), AS_OF)[1]


@register(
    f"""WITH {_ACTIONS} SELECT tenant_id, vault_id, path, sha256(coalesce(tenant_id, '') || chr(10) || vault_id || chr(10) || path) AS conflict_id, kind AS conflict_type, local_hash, remote_hash, base_hash,
      CASE WHEN action = 'conflict_fork' THEN regexp_replace(path, '\\.md$', '.sync-conflict-deface00-20010909-014640.md') END AS fork_path FROM actions WHERE kind IS NOT NULL"""
)
def record_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.record_conflicts(actions(spark, sf_dir), "DEdeXfaYce", AS_OF).drop("resolution", "created_at")


@register(
    f"SELECT l.tenant_id, l.vault_id, l.path, i.version_id, i.parent_version_id FROM local_files l LEFT JOIN (SELECT *, doc_id % 9 + 1 AS version_id, doc_id % 9 AS parent_version_id FROM indexed_files) i ON {same('l', 'i')}"
)
def overlay_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = view(spark, sf_dir, "indexed_files").selectExpr("tenant_id", "vault_id", "concat('/', replace(path, '/', '\\\\'), ' ') as path", "doc_id % 9 + 1 as version_id", "doc_id % 9 as parent_version_id")
    return exchange.overlay_versions(view(spark, sf_dir, "local_files").select(*KEY), index)


@register(
    f"""WITH cache AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS m, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'nonce' || doc_id END AS nonce, sha256('wire' || doc_id) AS wire FROM indexed_files)
    SELECT l.tenant_id, l.vault_id, l.path, NOT coalesce(c.size = l.size AND c.m = l.mtime_ns AND c.nonce <> '', false) AS needs_encrypt,
      CASE WHEN c.size = l.size AND c.m = l.mtime_ns AND c.nonce <> '' THEN c.wire ELSE l.content_hash END AS content_hash, CASE WHEN c.size = l.size AND c.m = l.mtime_ns AND c.nonce <> '' THEN c.nonce END AS nonce
    FROM local_files l LEFT JOIN cache c ON {same('l', 'c')}"""
)
def overlay_wire_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = view(spark, sf_dir, "indexed_files").selectExpr(
        "tenant_id", "vault_id", "path", "size", "if(doc_id % 4 = 0, mtime_ns + 1, mtime_ns) as mtime_ns", "sha2(concat('wire', doc_id), 256) as content_hash", "encode(if(doc_id % 3 = 0, '', concat('nonce', doc_id)), 'UTF-8') as encryption_nonce"
    )
    scan = view(spark, sf_dir, "local_files").select(*KEY, "size", "mtime_ns", "content_hash", F.lit(None).cast("binary").alias("encryption_nonce"))
    return exchange.overlay_wire_hash(scan, cache).select(*KEY, "needs_encrypt", "content_hash", F.decode("encryption_nonce", "UTF-8").alias("nonce"))


@register(
    """WITH req AS (SELECT user_id, event_id, sha256('Supplier#' || lpad(CAST(user_id % 200 AS VARCHAR), 9, '0')) AS cert_fp, 'share' || (event_id % 8) AS share, event_id % 97 <> 0 AS healthy FROM $events)
    SELECT req.event_id, role, CASE WHEN NOT healthy THEN 'unavailable' WHEN role IS NULL THEN 'share_unknown' WHEN role NOT IN ('bidirectional', 'send_only', 'publisher') THEN 'role_mismatch' ELSE 'ok' END AS verdict
    FROM req LEFT JOIN acl ON acl.cert_fp = req.cert_fp AND acl.share = req.share"""
)
def resolve_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = query(spark, sf_dir, "SELECT event_id, sha2(concat('Supplier#', lpad(CAST(user_id % 200 AS STRING), 9, '0')), 256) AS cert_fp, concat('share', event_id % 8) AS share, event_id % 97 <> 0 AS healthy FROM $events")
    decided, _ = exchange.resolve_roles(requests, view(spark, sf_dir, "acl"), F.col("healthy"))
    return decided.select("event_id", "role", "verdict")


@register(
    """WITH req AS (SELECT event_id, sha256('Supplier#' || lpad(CAST(user_id % 200 AS VARCHAR), 9, '0')) AS cert_fp, 'share' || (event_id % 8) AS share FROM $events), d AS (
      SELECT req.cert_fp, req.share, role FROM req LEFT JOIN acl ON acl.cert_fp = req.cert_fp AND acl.share = req.share)
    SELECT CASE WHEN role IS NULL THEN 'share.unknown' ELSE 'acl.role_mismatch' END AS kind, share, count(*) AS n FROM d WHERE role IS NULL OR role = 'receive_only' GROUP BY ALL"""
)
def role_mismatch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = query(spark, sf_dir, "SELECT event_id, sha2(concat('Supplier#', lpad(CAST(user_id % 200 AS STRING), 9, '0')), 256) AS cert_fp, concat('share', event_id % 8) AS share FROM $events")
    _, audits = exchange.resolve_roles(requests, view(spark, sf_dir, "acl"))
    return audits.groupBy("kind", "share").agg(F.count("*").alias("n"))
