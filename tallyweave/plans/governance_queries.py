"""Registered queries on tenants, roles, quotas, audit, sidecars and the object catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, governance, sidecars
from ..schemas import KEY
from .fixtures import AS_OF, query, view
from .index_queries import _TIER
from .reconcile_queries import same
from .registry import register


@register("SELECT tenant_id, CAST(coalesce(sum(size) FILTER (NOT deleted), 0) AS BIGINT) AS used_bytes FROM files GROUP BY tenant_id")
def storage_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.storage_used(view(spark, sf_dir, "files"))


_COUNTS = """c AS (SELECT tenant_id, CAST(sum(u) AS BIGINT) AS users, CAST(sum(n) AS BIGINT) AS active_nodes, CAST(sum(v) AS BIGINT) AS vaults, CAST(sum(t) AS BIGINT) AS trash, CAST(sum(f) AS BIGINT) AS unresolved_conflicts FROM (
  SELECT tenant_id, 1 AS u, 0 AS n, 0 AS v, 0 AS t, 0 AS f FROM users UNION ALL SELECT tenant_id, 0, 1, 0, 0, 0 FROM nodes WHERE NOT revoked UNION ALL SELECT tenant_id, 0, 0, 1, 0, 0 FROM vaults
  UNION ALL SELECT tenant_id, 0, 0, 0, 1, 0 FROM files WHERE deleted UNION ALL SELECT tenant_id, 0, 0, 0, 0, 1 FROM conflicts WHERE resolution IS NULL) q GROUP BY tenant_id)"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


@register(f"WITH {_COUNTS} SELECT * FROM c")
def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.tenant_counts(*_tables(spark, sf_dir, "users", "nodes", "vaults", "files", "conflicts"))


@register("SELECT tenant_id, vault_id, path, count(*) AS versions FROM history GROUP BY ALL")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.group_counts(view(spark, sf_dir, "history"), KEY, "versions")


@register(
    f"""WITH {_TIER}, {_COUNTS}, used AS (SELECT tenant_id, CAST(sum(size) FILTER (NOT deleted) AS BIGINT) AS b FROM files GROUP BY tenant_id), vl AS (SELECT tenant_id, string_agg(DISTINCT vault_id, ',' ORDER BY vault_id) AS l FROM vaults GROUP BY tenant_id),
      nl AS (SELECT tenant_id, string_agg(node_id, ',' ORDER BY node_id) AS l FROM nodes WHERE NOT revoked GROUP BY tenant_id)
    SELECT t.tenant_id, coalesce(t.name, t.raw) AS plan_tier, storage AS max_storage_bytes, t.max_nodes, t.max_vaults, coalesce(b, 0) AS used_bytes, coalesce(users, 0) AS users, coalesce(active_nodes, 0) AS active_nodes, coalesce(vaults, 0) AS vaults, coalesce(trash, 0) AS trash,
      coalesce(unresolved_conflicts, 0) AS unresolved_conflicts, coalesce(vl.l, '') AS vault_ids, coalesce(nl.l, '') AS node_ids
    FROM tier t LEFT JOIN c ON c.tenant_id IS NOT DISTINCT FROM t.tenant_id LEFT JOIN used ON used.tenant_id IS NOT DISTINCT FROM t.tenant_id LEFT JOIN vl ON vl.tenant_id IS NOT DISTINCT FROM t.tenant_id LEFT JOIN nl ON nl.tenant_id IS NOT DISTINCT FROM t.tenant_id"""
)
def tenant_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governance.tenant_dashboard(*_tables(spark, sf_dir, "tenants", "users", "nodes", "vaults", "files", "conflicts"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("vault_ids", "node_ids")})


#: Some uploads go to new vaults, some are large, some come to one of three paths again and again.
_UPLOADS = """SELECT o_orderkey AS seq, tenant_id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' || CAST(o_orderkey % 3 AS STRING) ELSE vault_id END AS vault_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'again' || CAST(o_orderkey % 3 AS STRING) ELSE path END AS path, size * (CASE WHEN o_orderkey % 4 = 0 THEN 30000 WHEN o_orderkey % 4 = 1 THEN 3000 ELSE 1 END) AS size FROM files"""


@register(
    f"""WITH RECURSIVE {_TIER}, used AS (SELECT tenant_id, sum(size) FILTER (NOT deleted) AS b FROM files GROUP BY tenant_id), vc AS (SELECT tenant_id, count(*) AS n FROM vaults GROUP BY tenant_id),
    u AS (
      SELECT q.*, coalesce(q.tenant_id, '') AS k, t.storage, t.max_vaults, coalesce(used.b, 0) AS b, coalesce(vc.n, 0) AS n, EXISTS (SELECT 1 FROM vaults v WHERE {same('v', 'q', 'tenant_id vault_id')}) AS known,
        coalesce(f.size, 0) AS old, CASE WHEN f.deleted THEN 0 ELSE coalesce(f.size, 0) END AS live, row_number() OVER (PARTITION BY q.tenant_id ORDER BY seq) AS i
      FROM ({_UPLOADS}) q LEFT JOIN tier t ON t.tenant_id IS NOT DISTINCT FROM q.tenant_id LEFT JOIN used ON used.tenant_id IS NOT DISTINCT FROM q.tenant_id LEFT JOIN vc ON vc.tenant_id IS NOT DISTINCT FROM q.tenant_id LEFT JOIN files f ON {same('f', 'q')}
    ), s AS (
      SELECT k, CAST(0 AS BIGINT) AS i, CAST(max(b) AS BIGINT) AS b, CAST(max(n) AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS fresh, MAP {{}}::MAP(VARCHAR, BIGINT) AS m, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict FROM u GROUP BY k
      UNION ALL
      SELECT k, i, CASE WHEN verdict = 'ok' THEN greatest(0, b + size - coalesce(before, live)) ELSE b END, CASE WHEN verdict = 'ok' AND own THEN n + 1 ELSE n END, CASE WHEN verdict = 'ok' AND own THEN list_append(fresh, vault_id) ELSE fresh END,
        CASE WHEN verdict = 'ok' AND path LIKE 'again%' THEN map_concat(m, MAP {{vault_id || '/' || path: size}}) ELSE m END, seq, verdict
      FROM (
        SELECT *, CASE WHEN max_vaults IS NULL THEN 'unknown_tier' WHEN own AND n >= max_vaults THEN 'vaults_exceeded' WHEN greatest(0, b + size - coalesce(before, old)) > storage THEN 'storage_exceeded' ELSE 'ok' END AS verdict
        FROM (SELECT u.k, u.i, u.seq, u.vault_id, u.path, u.size, u.storage, u.max_vaults, u.old, u.live, s.b, s.n, s.fresh, s.m, NOT u.known AND NOT list_contains(s.fresh, u.vault_id) AS own, s.m[u.vault_id || '/' || u.path] AS before FROM s JOIN u ON u.k = s.k AND u.i = s.i + 1) x
      ) y
    )
    SELECT u.seq, u.tenant_id, u.vault_id, u.path, u.size, s.verdict FROM u JOIN s ON s.seq = u.seq"""
)
def quota_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.quota_verdict(query(spark, sf_dir, _UPLOADS), *_tables(spark, sf_dir, "files", "vaults", "tenants"), order=["seq"])


@register(f"WITH {_TIER} SELECT t.tenant_id, count(n.node_id) AS active_nodes, CASE WHEN max_nodes IS NULL THEN 'unknown_tier' WHEN count(n.node_id) >= max_nodes THEN 'nodes_exceeded' ELSE 'ok' END AS verdict FROM tier t LEFT JOIN nodes n ON n.tenant_id IS NOT DISTINCT FROM t.tenant_id AND NOT n.revoked GROUP BY t.tenant_id, max_nodes")
def node_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.node_capacity(*_tables(spark, sf_dir, "tenants", "nodes"))


@register("SELECT kind, count(*) AS n FROM audit GROUP BY kind")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.audit_counts(view(spark, sf_dir, "audit"))


@register("SELECT kind, arg_max(ts_ms, id) AS ts_ms, arg_max(payload_json, id) AS payload_json FROM audit GROUP BY kind")
def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.audit_latest(view(spark, sf_dir, "audit"))


@register(
    """WITH v AS (SELECT tenant_id, '[' || string_agg('{"vault_id":"' || vault_id || '","created_at":' || created_at || '}', ',' ORDER BY vault_id) || ']' AS l FROM vaults GROUP BY tenant_id),
      n AS (SELECT tenant_id, '[' || string_agg('{"node_id":"' || node_id || '","registered_at":' || registered_at || '}', ',' ORDER BY node_id) || ']' AS l FROM nodes WHERE NOT revoked GROUP BY tenant_id)
    SELECT user_id, '{"user":{"user_id":' || user_id || ',"email":"' || email || '"},"tenant":{' || coalesce('"tenant_id":"' || u.tenant_id || '",', '') || '"plan_tier":"' || coalesce(plan_tier, 'free') || '","vaults":' || coalesce(v.l, '[]') || ',"devices":' || coalesce(n.l, '[]') || '}}' AS document
    FROM users u LEFT JOIN tenants t ON t.tenant_id IS NOT DISTINCT FROM u.tenant_id LEFT JOIN v ON v.tenant_id IS NOT DISTINCT FROM u.tenant_id LEFT JOIN n ON n.tenant_id IS NOT DISTINCT FROM u.tenant_id"""
)
def tenant_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.tenant_export(*_tables(spark, sf_dir, "users", "tenants", "vaults", "nodes"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "users")
    n = F.col("user_id")
    pick = lambda m, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % m + 1).cast("int"))
    obj = F.struct(
        F.concat(F.lit("sub"), n.cast("string")).alias("id"), F.concat(F.lit("cus"), n.cast("string")).alias("customer"), pick(4, "active", "trialing", "past_due", "active").alias("status"),
        F.struct(F.array(F.struct(F.struct(pick(5, "disk_free", "disk_pro", "disk_team", "disk_gold", "disk_pro").alias("lookup_key")).alias("price"))).alias("data")).alias("items"),
    )
    body = F.to_json(F.struct(pick(3, "customer.subscription.updated", "customer.subscription.created", "invoice.paid").alias("type"), F.struct(obj.alias("object")).alias("data")))
    return users.select(n.alias("event_no"), "tenant_id", F.when(n % 11 == 0, F.substring(body, 1, 9)).otherwise(body).alias("body"))


_EVENTS = """ev AS (SELECT user_id AS event_no, tenant_id, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'customer.subscription.updated' WHEN user_id % 3 = 1 THEN 'customer.subscription.created' ELSE 'invoice.paid' END AS event_type,
  CASE WHEN user_id % 11 <> 0 THEN 'cus' || user_id END AS customer_id, CASE WHEN user_id % 11 <> 0 THEN 'sub' || user_id END AS subscription_id, CASE WHEN user_id % 11 <> 0 THEN CASE user_id % 5 WHEN 0 THEN 'free' WHEN 2 THEN 'team' WHEN 3 THEN NULL ELSE 'pro' END END AS plan_tier,
  CASE WHEN user_id % 11 = 0 THEN 'bad_json' WHEN user_id % 3 = 2 THEN 'ignored_type' WHEN user_id % 4 = 2 THEN 'inactive' WHEN user_id % 5 = 3 THEN 'unknown_plan' ELSE 'ok' END AS verdict FROM users)"""


@register(f"WITH {_EVENTS} SELECT * FROM ev")
def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.subscription_events(_bodies(spark, sf_dir))


_BILLING = "SELECT tenant_id, plan_tier, 'cus' AS customer_id, 'sub' AS subscription_id FROM tenants WHERE plan_tier IS NOT NULL"


@register(
    f"""WITH {_EVENTS}, b AS ({_BILLING}), l AS (SELECT tenant_id, arg_max(plan_tier, event_no) AS plan_tier, arg_max(customer_id, event_no) AS customer_id, arg_max(subscription_id, event_no) AS subscription_id FROM ev WHERE verdict = 'ok' GROUP BY tenant_id)
    SELECT * FROM l UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tenant_id IS NOT DISTINCT FROM b.tenant_id)"""
)
def apply_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.apply_subscriptions(query(spark, sf_dir, _BILLING), governance.subscription_events(_bodies(spark, sf_dir)))


@register(
    """WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'zz' || sha256(s_name) WHEN s_suppkey % 2 = 0 THEN 'sha256:' || upper(sha256(s_name)) ELSE sha256(s_name) END AS fp, s_acctbal > 0 AS enabled FROM $supplier), r AS (
      SELECT fp, unnest(['docs', 'photos']) AS share, unnest([CASE s_suppkey % 3 WHEN 0 THEN 'bidirectional' WHEN 1 THEN 'owner' ELSE 'send_only' END, 'receive_only']) AS role FROM n WHERE enabled)
    SELECT CASE WHEN fp NOT LIKE 'zz%' THEN lower(replace(fp, 'sha256:', '')) END AS cert_fp, share, role, CASE WHEN fp LIKE 'zz%' THEN 'bad_fingerprint' WHEN role = 'owner' THEN 'bad_role' END AS problem FROM r"""
)
def acl_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = query(
        spark, sf_dir,
        """SELECT s_suppkey % 10 AS doc, collect_list(named_struct('cert_fingerprint', CASE WHEN s_suppkey % 7 = 0 THEN 'zz' || sha2(s_name, 256) WHEN s_suppkey % 2 = 0 THEN 'sha256:' || upper(sha2(s_name, 256)) ELSE sha2(s_name, 256) END,
        'enabled', s_acctbal > 0, 'shares', map('docs', CASE s_suppkey % 3 WHEN 0 THEN 'bidirectional' WHEN 1 THEN 'owner' ELSE 'send_only' END, 'photos', 'receive_only'))) AS nodes FROM $supplier GROUP BY s_suppkey % 10""",
    )
    return governance.acl_flatten(docs)


@register(
    """WITH b AS (SELECT cert_fp, share, role FROM acl WHERE s_suppkey % 5 <> 0), a AS (SELECT cert_fp, share, CASE WHEN c_custkey % 3 = 0 THEN 'receive_only' ELSE role END AS role FROM acl WHERE s_suppkey % 7 <> 0)
    SELECT coalesce(a.cert_fp, b.cert_fp) AS cert_fp, coalesce(a.share, b.share) AS share, b.role AS old_role, a.role AS new_role, CASE WHEN b.role IS NULL THEN 'added' WHEN a.role IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM b FULL JOIN a ON a.cert_fp = b.cert_fp AND a.share = b.share WHERE a.role IS DISTINCT FROM b.role"""
)
def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    acl = view(spark, sf_dir, "acl")
    return governance.role_changes(acl.where("s_suppkey % 5 <> 0"), acl.where("s_suppkey % 7 <> 0").withColumn("role", F.expr("if(c_custkey % 3 = 0, 'receive_only', role)")))


_MEMBERS = """SELECT c_custkey AS user_id, 'v' || CAST(c_custkey % 9 AS STRING) AS vault_id, 't' || CAST(c_nationkey AS STRING) AS owner_tenant, CASE WHEN c_custkey % 2 = 0 THEN 'editor' ELSE 'viewer' END AS role FROM users WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'v' || CAST(c_custkey % 9 AS STRING), CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 't' || CAST(c_nationkey + 3 AS STRING) END, 'viewer' FROM users WHERE c_custkey % 4 = 0"""
_REQUESTS = "SELECT o_orderkey, o_custkey AS user_id, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE 't' || CAST(o_custkey % 50 AS STRING) END AS tenant_id, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || CAST(o_custkey % 9 AS STRING) ELSE o_orderpriority END AS vault_id FROM $orders"


@register(
    f"""WITH q AS ({_REQUESTS}), m AS ({_MEMBERS}), v AS (SELECT * FROM vaults WHERE created_at % 2 = 0), j AS (SELECT q.*, EXISTS (SELECT 1 FROM v WHERE {same('v', 'q', 'tenant_id vault_id')}) AS own, m.role, m.owner_tenant FROM q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, vault_id ORDER BY owner_tenant NULLS FIRST, role) AS rn FROM m) m ON m.user_id = q.user_id AND m.vault_id = q.vault_id AND m.rn = 1)
    SELECT o_orderkey, CASE WHEN own THEN tenant_id WHEN role IS NOT NULL THEN owner_tenant END AS data_tenant, CASE WHEN own THEN 'owner' ELSE coalesce(role, 'denied') END AS access, own OR role IS NOT NULL AS may_read, own OR coalesce(role = 'editor', false) AS may_write, own AS may_manage FROM j"""
)
def vault_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governance.vault_access(query(spark, sf_dir, _REQUESTS), view(spark, sf_dir, "vaults").where("created_at % 2 = 0"), query(spark, sf_dir, _MEMBERS))
    return out.drop("user_id", "tenant_id", "vault_id")


@register(f"WITH m AS ({_MEMBERS}) SELECT owner_tenant, vault_id, m.user_id, email, role FROM m JOIN users u ON u.user_id = m.user_id")
def member_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.member_directory(query(spark, sf_dir, _MEMBERS), view(spark, sf_dir, "users"))


_ORG_MEMBERS = "SELECT DISTINCT o_custkey AS user_id, o_orderkey % 25 AS org_id, CASE o_custkey % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role FROM $orders"
_ORGS = "SELECT CAST(n_nationkey AS BIGINT) AS org_id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM $nation"
_CONTEXT = "SELECT user_id, CAST(c_nationkey AS BIGINT) AS org_id FROM users"


@register(
    f"""WITH m AS ({_ORG_MEMBERS}), o AS ({_ORGS}), x AS ({_CONTEXT})
    SELECT m.user_id, m.org_id, name, role, role IN ('owner', 'admin') AS may_manage, CAST(row_number() OVER (PARTITION BY m.user_id ORDER BY lower(name), m.org_id) AS INTEGER) AS position, coalesce(x.org_id = m.org_id, false) AS active
    FROM m JOIN o ON o.org_id = m.org_id LEFT JOIN x ON x.user_id = m.user_id"""
)
def org_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.org_directory(*(query(spark, sf_dir, s) for s in (_ORG_MEMBERS, _ORGS, _CONTEXT)))


FIRED = "SELECT doc_id AS event_id, tenant_id, vault_id, CASE WHEN doc_id % 3 = 0 THEN 'sync.file_changed' ELSE 'sync.file_deleted' END AS event, doc_id * 60 AS created_at, path AS payload FROM base"


@register(
    f"""WITH f AS ({FIRED}) SELECT f.event_id, h.hook_id, h.url, '{{"id":"evt_' || f.event_id || '","event":"' || f.event || '","created_at":' || f.created_at || ',"vault_id":"' || f.vault_id || '","data":"' || f.payload || '"}}' AS body
    FROM f JOIN hooks h ON {same('h', 'f', 'tenant_id vault_id')} WHERE h.enabled AND h.secret <> '' AND contains(h.events_json, '"' || f.event || '"')"""
)
def webhook_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.webhook_fanout(query(spark, sf_dir, FIRED), view(spark, sf_dir, "hooks"))


_TOKENS = "SELECT CAST(c_custkey AS STRING) AS token_hash, c_custkey * 100 AS issued_at, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey * 200 END AS ttl, c_custkey % 7 = 0 AS revoked, c_custkey % 5 = 0 AS used FROM $customer"
_TRIES = "SELECT o_orderkey AS attempt_id, CAST(o_custkey * 2 AS STRING) AS token_hash, o_custkey * 200 + o_orderkey % 9000 AS second FROM $orders"


@register(
    f"""WITH t AS ({_TOKENS}), a AS ({_TRIES}), j AS (SELECT a.*, t.token_hash IS NULL AS unknown, revoked, used, issued_at + least(coalesce(ttl, 3600), 86400) < second AS late FROM a LEFT JOIN t ON t.token_hash = a.token_hash),
      o AS (SELECT *, min(CASE WHEN NOT (revoked OR used OR late) THEN (second, attempt_id) END) OVER (PARTITION BY token_hash) AS first FROM j)
    SELECT attempt_id, token_hash, second, CASE WHEN unknown THEN 'not_found' WHEN revoked THEN 'revoked' WHEN used OR (second, attempt_id) > first THEN 'replay' WHEN late THEN 'expired' ELSE 'ok' END AS status FROM o"""
)
def enrollment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.enrollment_status(query(spark, sf_dir, _TRIES), query(spark, sf_dir, _TOKENS))


_INVITES = "SELECT CAST(c_custkey AS STRING) AS code, c_custkey * 100 + 5000 AS expires_at, c_custkey % 6 = 0 AS redeemed FROM $customer"
_CLAIMS = "SELECT o_orderkey AS attempt_id, CAST(o_custkey * 2 AS STRING) AS code, o_custkey * 200 + o_orderkey % 9000 AS second FROM $orders"


@register(
    f"""WITH i AS ({_INVITES}), a AS ({_CLAIMS}), j AS (SELECT a.*, i.expires_at, i.redeemed, min(CASE WHEN NOT i.redeemed AND i.expires_at >= a.second THEN lpad(CAST(a.second AS STRING), 12, '0') || lpad(CAST(a.attempt_id AS STRING), 12, '0') END) OVER (PARTITION BY a.code) AS first FROM a LEFT JOIN i ON i.code = a.code)
    SELECT attempt_id, code, second, CASE WHEN expires_at IS NULL THEN 'not_found' WHEN redeemed OR first < lpad(CAST(second AS STRING), 12, '0') || lpad(CAST(attempt_id AS STRING), 12, '0') THEN 'already_redeemed' WHEN expires_at < second THEN 'expired' ELSE 'ok' END AS status FROM j"""
)
def invite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.invite_status(query(spark, sf_dir, _CLAIMS), query(spark, sf_dir, _INVITES))


_KEYS = f"SELECT s_suppkey AS key_id, CAST({AS_OF} AS BIGINT) * 1000 - s_suppkey * 43200000 AS fetched_at_ms FROM $supplier"


@register(f"SELECT key_id FROM ({_KEYS}) k WHERE {AS_OF}000 - fetched_at_ms < 86400000")
def key_cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.key_cache_fresh(query(spark, sf_dir, _KEYS), AS_OF * 1000).select("key_id")


@register(f"SELECT key_id FROM ({_KEYS}) k WHERE {AS_OF}000 - fetched_at_ms <= 2592000000")
def key_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.key_sweep(query(spark, sf_dir, _KEYS), AS_OF * 1000).select("key_id")


_GONE = "coalesce(tenant_id, '') IN ('', 't1', 't7')"


@register(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE NOT {_GONE}" for t in ("files", "nodes", "users", "vaults")))
def purge_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = dict(zip(("files", "nodes", "users", "vaults"), _tables(spark, sf_dir, "files", "nodes", "users", "vaults"), strict=True))
    left = governance.purge_tenants(tables, view(spark, sf_dir, "tenants").where(_GONE))
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_ASKED = "SELECT user_id * 2 AS user_id, CASE WHEN user_id % 5 = 0 THEN 'other@example.org' ELSE ' user' || CAST(user_id * 2 AS STRING) || '@EXAMPLE.org ' END AS email FROM users WHERE tenant_id IS NULL OR user_id % 2 = 0"


@register(f"WITH r AS ({_ASKED}) SELECT r.user_id, r.email, CASE WHEN u.user_id IS NULL THEN 'not_found' WHEN lower(trim(r.email)) = lower(u.email) THEN 'deleted' ELSE 'email_mismatch' END AS status FROM r LEFT JOIN users u ON u.user_id = r.user_id")
def delete_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.delete_accounts(view(spark, sf_dir, "users"), query(spark, sf_dir, _ASKED))[0]


_DECIDED = "SELECT CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE tenant_id END AS tenant_id, doc_id AS conflict_id, CASE doc_id % 3 WHEN 0 THEN 'keep-local' WHEN 1 THEN 'merge' ELSE 'guess' END AS action FROM base WHERE doc_id % 4 <> 3"
_JUDGED = f"""d AS (SELECT q.*, CASE WHEN action = 'guess' THEN 'invalid_action' WHEN c.conflict_id IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM ({_DECIDED}) q LEFT JOIN conflicts c ON {same('c', 'q', 'tenant_id conflict_id')} AND c.resolution IS NULL)"""


@register(f"WITH {_JUDGED} SELECT * FROM d")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.resolve_conflicts(view(spark, sf_dir, "conflicts"), query(spark, sf_dir, _DECIDED), AS_OF)[1]


@register(f"WITH {_JUDGED} SELECT c.tenant_id, c.conflict_id, coalesce(c.resolution, d.action) AS resolution, CASE WHEN d.action IS NOT NULL THEN {AS_OF} ELSE c.resolved_at END AS resolved_at FROM conflicts c LEFT JOIN d ON {same('d', 'c', 'tenant_id conflict_id')} AND d.status = 'ok'")
def resolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = governance.resolve_conflicts(view(spark, sf_dir, "conflicts"), query(spark, sf_dir, _DECIDED), AS_OF)
    return after.select("tenant_id", "conflict_id", "resolution", "resolved_at")


_CERTS = "SELECT s_name AS cert_fp, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS revoked_at FROM $supplier"


@register(f"SELECT cert_fp, CASE WHEN revoked_at IS NULL AND cert_fp LIKE '%1' THEN {AS_OF} ELSE revoked_at END AS revoked_at FROM ({_CERTS}) c")
def revoke_certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = query(spark, sf_dir, _CERTS)
    return governance.revoke_certs(certs, certs.where("cert_fp like '%1'"), AS_OF)[0]


@register("SELECT node_id, tenant_id FROM nodes WHERE NOT revoked")
def active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.active_nodes(view(spark, sf_dir, "nodes")).select("node_id", "tenant_id")


# Sequences


@register("SELECT key, event_id, counter > coalesce(max(counter) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM messages")
def replay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.replay_check(view(spark, sf_dir, "messages"), ["key"], "counter", ["event_id"]).drop("counter")


@register(
    """WITH m AS (SELECT *, coalesce(max(counter) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stored FROM messages)
    SELECT key, event_id, CASE WHEN stored > 0 AND counter <= stored THEN 'version_regress' ELSE 'ok' END AS verdict FROM m"""
)
def acl_version_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.acl_version_check(view(spark, sf_dir, "messages").withColumnRenamed("counter", "version"), ["key"], ["event_id"]).drop("version")


@register(
    """WITH e AS (SELECT *, coalesce(sum(CAST(success AS INTEGER)) OVER (PARTITION BY key ORDER BY second, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM attempts)
    SELECT key, event_id, (SELECT count(*) FROM e p WHERE p.key = e.key AND p.epoch = e.epoch AND NOT p.success AND p.second BETWEEN e.second - 59 AND e.second) AS failures FROM e"""
)
def failure_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.failure_window(view(spark, sf_dir, "attempts")).select("key", "event_id", "failures")


_LIMITED = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY second, event_id) AS i FROM attempts), r AS (
      SELECT key, second, event_id, success, i, CASE WHEN success THEN 'ok' ELSE 'failed' END AS status, CAST(0 AS BIGINT) AS retry_after, CASE WHEN success THEN CAST([] AS BIGINT[]) ELSE [second] END AS f FROM n WHERE i = 1
      UNION ALL SELECT key, second, event_id, success, i, CASE WHEN len(k) >= 2 THEN 'blocked' WHEN success THEN 'ok' ELSE 'failed' END, CASE WHEN len(k) >= 2 THEN greatest(1, 60 - (second - list_min(k))) ELSE 0 END,
        CASE WHEN len(k) >= 2 THEN k WHEN success THEN [] ELSE list_append(k, second) END
      FROM (SELECT n.*, list_filter(r.f, lambda x: n.second - x < 60) AS k FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1) q)
    SELECT key, second, event_id, success, status, retry_after FROM r"""


@register(_LIMITED)
def auth_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.auth_rate_limit(view(spark, sf_dir, "attempts"), most=2)


@register(_LIMITED)
def auth_rate_limit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, keys cut where the limiter remembers nothing."""
    return governance.auth_rate_limit(view(spark, sf_dir, "attempts"), most=2, split=True)


_BUMPED = """WITH RECURSIVE n AS (SELECT key, event_id, counter % 4 AS expected, row_number() OVER (PARTITION BY key ORDER BY event_id) AS i FROM messages), r AS (
      SELECT key, event_id, expected, i, CASE WHEN expected = 0 THEN 'applied' ELSE 'conflict' END AS status, CASE WHEN expected = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS revision FROM n WHERE i = 1
      UNION ALL SELECT n.key, n.event_id, n.expected, n.i, CASE WHEN n.expected = r.revision THEN 'applied' ELSE 'conflict' END, CASE WHEN n.expected = r.revision THEN r.revision + 1 ELSE r.revision END FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)
    SELECT key AS path, event_id, expected, status, revision FROM r"""


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "messages").selectExpr("key as path", "event_id", "counter % 4 as expected")


@register(_BUMPED)
def revision_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.revision_bump(_writes(spark, sf_dir), ["path"], ["event_id"])


@register(_BUMPED)
def revision_bump_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, every key's writes cut in eight."""
    return governance.revision_bump(_writes(spark, sf_dir), ["path"], ["event_id"], segments=8)


# Sidecars


_STALENESS = """j AS (SELECT b.vault_id, b.path, CASE WHEN m.source_path IS NULL THEN 'missing_manifest' WHEN v.bytes IS NULL THEN 'missing_vector' WHEN m.content_hash <> sha256(b.text) THEN 'stale_hash' WHEN model_id <> 'm1' THEN 'stale_model'
      WHEN dimensions <> 64 THEN 'stale_dimensions' WHEN vector_bytes <> bytes THEN 'stale_vector_size' ELSE 'fresh' END AS staleness
      FROM base b LEFT JOIN manifests m ON m.vault_id = b.vault_id AND m.source_path = b.path LEFT JOIN sidecar_vectors v ON v.vault_id = b.vault_id AND v.source_path = b.path)"""


@register(f"WITH {_STALENESS} SELECT * FROM j")
def sidecar_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = view(spark, sf_dir, "base").select("vault_id", "path", F.sha2("text", 256).alias("content_hash"))
    return sidecars.sidecar_staleness(sources, *_tables(spark, sf_dir, "manifests", "sidecar_vectors"), "m1", 64)


@register(f"WITH {_STALENESS} SELECT * FROM j WHERE staleness <> 'fresh'")
def stale_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecars.not_fresh(sidecar_staleness(spark, sf_dir))


@register(
    """WITH j AS (SELECT b.vault_id, b.path, CASE WHEN m.source_path IS NULL OR v.bytes IS NULL THEN 'missing' WHEN m.content_hash <> sha256(b.text) OR model_id <> 'm1' OR dimensions <> 64 OR vector_bytes <> bytes THEN 'stale' ELSE 'fresh' END AS s
      FROM base b LEFT JOIN manifests m ON m.vault_id = b.vault_id AND m.source_path = b.path LEFT JOIN sidecar_vectors v ON v.vault_id = b.vault_id AND v.source_path = b.path), c AS (SELECT vault_id, count(*) AS n FROM manifests GROUP BY vault_id)
    SELECT j.vault_id, count(*) FILTER (s = 'fresh') AS fresh, count(*) FILTER (s = 'stale') AS stale, count(*) FILTER (s = 'missing') AS missing, coalesce(any_value(c.n), 0) AS co_storage_files, count(*) FILTER (s <> 'fresh') > 0 AS should_notify
    FROM j LEFT JOIN c ON c.vault_id = j.vault_id GROUP BY j.vault_id"""
)
def sidecar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = view(spark, sf_dir, "manifests").select("vault_id", F.concat(F.lit(".disk-embeddings/"), "source_path").alias("path"))
    files = view(spark, sf_dir, "base").select("vault_id", "path").unionByName(stored)
    return sidecars.sidecar_report(sidecar_staleness(spark, sf_dir), files)


@register(
    """WITH v AS (SELECT b.vault_id, CASE e.vec_id % 10 WHEN 1 THEN '../' || b.path WHEN 2 THEN '.disk-embeddings/x' WHEN 3 THEN 'nowhere/' || b.path ELSE '/' || b.path END AS source_path, e.vec_id, b.path, b.text FROM $embeddings e JOIN base b ON b.doc_id = e.vec_id), s AS (
      SELECT *, CASE WHEN vec_id % 10 = 1 THEN 'invalid_path' WHEN vec_id % 10 = 2 THEN 'co_storage_source' WHEN vec_id % 4 = 0 THEN 'size_mismatch' WHEN vec_id % 10 = 3 THEN 'source_missing' ELSE 'ok' END AS status FROM v)
    SELECT vault_id, source_path, status, CASE WHEN status = 'ok' THEN '.disk-embeddings/' || path || '.manifest.json' END AS manifest_path, CASE WHEN status = 'ok' THEN '.disk-embeddings/' || path || '.vec.bin' END AS vector_path,
      CASE WHEN status = 'ok' THEN '{"schema_version":1,"source_path":"' || path || '","content_hash":"' || sha256(text) || '","model_id":"m1","dimensions":64,"vector_bytes":256,"embedded_at":1000000000}' END AS manifest FROM s"""
)
def sidecar_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = query(
        spark, sf_dir,
        """SELECT b.vault_id, CASE e.vec_id % 10 WHEN 1 THEN '../' || b.path WHEN 2 THEN '.disk-embeddings/x' WHEN 3 THEN 'nowhere/' || b.path ELSE '/' || b.path END AS source_path,
        CASE WHEN e.vec_id % 4 = 0 THEN slice(e.embedding, 1, 10) ELSE e.embedding END AS vector FROM $embeddings e JOIN base b ON b.doc_id = e.vec_id""",
    )
    sources = view(spark, sf_dir, "base").select("vault_id", "path", F.sha2("text", 256).alias("content_hash"))
    return sidecars.sidecar_write(vectors, sources, "m1", 64, AS_OF)


# Object catalog


@register(
    """SELECT coalesce(i.path, c.path) AS path, coalesce(i.size, c.size) AS size, coalesce(i.content_hash, c.content_hash) AS content_hash, coalesce(i.mtime_ns, c.mtime_ns) AS mtime_ns, coalesce(c.created_at_ns, i.created_at_ns) AS created_at_ns
    FROM catalog c FULL JOIN incoming i ON i.path = c.path"""
)
def object_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.object_put(*_tables(spark, sf_dir, "catalog", "incoming"))


@register("SELECT path, size FROM catalog WHERE starts_with(path, 'blog.') ORDER BY path LIMIT 1000")
def object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.object_list(view(spark, sf_dir, "catalog"), "blog.").select("path", "size")


_MOVES = "SELECT path AS source, CASE WHEN size % 3 = 0 THEN 'archive/' || path ELSE 'archive/' || CAST(size % 7 AS STRING) END AS target FROM catalog WHERE size % 2 = 0 UNION ALL SELECT path || '?gone' AS source, path AS target FROM catalog UNION ALL SELECT min(path) AS source, max(path) AS target FROM catalog"
_RENAMED = f"""m AS ({_MOVES}), j AS (SELECT m.*, EXISTS (SELECT 1 FROM catalog WHERE path = source) AS has, EXISTS (SELECT 1 FROM catalog WHERE path = target) AS taken FROM m), k AS (
  SELECT source, target, CASE WHEN NOT has THEN 'not_found' WHEN taken OR row_number() OVER (PARTITION BY target ORDER BY has AND NOT taken DESC, source) > 1 THEN 'already_exists' ELSE 'ok' END AS status FROM j)"""


@register(f"WITH {_RENAMED} SELECT * FROM k")
def object_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.object_rename(view(spark, sf_dir, "catalog"), query(spark, sf_dir, _MOVES), 77)[1]


@register(f"WITH {_RENAMED}, d AS (SELECT source, min(target) AS target FROM k WHERE status = 'ok' GROUP BY source) SELECT coalesce(d.target, c.path) AS path, CASE WHEN d.target IS NOT NULL THEN 77 ELSE c.mtime_ns END AS mtime_ns FROM catalog c LEFT JOIN d ON d.source = c.path")
def renamed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.object_rename(view(spark, sf_dir, "catalog"), query(spark, sf_dir, _MOVES), 77)[0].select("path", "mtime_ns")

