"""Tenants, roles, quotas and audit: reports and rules over many tenants at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.tiers import parse_tier, with_limits
from ..schemas import SCOPE
from .keys import fan_out, in_blocks, in_segments, join_on, latest_wins, lay_out, running, upsert

DAY = 86400


# Reports


def storage_used(files: DataFrame) -> DataFrame:
    """Live bytes of each tenant over all its vaults."""
    return files.groupBy("tenant_id").agg(F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("size"))), F.lit(0)).alias("used_bytes"))


def tenant_counts(users: DataFrame, nodes: DataFrame, vaults: DataFrame, files: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Users, active nodes, vaults, trash rows and unresolved conflicts of every tenant that any table names."""
    count = lambda df, name: df.groupBy("tenant_id").agg(F.count("*").alias(name))
    parts = [count(users, "users"), count(nodes.where("not revoked"), "active_nodes"), count(vaults, "vaults"), count(files.where("deleted"), "trash")]
    if conflicts is not None:
        parts.append(count(conflicts.where("resolution is null"), "unresolved_conflicts"))
    # Counts are united by name and summed: one more small aggregate, no chain of outer joins.
    names = [p.columns[1] for p in parts]
    spread = None
    for p in parts:
        own = p.columns[1]
        row = p.select("tenant_id", *[F.col(n) if n == own else F.lit(0).cast("long").alias(n) for n in names])
        spread = row if spread is None else spread.unionByName(row)
    return spread.groupBy("tenant_id").agg(*[F.sum(n).alias(n) for n in names])


def group_counts(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows per key: history per path, snapshots per vault."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def tenant_dashboard(tenants: DataFrame, users: DataFrame, nodes: DataFrame, vaults: DataFrame, files: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row for each of ``tenants`` (tenant_id, plan_tier): tier (free if null), limits, use, counts and the lists behind them.

    The lists of a tenant's vaults and nodes are one row; they suit tenants near their tier's limits (tens of each).
    """
    shown = F.coalesce(parse_tier(F.coalesce("plan_tier", F.lit("free"))), "plan_tier")
    rows = with_limits(tenants.select("tenant_id", shown.alias("plan_tier")))
    rows = join_on(join_on(rows, storage_used(files), ["tenant_id"]), tenant_counts(users, nodes, vaults, files, conflicts), ["tenant_id"])
    lists = vaults.groupBy("tenant_id").agg(F.array_sort(F.collect_set("vault_id")).alias("vault_ids"))
    devices = nodes.where("not revoked").groupBy("tenant_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    rows = join_on(join_on(rows, lists, ["tenant_id"]), devices, ["tenant_id"])
    zero = ["used_bytes", "users", "active_nodes", "vaults", "trash", "unresolved_conflicts"]
    empty = F.array().cast("array<string>")
    return rows.select(
        "tenant_id", "plan_tier", "max_storage_bytes", "max_nodes", "max_vaults", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        F.coalesce("vault_ids", empty).alias("vault_ids"), F.coalesce("node_ids", empty).alias("node_ids"),
    )


def quota_verdict(uploads: DataFrame, files: DataFrame, vaults: DataFrame, tenants: DataFrame, order: Sequence[str] = ("vault_id", "path", "size")) -> DataFrame:
    """``uploads`` (tenant_id, vault_id, path, size) with verdict: unknown_tier, vaults_exceeded, storage_exceeded, ok.

    A tenant's uploads are judged in ``order``, each after those before it are stored: what is ok adds its vault and its bytes,
    what is not leaves nothing. A new vault counts against the known ones; bytes grow by the new size less the old row's,
    tombstones included, while the used bytes leave tombstones out; neither falls below 0. A null size counts as 0.

    A task holds one batch of a tenant's rows and its state: bytes, new vaults (no more than its tier allows) and the sizes of
    admitted paths that come again later.
    """
    rows = with_limits(join_on(uploads, tenants.select("tenant_id", F.col("plan_tier").alias("__tier_name")), ["tenant_id"]), "__tier_name")
    rows = join_on(rows, storage_used(files), ["tenant_id"])
    rows = join_on(rows, vaults.groupBy("tenant_id").agg(F.count("*").alias("__vaults")), ["tenant_id"])
    rows = join_on(rows, vaults.select(*SCOPE, F.lit(True).alias("__known")).distinct(), SCOPE)
    rows = join_on(rows, files.select(*SCOPE, "path", F.col("size").alias("__old"), F.when(~F.col("deleted"), F.col("size")).alias("__live")), [*SCOPE, "path"])
    later = Window.partitionBy(*SCOPE, "path").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    facts = {
        "__bytes": zero("size"), "__max_bytes": F.col("max_storage_bytes").cast("long"), "__max_vaults": F.col("max_vaults").cast("long"), "__used": zero("used_bytes"), "__vaults": zero("__vaults"),
        "__known": F.coalesce("__known", F.lit(False)), "__old": zero("__old"), "__live": zero("__live"), "__later": F.count("*").over(later),
    }
    rows = rows.withColumns(facts).select(*uploads.columns, *facts)
    judged = judged_in_order(rows, ["tenant_id"], order, ["vault_id", "path", *facts], "verdict string", lambda row: Admitted(row[5], row[6]), lambda part, state: [(state.verdict(*row),) for row in part])
    return judged.select(*uploads.columns, "verdict")


class Admitted:
    """What a tenant has stored so far."""

    def __init__(self, used: int, vaults: int):
        self.used, self.vaults = used, vaults
        self.new_vaults: set = set()
        self.sizes: dict[tuple, int] = {}  # of paths stored here that come again

    def verdict(self, vault: str, path: str, size: int, max_bytes: int | None, max_vaults: int | None, used: int, vaults: int, known: bool, old: int, live: int, later: int) -> str:
        before = self.sizes.get((vault, path))
        if not later:
            self.sizes.pop((vault, path), None)
        if before is not None:
            old = live = before
        fresh = not known and vault not in self.new_vaults
        if max_vaults is None:
            return "unknown_tier"
        if fresh and self.vaults >= max_vaults:
            return "vaults_exceeded"
        if max(0, self.used + size - old) > max_bytes:
            return "storage_exceeded"
        self.used = max(0, self.used + size - live)
        if fresh:
            self.vaults += 1
            self.new_vaults.add(vault)
        if later:
            self.sizes[vault, path] = size
        return "ok"


def node_capacity(tenants: DataFrame, nodes: DataFrame) -> DataFrame:
    """tenant_id, active_nodes, verdict (unknown_tier, nodes_exceeded, ok) for registering one more node."""
    rows = join_on(with_limits(tenants.select("tenant_id", "plan_tier")), group_counts(nodes.where("not revoked"), ["tenant_id"], "active_nodes"), ["tenant_id"])
    n = F.coalesce("active_nodes", F.lit(0))
    return rows.select("tenant_id", n.alias("active_nodes"), F.when(F.col("max_nodes").isNull(), "unknown_tier").when(n >= F.col("max_nodes"), "nodes_exceeded").otherwise("ok").alias("verdict"))


def audit_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def audit_latest(events: DataFrame) -> DataFrame:
    """Time and payload of the newest event (by id) of each kind."""
    return events.groupBy("kind").agg(F.max_by(F.struct("ts_ms", "payload_json"), "id").alias("e")).select("kind", "e.ts_ms", "e.payload_json")


def tenant_export(users: DataFrame, billing: DataFrame, vaults: DataFrame, nodes: DataFrame) -> DataFrame:
    """user_id, document: a JSON export with the user, the tenant's tier, vaults and active devices.

    A tenant's part is written once a tenant and put into each user's document: documents grow with users times devices.
    """
    lists = vaults.groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("vault_id", "created_at"))).alias("vaults"))
    devices = nodes.where("not revoked").groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "registered_at"))).alias("devices"))
    rows = join_on(users.select("tenant_id").distinct(), billing.select("tenant_id", "plan_tier"), ["tenant_id"])
    rows = join_on(join_on(rows, lists, ["tenant_id"]), devices, ["tenant_id"])
    tenant = F.struct(
        "tenant_id", F.coalesce("plan_tier", F.lit("free")).alias("plan_tier"),
        F.coalesce("vaults", F.array().cast(rows.schema["vaults"].dataType)).alias("vaults"), F.coalesce("devices", F.array().cast(rows.schema["devices"].dataType)).alias("devices"),
    )
    own = users.select("user_id", "tenant_id", F.to_json(F.struct("user_id", "email")).alias("__user"))
    both = fan_out(own, rows.select("tenant_id", F.to_json(tenant).alias("__tenant")), ["tenant_id"], "user_id")
    return both.select("user_id", F.concat(F.lit('{"user":'), "__user", F.lit(',"tenant":'), "__tenant", F.lit("}")).alias("document"))


# Billing events


def subscription_events(bodies: DataFrame) -> DataFrame:
    """``bodies`` (event_no, tenant_id, body: JSON) with event_type, customer, subscription, tier and verdict.

    verdict: bad_json, ignored_type, inactive, unknown_plan, ok.
    """
    parsed = bodies.withColumn(
        "e", F.from_json("body", "type string, data struct<object: struct<id: string, customer: string, status: string, items: struct<data: array<struct<price: struct<lookup_key: string>>>>>>")
    )
    obj = F.col("e.data.object")
    key = F.get(obj["items"]["data"], F.lit(0))["price"]["lookup_key"]
    tier = F.when(key.isin("disk_free", "disk_pro", "disk_team"), F.substring(key, 6, 10))
    verdict = (
        F.when(F.col("e.type").isNull(), "bad_json")
        .when(~F.startswith(F.col("e.type"), F.lit("customer.subscription.")), "ignored_type")
        .when(~F.coalesce(obj["status"].isin("active", "trialing"), F.lit(False)), "inactive")
        .when(tier.isNull(), "unknown_plan")
        .otherwise("ok")
    )
    return parsed.select("event_no", "tenant_id", F.col("e.type").alias("event_type"), obj["customer"].alias("customer_id"), obj["id"].alias("subscription_id"), tier.alias("plan_tier"), verdict.alias("verdict"))


def apply_subscriptions(billing: DataFrame, events: DataFrame) -> DataFrame:
    """``billing`` (tenant_id, plan_tier, customer_id, subscription_id) after the last good event of each tenant."""
    good = events.where("verdict = 'ok'").select(*billing.columns, "event_no")
    return upsert(billing, good, ["tenant_id"], order=["event_no"])


# Roles and access


def acl_flatten(docs: DataFrame) -> DataFrame:
    """cert_fp, share, role, problem from ``docs`` (nodes: array<struct<cert_fingerprint, enabled, shares: map>>).

    Disabled nodes are left out; a fingerprint is 64 hex digits, maybe after ``sha256:``.
    """
    rows = docs.select(F.explode("nodes").alias("n")).where("n.enabled").select("n.cert_fingerprint", F.explode("n.shares").alias("share", "role"))
    fp = F.lower(F.regexp_extract("cert_fingerprint", r"\A(?:sha256:)?([0-9a-fA-F]{64})\z", 1))
    bad_role = ~F.col("role").isin("bidirectional", "receive_only", "send_only", "publisher")
    return rows.select(F.nullif(fp, F.lit("")).alias("cert_fp"), "share", "role", F.when(fp == "", "bad_fingerprint").when(bad_role, "bad_role").alias("problem"))


def role_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """cert_fp, share, old_role, new_role, change (added, removed, changed) between two role tables."""
    keys = ["cert_fp", "share"]
    both = join_on(before.select(*keys, F.col("role").alias("old_role")), after.select(*keys, F.col("role").alias("new_role")), keys, "full_outer")
    change = F.when(F.col("old_role").isNull(), "added").when(F.col("new_role").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_role").eqNullSafe(F.col("new_role"))).select(*keys, "old_role", "new_role", change.alias("change"))


def vault_access(requests: DataFrame, vaults: DataFrame, members: DataFrame) -> DataFrame:
    """``requests`` (user_id, tenant_id, vault_id) with data_tenant, access, may_read, may_write, may_manage.

    The tenant's own vault makes an owner; else membership (user_id, vault_id, owner_tenant, role) an editor or viewer; else
    denied. A member of vaults of one id under several tenants is let into that of the smallest tenant (null first).
    """
    rows = join_on(requests, vaults.select(*SCOPE, F.lit(True).alias("__own")).distinct(), SCOPE)
    one = members.groupBy("user_id", "vault_id").agg(F.min(F.struct("owner_tenant", "role")).alias("__m"))
    rows = rows.join(one.select("user_id", "vault_id", "__m.owner_tenant", "__m.role"), ["user_id", "vault_id"], "left")
    own = F.col("__own").isNotNull()
    access = F.when(own, "owner").otherwise(F.coalesce("role", F.lit("denied")))
    tenant = F.when(own, F.col("tenant_id")).when(F.col("role").isNotNull(), F.col("owner_tenant"))
    return rows.withColumn("access", access).select(
        *requests.columns, tenant.alias("data_tenant"), "access", (F.col("access") != "denied").alias("may_read"), F.col("access").isin("owner", "editor").alias("may_write"), (F.col("access") == "owner").alias("may_manage")
    )


def member_directory(members: DataFrame, users: DataFrame) -> DataFrame:
    """Vault members with their e-mail addresses."""
    return members.join(users.select("user_id", "email"), "user_id").select("owner_tenant", "vault_id", "user_id", "email", "role")


def org_directory(members: DataFrame, orgs: DataFrame, context: DataFrame) -> DataFrame:
    """Each user's organisations: role, may_manage, position by name in any case, and whether it is the active context.

    ``context`` (user_id, org_id) names the workspace a user chose; one of which they are no member leaves them personal.
    """
    rows = members.join(orgs.select("org_id", "name"), "org_id")
    rows = rows.join(context.select("user_id", F.col("org_id").alias("__active")), "user_id", "left")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy(F.lower("name"), "org_id"))
    return rows.select("user_id", "org_id", "name", "role", F.col("role").isin("owner", "admin").alias("may_manage"), at.alias("position"), F.coalesce(F.col("__active") == F.col("org_id"), F.lit(False)).alias("active"))


#: What an event and a hook meet by; hooks of one page and events of one block, about.
LISTED, PAGE_HOOKS, BLOCK_EVENTS = [*SCOPE, "event"], 4096, 1024


def webhook_pages(hooks: DataFrame) -> DataFrame:
    """SCOPE, event, page, hooks (hook_id, url): the enabled hooks with a secret that list an event, in pages of about PAGE_HOOKS.

    ``hooks`` (hook_id, SCOPE, url, secret, enabled, events_json).
    """
    ready = hooks.where("enabled and coalesce(secret, '') <> ''").select(*SCOPE, "hook_id", "url", F.explode(F.array_distinct(F.from_json("events_json", "array<string>"))).alias("event"))
    return in_blocks(ready, LISTED, "hook_id", PAGE_HOOKS, "page").groupBy(*LISTED, "page").agg(F.collect_list(F.struct("hook_id", "url")).alias("hooks"))


def _laid_out(rows: DataFrame, keys: Sequence[str], event: Column, pages: DataFrame) -> DataFrame:
    """``events`` (an ``event`` of ``rows``), ``hooks`` (some of a page's): what ``rows`` and ``pages`` of equal ``keys`` make, in strips.

    The driver gets the number of deliveries, by which they are dealt to tasks.
    """
    sums = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("__events")), pages.groupBy(*keys).agg(F.sum(F.size("hooks")).alias("__hooks"))
    n = join_on(*sums, keys, "inner").agg(F.sum(F.col("__events") * F.col("__hooks"))).first()[0] or 0
    blocks = in_blocks(rows, keys, "event_id", BLOCK_EVENTS, "block").groupBy(*keys, "block").agg(F.collect_list(event).alias("events"))
    return lay_out(join_on(blocks, pages, keys, "inner"), [*LISTED, "page", "block"], "events", "hooks", n)


def webhook_deliveries(matched: DataFrame, pages: DataFrame) -> DataFrame:
    """event_id, hook_id, url: the deliveries of events matched with pages (event_id, SCOPE, event, page), laid out in strips."""
    return _laid_out(matched, [*LISTED, "page"], F.struct("event_id"), pages).select("events.event_id", F.inline("hooks"))


def webhook_fanout(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """event_id, hook_id, url, body: a delivery for each enabled hook of the scope with a secret that lists the event.

    ``events`` (event_id, SCOPE, event, created_at, payload), maybe a stream; ``hooks`` as in ``webhook_pages``. A body is made once an
    event, and pages of hooks are laid out as the last step, by all tasks: the deliveries grow with events times hooks.
    """
    body = F.to_json(F.struct(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"), "event", "created_at", "vault_id", F.col("payload").alias("data")))
    pages = webhook_pages(hooks)
    if events.isStreaming:  # nothing can be counted or put in blocks
        return fan_out(events.select("event_id", *LISTED, body.alias("body")), pages.drop("page"), LISTED, "event_id").select("event_id", F.inline("hooks"), "body")
    return _laid_out(events, LISTED, F.struct("event_id", body.alias("body")), pages).select("events.event_id", F.inline("hooks"), "events.body")


def _after_first(rows: DataFrame, key: str, able: Column) -> DataFrame:
    """``rows`` with __earlier: an able attempt of the key comes before, in the order of (second, attempt_id).

    The first able one is a minimum, made on the map side, so a key with most of all rows is never one task's to sort.
    """
    stamp = F.struct("second", "attempt_id")
    first = rows.where(able).groupBy(key).agg(F.min(stamp).alias("__first"))
    return rows.join(first, key, "left").withColumn("__earlier", F.coalesce(stamp > F.col("__first"), F.lit(False)))


def enrollment_status(attempts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``attempts`` (attempt_id, token_hash, second) with status: not_found, revoked, replay, expired, ok, tested in this order.

    An ok uses the token up: attempts of one token count in the order of (second, attempt_id), and later ones are replays. Rows of
    one attempt have one status; a null token is not found.

    ``tokens`` (token_hash, issued_at, ttl, revoked, used); a time to live is an hour by default and a day at most.
    """
    ttl = F.least(F.coalesce("ttl", F.lit(3600)), F.lit(DAY))
    known = tokens.select("token_hash", (F.col("issued_at") + ttl).alias("expires_at"), "revoked", "used")
    able = F.coalesce(~F.col("revoked") & ~F.col("used") & (F.col("expires_at") >= F.col("second")), F.lit(False))
    rows = _after_first(attempts.join(known, "token_hash", "left"), "token_hash", able)
    used = F.col("used") | F.col("__earlier")
    status = F.when(F.col("expires_at").isNull(), "not_found").when(F.col("revoked"), "revoked").when(used, "replay").when(F.col("expires_at") < F.col("second"), "expired").otherwise("ok")
    return rows.select(*attempts.columns, status.alias("status"))


def invite_status(attempts: DataFrame, invites: DataFrame) -> DataFrame:
    """``attempts`` (attempt_id, code, second) with status: not_found, already_redeemed, expired, ok; ok redeems the invite once.

    ``invites`` (code, expires_at, redeemed). Attempts of one code count in the order of (second, attempt_id); rows of one attempt
    have one status, and a null code is not found.
    """
    able = F.coalesce(~F.col("redeemed") & (F.col("expires_at") >= F.col("second")), F.lit(False))
    rows = _after_first(attempts.join(invites, "code", "left"), "code", able)
    redeemed = F.col("redeemed") | F.col("__earlier")
    status = F.when(F.col("expires_at").isNull(), "not_found").when(redeemed, "already_redeemed").when(F.col("expires_at") < F.col("second"), "expired").otherwise("ok")
    return rows.select(*attempts.columns, status.alias("status"))


def key_cache_fresh(keys: DataFrame, as_of_ms: int, max_age_ms: int = DAY * 1000) -> DataFrame:
    """Publisher keys fetched less than a day ago."""
    return keys.where(F.lit(as_of_ms) - F.col("fetched_at_ms") < max_age_ms)


def key_sweep(keys: DataFrame, as_of_ms: int, max_age_ms: int = 30 * DAY * 1000) -> DataFrame:
    """The keys that a sweep leaves: those not older than 30 days."""
    return keys.where(F.lit(as_of_ms) - F.col("fetched_at_ms") <= max_age_ms)


# Mutations


def purge_tenants(tables: dict[str, DataFrame], tenants: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``tenants`` (tenant_id)."""
    return {name: join_on(df, tenants.select("tenant_id").distinct(), ["tenant_id"], "left_anti") for name, df in tables.items()}


def delete_accounts(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests with status, users left, tenants to purge): a request needs the account's e-mail, in any case.

    status: not_found, email_mismatch, deleted. A tenant is purged once no user of it is left.
    """
    rows = requests.join(users.select("user_id", F.col("email").alias("__email"), "tenant_id"), "user_id", "left")
    same = F.lower(F.trim("email")) == F.lower(F.trim("__email"))
    status = F.when(F.col("__email").isNull(), "not_found").when(same, "deleted").otherwise("email_mismatch")
    judged = rows.select(*requests.columns, "tenant_id", status.alias("status"))
    gone = judged.where("status = 'deleted'")
    left = users.join(gone.select("user_id").distinct(), "user_id", "left_anti")
    purge = join_on(gone.select("tenant_id").distinct(), left.select("tenant_id").distinct(), ["tenant_id"], "left_anti")
    return judged.drop("tenant_id"), left, purge


def resolve_conflicts(conflicts: DataFrame, decisions: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(conflicts after, decisions with status): status is invalid_action, not_found or ok.

    ``decisions`` (tenant_id, conflict_id, action); only unresolved conflicts of the tenant are found.
    """
    keys = ["tenant_id", "conflict_id"]
    open_ = conflicts.where("resolution is null").select(*keys, F.lit(True).alias("__open"))
    valid = F.col("action").isin("fork-local", "fork-remote", "merge", "keep-local", "keep-remote")
    judged = join_on(decisions, open_, keys).select(*decisions.columns, F.when(~valid, "invalid_action").when(F.col("__open").isNull(), "not_found").otherwise("ok").alias("status"))
    good = latest_wins(judged.where("status = 'ok'").select(*keys, "action"), keys, ["action"])
    after = join_on(conflicts, good.withColumnRenamed("action", "__action"), keys)
    now = F.col("__action").isNotNull() & F.col("resolution").isNull()
    after = after.withColumns({"resolution": F.when(now, F.col("__action")).otherwise(F.col("resolution")), "resolved_at": F.when(now, F.lit(as_of).cast("long")).otherwise(F.col("resolved_at"))})
    return after.drop("__action"), judged


def revoke_certs(certs: DataFrame, requests: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(certs after, changed): revoked_at is set where it was null."""
    asked = requests.select("cert_fp").distinct().withColumn("__asked", F.lit(True))
    rows = certs.join(asked, "cert_fp", "left")
    now = F.col("__asked").isNotNull() & F.col("revoked_at").isNull()
    after = rows.select(*[F.when(now, F.lit(as_of).cast("long")).otherwise(F.col(c)).alias(c) if c == "revoked_at" else F.col(c) for c in certs.columns])
    return after, rows.where(now).select("cert_fp")


def active_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("not revoked")


# Sequences


def replay_check(messages: DataFrame, keys: Sequence[str], counter: str, order: Sequence[str], segments: int = 1) -> DataFrame:
    """``messages`` with accepted: the counter is above all before it of its key (from 0), for rejected ones never exceed them.

    ``segments`` cuts the keys' rows for more tasks (``keys.running``); the result is the same.
    """
    seen = running(messages, keys, order, F.col(counter), "max", "__seen", segments)
    return seen.withColumn("accepted", F.col(counter) > F.coalesce("__seen", F.lit(0))).drop("__seen")


def acl_version_check(loads: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int = 1) -> DataFrame:
    """``loads`` with verdict: version_regress where a version above 0 is stored and the new one is not above it; else ok.

    ``segments`` as in ``replay_check``.
    """
    stored = F.coalesce("__seen", F.lit(0))
    seen = running(loads, keys, order, F.col("version"), "max", "__seen", segments)
    return seen.withColumn("verdict", F.when((stored > 0) & (F.col("version") <= stored), "version_regress").otherwise("ok")).drop("__seen")


def failure_window(attempts: DataFrame, window: int = 60, keys: Sequence[str] = ("key",)) -> DataFrame:
    """``attempts`` (key, second, event_id, success) with ``failures``: those of the last ``window`` seconds since a success.

    An upper bound of what the limiter counts, in one window pass: the limiter also leaves out what it blocked.
    """
    ordered = Window.partitionBy(*keys).orderBy("second", "event_id")
    epoch = F.coalesce(F.sum(F.col("success").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recent = Window.partitionBy(*keys, "__epoch").orderBy("second").rangeBetween(-(window - 1), 0)
    counted = attempts.withColumn("__epoch", epoch)
    return counted.withColumn("failures", F.count_if(~F.col("success")).over(recent)).drop("__epoch")


def judged_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], read: Sequence[str], added: str, fresh: Callable, judge: Callable) -> DataFrame:
    """``rows`` with the columns ``added``: each key's rows are judged in ``order``, a batch at a time.

    ``fresh(row)`` makes a key's state from the columns ``read`` of its first row, ``judge(rows, state)`` yields the added
    values and keeps the state up to date. A task holds one batch and one state, however many rows a key has.
    """
    new = StructType.fromDDL(added)
    schema = StructType([*rows.schema, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            whose, seen = (list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) for names in (keys, read))
            cuts = [i for i in range(len(whose)) if not i or whose[i] != whose[i - 1]]
            out = []
            for s, e in zip(cuts, [*cuts[1:], len(whose)], strict=True):
                if state is None or whose[s] != key:
                    key, state = whose[s], fresh(seen[s])
                out += judge(seen[s:e], state)
            columns = zip(*out, strict=True) if out else [[]] * len(new)
            more = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def limited(attempts: Iterable[tuple[int, bool]], failures: list[int], most: int, window: int) -> Iterable[tuple[str, int]]:
    """(status, retry_after) of each (second, success), in order; ``failures`` holds what is remembered and is kept up to date."""
    for at, success in attempts:
        failures[:] = [t for t in failures if max(0, at - t) < window]
        if len(failures) >= most:
            yield "blocked", max(1, window - max(0, at - min(failures)))
            continue
        if success:
            failures.clear()
        else:
            failures.append(at)
        yield ("ok" if success else "failed"), 0


def limiter_sessions(attempts: DataFrame, most: int = 5, window: int = 60, name: str = "__session") -> DataFrame:
    """``attempts`` with a number that rises within a key wherever the limiter provably remembers nothing.

    That is so at the start of a slot of ``window`` seconds whose slot before is empty, and after the last success of a slot
    that has, with the slot before, fewer than ``most`` failures (such a success is not blocked). Slots are counted on the map
    side; a key's slots, one row each, are numbered in one task.
    """
    failed, stamp = ~F.coalesce("success", F.lit(False)), F.struct("second", "event_id")
    rows = attempts.withColumn("__slot", F.floor(F.col("second") / window))
    slots = rows.groupBy("key", "__slot").agg(F.count_if(failed).alias("__failed"), F.max(F.when(F.col("success"), stamp)).alias("__last"))
    w = Window.partitionBy("key").orderBy("__slot")
    near = F.coalesce(F.lag("__slot").over(w) == F.col("__slot") - 1, F.lit(False))
    met = F.col("__failed") + F.when(near, F.lag("__failed").over(w)).otherwise(0)
    cuts = slots.withColumns({"__quiet": (~near).cast("long"), "__calm": F.when(met < most, F.col("__last"))})
    so_far = F.sum(F.col("__quiet") + F.col("__calm").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cuts = cuts.select("key", "__slot", "__calm", (F.coalesce(so_far, F.lit(0)) + F.col("__quiet")).alias("__from"))
    after = F.coalesce(stamp > F.col("__calm"), F.lit(False)).cast("long")
    return join_on(rows, cuts, ["key", "__slot"]).select(*attempts.columns, (F.col("__from") + after).alias(name))


def auth_rate_limit(attempts: DataFrame, most: int = 5, window: int = 60, split: bool = False) -> DataFrame:
    """``attempts`` (key, second, event_id, success) with status (ok, failed, blocked) and retry_after.

    What is blocked is neither remembered nor clears the key, so each attempt hangs on those before it: they are judged in
    order of (second, event_id), with at most ``most`` times held. With ``split`` a key's attempts are cut where the limiter
    remembers nothing (``limiter_sessions``), so a hot key is many tasks' work, unless it fails without a pause; the result is the
    same.
    """
    rows, keys = (limiter_sessions(attempts, most, window), ["key", "__session"]) if split else (attempts, ["key"])
    judged = judged_in_order(rows, keys, ["second", "event_id"], ["second", "success"], "status string, retry_after long", lambda row: [], lambda part, failures: limited(part, failures, most, window))
    return judged.drop("__session")


def bumped(writes: Iterable[int], current: list[int]) -> Iterable[tuple[str, int]]:
    """(status, revision) of each expected revision, in order; ``current`` holds the revision and is kept up to date."""
    for expected in writes:
        if expected == current[0]:
            current[0] += 1
            yield "applied", current[0]
        else:
            yield "conflict", current[0]


def revision_steps(writes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, __segment, __from, __at, __to: where a segment's writes take each revision that they expect.

    Revisions without a row stay as they are. A segment also has one row whose ``__at`` is null. The writes stream past from the last
    to the first; a task holds one segment's different revisions.
    """
    whose = [*keys, "__segment"]
    rows = writes.select(*whose, "__from", "expected", *[F.col(o).alias(f"__order{i}") for i, o in enumerate(order)])
    schema = StructType([*rows.select(*whose, "__from").schema, *StructType.fromDDL("__at long, __to long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (keys, segment, from) of the segment under way
        ends: dict[int, int] = {}

        def done() -> Iterator[pa.RecordBatch]:
            steps = [(None, None), *ends.items()]
            for s in range(0, len(steps), 10_000):
                part = steps[s : s + 10_000]
                values = [*([v] * len(part) for v in held), *map(list, zip(*part, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(values, schema, strict=True)], schema.names)

        for batch in batches:
            fixed = list(zip(*(batch.column(i).to_pylist() for i in range(len(whose) + 1)), strict=True))
            for now, expected in zip(fixed, batch.column(len(whose) + 1).to_pylist(), strict=True):
                if held is None or now[:-1] != held[:-1]:
                    if held is not None:
                        yield from done()
                    held, ends = now, {}
                if expected is not None:
                    ends[expected] = ends.get(expected + 1, expected + 1)
        if held is not None:
            yield from done()

    last_first = [F.col(f"__order{i}").desc() for i in range(len(order))]
    return rows.repartition(*whose).sortWithinPartitions(*whose, *last_first, F.desc("expected")).mapInArrow(run, schema)


def carried(steps: Iterable[tuple[int | None, int | None]], now: list[int]) -> Iterable[tuple[int]]:
    """(revision at the segment's start,) of each (at, to), a segment's first row having no ``at``; ``now`` is kept up to date."""
    for at, to in steps:
        if at is None:
            now[1] = now[0]
        elif at == now[1]:
            now[0] = to
        yield (now[1],)


def revision_bump(writes: DataFrame, keys: Sequence[str], order: Sequence[str], current: DataFrame | None = None, segments: int = 1) -> DataFrame:
    """``writes`` (keys, expected) with status (applied, conflict) and revision: the new one, or the current one.

    ``current`` (keys, revision) is where keys stand; others start at 0. Writes are judged in ``order``, those that tie from the
    least expected revision; a null one conflicts. With more than one of ``segments`` a key's writes are cut by the first column of ``order``
    (numbers): each segment says where it takes the revisions it expects (``revision_steps``), of those the ones that a segment
    can start from are carried on, key by key, and then every segment is judged by itself. The result is the same.
    """
    rows = join_on(writes, current.select(*keys, F.col("revision").alias("__from")), list(keys)) if current is not None else writes.withColumn("__from", F.lit(0).cast("long"))
    whose = list(keys)
    if segments > 1:
        whose.append("__segment")
        rows = in_segments(rows.withColumn("__from", F.coalesce("__from", F.lit(0))), order[0], segments)
        steps = revision_steps(rows, keys, order)
        # A segment starts from where its key stood or from where an earlier segment led; the null is for the rows without an ``__at``.
        starts = steps.select(*keys, F.explode(F.array(F.coalesce("__to", "__from"), F.lit(None))).alias("__at")).distinct()
        able = join_on(steps, starts, [*keys, "__at"], "left_semi")
        begun = judged_in_order(able, keys, ["__segment", "__at"], ["__at", "__to", "__from"], "__start long", lambda row: [row[2]] * 2, lambda part, now: carried((r[:2] for r in part), now))
        begun = begun.where("__at is null").select(*whose, "__start")
        rows = join_on(rows, begun, whose).withColumn("__from", F.col("__start")).drop("__start")
    judged = judged_in_order(rows, whose, [*order, "expected"], ["expected", "__from"], "status string, revision long", lambda row: [row[1] or 0], lambda part, now: bumped((r[0] for r in part), now))
    return judged.drop("__from", "__segment")
