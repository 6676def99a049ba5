"""Views of the given tables as manifests, versions, events and the like: pure projections, in Spark SQL and DuckDB alike.

A view is one SQL text in which table names are marked ``$name`` and the few functions whose names differ are macros.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """What differs between the two SQL dialects."""

    table: Callable[[str], str]
    sha: Callable[[str], str]
    div: Callable[[str, int], str]
    size: Callable[[str], str]
    epoch: Callable[[str], str]
    micros: Callable[[str], str]
    json_int: Callable[[str, str], str]
    #: Spark evaluates what stands beside a window before its exchange: hashes and names would be shuffled in place of the table's own columns.
    inner_windows: bool = False


def spark_dialect(sf_dir: str) -> Dialect:
    since = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return Dialect(
        table=lambda t: f"parquet.`{sf_dir}/{t}.parquet`",
        sha=lambda x: f"sha2({x}, 256)",
        div=lambda a, b: f"(({a}) div {b})",
        size=lambda x: f"CAST(octet_length({x}) AS BIGINT)",
        epoch=lambda x: f"timestampdiff(SECOND, {since}, {x})",
        micros=lambda x: f"timestampdiff(MICROSECOND, {since}, {x})",
        json_int=lambda x, k: f"CAST(get_json_object({x}, '$.{k}') AS BIGINT)",
        inner_windows=True,
    )


DUCK = Dialect(
    table=lambda t: t,
    sha=lambda x: f"sha256({x})",
    div=lambda a, b: f"(({a}) // {b})",
    size=lambda x: f"CAST(strlen({x}) AS BIGINT)",
    epoch=lambda x: f"CAST(epoch_us({x}) // 1000000 AS BIGINT)",
    micros=lambda x: f"epoch_us({x})",
    json_int=lambda x, k: f"CAST(json_extract_string({x}, '$.{k}') AS BIGINT)",
)

#: The second that "now" is in the registered queries.
AS_OF = 1_000_000_000


def _views(d: Dialect) -> dict[str, str]:
    scope = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 't' || CAST(doc_id % 5 AS STRING) END AS tenant_id, 'v' || CAST((doc_id % 7) % 3 AS STRING) AS vault_id"

    def snapshot(side: str, presence: str, text: str, path: str, ca: str, cb: str) -> str:
        return (
            f"SELECT tenant_id, vault_id, 'node-{side}' AS node_id, {path} AS path, {d.sha(text)} AS content_hash, {d.size(text)} AS size, mtime_ns, inode, "
            f"{ca} AS ca, {cb} AS cb, {presence} = 2 AS deleted, CASE WHEN {presence} = 2 THEN doc_id * 86400 END AS deleted_at, doc_id, {text} AS text FROM base WHERE {presence} > 0"
        )

    version = "CAST(row_number() OVER (PARTITION BY l_suppkey % 10, l_suppkey % 3, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT)"
    lines = "$lineitem"
    if d.inner_windows:
        lines, version = f"(SELECT *, {version} AS version_id FROM $lineitem) n", "version_id"
    moved = "(doc_id % 27 = 13 AND doc_id % 2 = 0)"
    return {
        "base": (
            f"SELECT doc_id, {scope}, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.md' AS path, text, doc_id AS inode, doc_id * 1000000000 AS mtime_ns, "
            f"{d.div('doc_id % 27', 9)} AS pl, {d.div('doc_id % 27', 3)} % 3 AS pr, doc_id % 3 AS pi, {d.div('doc_id', 27)} % 5 AS e FROM $documents"
        ),
        "local_files": snapshot(
            "l", "pl", f"CASE WHEN {moved} THEN text WHEN e IN (1, 3) THEN text || '#L' WHEN e = 4 THEN text || '#X' ELSE text END",
            f"CASE WHEN {moved} THEN 'moved/' || path ELSE path END", "doc_id % 7", "doc_id % 4",
        ),
        "remote_files": snapshot("r", "pr", "CASE WHEN e IN (2, 3) THEN text || '#R' WHEN e = 4 THEN text || '#X' ELSE text END", "path", "(doc_id + doc_id % 2) % 7", "(doc_id + doc_id % 3) % 4"),
        "indexed_files": snapshot("i", "pi", "text", "path", "doc_id % 7", "doc_id % 4"),
        "rules": (
            "SELECT DISTINCT tenant_id, vault_id, prefix FROM (SELECT tenant_id, vault_id, 'src1' AS prefix FROM base WHERE vault_id <> 'v2' "
            "UNION ALL SELECT tenant_id, vault_id, 'src2/en' AS prefix FROM base WHERE vault_id <> 'v2') p"
        ),
        "writes": (
            f"SELECT CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 't' || CAST(conv_id % 4 AS STRING) END AS tenant_id, 'v' || CAST(conv_id % 2 AS STRING) AS vault_id, "
            f"CAST(conv_id AS STRING) AS path, turn AS seq, {d.sha('role')} AS content_hash, {d.size('text')} AS size, conv_id * 1000 + turn * 86400 AS created_at, turn % 6 = 5 AS deleted FROM $conversations"
        ),
        "history": (
            f"SELECT 't' || CAST(l_suppkey % 10 AS STRING) AS tenant_id, 'v' || CAST(l_suppkey % 3 AS STRING) AS vault_id, CAST(l_partkey AS STRING) AS path, {version} AS version_id, "
            f"{d.sha('CAST(l_orderkey AS STRING)')} AS content_hash, CAST(l_quantity AS BIGINT) AS size, {d.epoch('l_shipdate')} AS created_at FROM {lines}"
        ),
        "files": (
            f"SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE 't' || CAST(o_custkey % 50 AS STRING) END AS tenant_id, o_orderpriority AS vault_id, CAST(o_orderkey AS STRING) AS path, "
            f"{d.sha('CAST(o_orderkey % 997 AS STRING)')} AS content_hash, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus = 'F' AS deleted, "
            f"CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN {d.epoch('o_orderdate')} END AS deleted_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END AS version_id, o_orderkey FROM $orders"
        ),
        "tenants": (
            "SELECT DISTINCT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 't' || CAST(c_custkey % 50 AS STRING) END AS tenant_id, "
            "CASE (c_custkey % 50) % 7 WHEN 0 THEN 'Pro' WHEN 1 THEN 'TEAM' WHEN 2 THEN NULL WHEN 3 THEN 'free' WHEN 4 THEN 'gold' WHEN 5 THEN 'pro' ELSE 'team' END AS plan_tier FROM $customer"
        ),
        "users": (
            "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 't' || CAST(c_custkey % 50 AS STRING) END AS tenant_id, "
            "'User' || CAST(c_custkey AS STRING) || '@Example.org' AS email, c_nationkey, c_custkey FROM $customer"
        ),
        "nodes": (
            "SELECT s_name AS node_id, CASE WHEN s_suppkey % 50 = 0 THEN NULL ELSE 't' || CAST(s_suppkey % 50 AS STRING) END AS tenant_id, s_acctbal < 0 AS revoked, s_suppkey * 100 AS registered_at, s_suppkey FROM $supplier"
        ),
        "vaults": "SELECT tenant_id, vault_id, min(o_orderkey) AS created_at FROM files WHERE o_orderkey % 3 = 0 GROUP BY tenant_id, vault_id",
        "conflicts": (
            "SELECT tenant_id, vault_id, path, doc_id AS conflict_id, doc_id * 3600 AS created_at, CASE WHEN doc_id % 4 = 0 THEN 'merge' END AS resolution, "
            f"CASE WHEN doc_id % 4 = 0 THEN {AS_OF} - doc_id * 86400 END AS resolved_at FROM base WHERE e = 3"
        ),
        "attempts": f"SELECT user_id AS key, {d.div(d.epoch('ts'), 600)} AS second, event_id, event_type = 'signup' AS success FROM $events WHERE event_type IN ('error', 'signup')",
        "messages": f"SELECT user_id AS key, event_id, {d.json_int('props', 'k')} AS counter FROM $events",
        "audit": (
            f"SELECT event_id AS id, {d.div(d.micros('ts'), 1000)} AS ts_ms, CASE event_type WHEN 'error' THEN 'acl.load_failure' WHEN 'signup' THEN 'enrollment.completed' WHEN 'click' THEN 'acl.load_ok' "
            "WHEN 'view' THEN 'share.unknown' ELSE 'config.reload' END AS kind, CAST(user_id AS STRING) AS share, props AS payload_json FROM $events"
        ),
        "objects": (
            f"SELECT page_id, substr(url, instr(url, '://') + 3) AS path, {d.size('html')} AS size, {d.sha('html')} AS content_hash, page_id * 1000 AS mtime_ns, page_id * 10 AS created_at_ns FROM $pages"
        ),
        "catalog": "SELECT path, max(size) AS size, max(content_hash) AS content_hash, max(mtime_ns) AS mtime_ns, min(created_at_ns) AS created_at_ns FROM objects WHERE page_id % 3 <> 0 GROUP BY path",
        "incoming": "SELECT path, min(size) AS size, min(content_hash) AS content_hash, min(mtime_ns) + 7 AS mtime_ns, max(created_at_ns) + 7 AS created_at_ns FROM objects WHERE page_id % 3 = 0 OR page_id % 5 = 0 GROUP BY path",
        "listing": f"SELECT tenant_id, vault_id, path, CASE WHEN doc_id % 50 = 8 THEN 'dir' WHEN doc_id % 50 = 9 THEN 'symlink' ELSE 'file' END AS kind, {d.sha('text')} AS content_hash, {d.size('text')} AS size FROM base WHERE doc_id % 4 <> 0",
        "index_rows": (
            f"SELECT tenant_id, vault_id, path, CASE WHEN doc_id % 13 = 0 THEN 'short' WHEN doc_id % 7 = 0 THEN {d.sha(chr(39) + 'old' + chr(39))} ELSE {d.sha('text')} END AS content_hash, {d.size('text')} AS size, doc_id % 6 = 0 AS deleted, "
            "CASE WHEN doc_id % 6 = 0 THEN doc_id * 86400 END AS deleted_at, doc_id FROM base WHERE doc_id % 5 <> 0"
        ),
        "manifests": (
            f"SELECT b.vault_id, b.path AS source_path, CASE WHEN v.vec_id % 5 = 1 THEN {d.sha(chr(39) + 'old' + chr(39))} ELSE {d.sha('b.text')} END AS content_hash, CASE WHEN v.vec_id % 7 = 1 THEN 'm0' ELSE 'm1' END AS model_id, "
            "CASE WHEN v.vec_id % 11 = 1 THEN 32 ELSE 64 END AS dimensions, CASE WHEN v.vec_id % 13 = 1 THEN CAST(128 AS BIGINT) ELSE CAST(256 AS BIGINT) END AS vector_bytes, v.vec_id FROM base b JOIN $embeddings v ON b.doc_id = v.vec_id"
        ),
        "sidecar_vectors": "SELECT vault_id, source_path, CAST(256 AS BIGINT) AS bytes FROM manifests WHERE vec_id % 17 <> 1",
        "hooks": (
            "SELECT s_suppkey AS hook_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 't' || CAST(s_suppkey % 5 AS STRING) END AS tenant_id, 'v' || CAST(s_suppkey % 3 AS STRING) AS vault_id, 'https://' || s_name AS url, "
            "CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS secret, s_acctbal > 0 AS enabled, "
            "CASE WHEN s_suppkey % 2 = 0 THEN '[\"sync.file_deleted\",\"sync.file_changed\"]' ELSE '[\"sync.file_deleted\"]' END AS events_json FROM $supplier"
        ),
        "acl": (
            f"SELECT {d.sha('s_name')} AS cert_fp, 'share' || CAST(c_custkey % 8 AS STRING) AS share, "
            "CASE c_custkey % 4 WHEN 0 THEN 'bidirectional' WHEN 1 THEN 'receive_only' WHEN 2 THEN 'send_only' ELSE 'publisher' END AS role, s_suppkey, c_custkey "
            "FROM $supplier JOIN $customer ON c_custkey = s_suppkey"
        ),
    }


_NAME = re.compile(r"\b(FROM|JOIN)\s+(\w+)\b")


def _needed(sql: str, views: dict[str, str], found: list[str]) -> list[str]:
    for _, name in _NAME.findall(sql):
        if name in views and name not in found:
            _needed(views[name], views, found)
            found.append(name)
    return found


def compose(sql: str, d: Dialect) -> str:
    """``sql`` with the views it reads as common table expressions, and table marks resolved."""
    views = _views(d)
    names = _needed(sql, views, [])
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    head = ", ".join(f"{n} AS ({views[n]})" for n in names)
    text = f"WITH {own[1] or ''}{head}, {sql[own.end():]}" if own and head else f"WITH {head} {sql}" if head else sql
    return re.sub(r"\$(\w+)", lambda m: d.table(m[1]), text)


def duck(sql: str) -> str:
    return compose(sql, DUCK)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; snapshots get their clocks as a map."""
    df = spark.sql(compose(f"SELECT * FROM {name}", spark_dialect(sf_dir)))
    if "ca" in df.columns:
        clock = F.create_map(F.lit("nodeA"), F.col("ca").cast("long"), F.lit("nodeB"), F.col("cb").cast("long"))
        df = df.withColumn("vector_clock", clock).drop("ca", "cb")
    return df


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(compose(sql, spark_dialect(sf_dir)))
