"""Registered queries on blocks, archives, merges, paths and event streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.blocks import verify_hash
from ..operators import blocks, merge
from ..schemas import KEY
from ..sources.files import fs_events as fs_event_rows
from ..streaming.events import audit_counts_stream
from ..streaming.events import debounce as settle
from .fixtures import AS_OF, query, view
from .reconcile_queries import same
from .registry import register

#: Few texts pass 4096 bytes, so the registered queries cut smaller blocks.
BLOCK = 256


def _files(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return view(spark, sf_dir, f"{side}_files").select(F.concat_ws("|", F.coalesce("tenant_id", F.lit("")), "vault_id", "path").alias("file_key"), F.encode("text", "UTF-8").alias("content"))


def _signed(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return blocks.block_signatures(_files(spark, sf_dir, side), BLOCK)


#: Blocks as rows of hexadecimal text, which both kinds of SQL can cut and join.
def _duck_blocks(side: str, name: str) -> str:
    return f"""{name} AS (SELECT file_key, i AS block_no, i * {BLOCK} AS "offset", unhex(substr(h, i * {2 * BLOCK} + 1, {2 * BLOCK})) AS data FROM (
      SELECT coalesce(tenant_id, '') || '|' || vault_id || '|' || path AS file_key, hex(encode(text)) AS h FROM {side}_files WHERE text <> '') f, unnest(range(CAST(ceil(length(h) / {2.0 * BLOCK}) AS BIGINT))) t(i))"""


_WEAK = """(SELECT (sum(b * (n - k)) % 65521) * 65536 + sum(b) % 65521 FROM (SELECT octet_length(data) AS n, CAST(k AS BIGINT) AS k, CAST(('0x' || hex(data)[2 * k + 1 : 2 * k + 2]) AS BIGINT) AS b FROM unnest(range(octet_length(data))) t(k)) z)"""


@register(f'WITH {_duck_blocks("remote", "b")} SELECT file_key, CAST(block_no AS INTEGER) AS block_no, "offset", octet_length(data) AS length, sha256(data) AS strong FROM b')
def block_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_signatures(_files(spark, sf_dir, "remote"), BLOCK, signed=False).select("file_key", "block_no", "offset", F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("strong"))


@register(f'WITH {_duck_blocks("indexed", "b")} SELECT file_key, "offset", CAST({_WEAK} AS BIGINT) AS weak FROM b')
def weak_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir, "indexed").select("file_key", "offset", "weak")


_PLAN = f"""{_duck_blocks("local", "c")}, {_duck_blocks("indexed", "b")}, k AS (SELECT file_key, sha256(data) AS strong, max("offset") AS base_offset FROM b GROUP BY ALL),
  plan AS (SELECT c.file_key, c."offset", octet_length(c.data) AS length, CASE WHEN k.base_offset IS NULL THEN 'miss' ELSE 'hit' END AS kind, k.base_offset, CASE WHEN k.base_offset IS NULL THEN c.data END AS data
    FROM c LEFT JOIN k ON k.file_key = c.file_key AND k.strong = sha256(c.data))"""


@register(f'WITH {_PLAN} SELECT file_key, "offset", length, kind, base_offset, sha256(data) AS data_hash FROM plan')
def delta_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = blocks.delta_plan(_signed(spark, sf_dir, "local"), _signed(spark, sf_dir, "indexed"))
    return plan.select("file_key", "offset", F.col("length").cast("long").alias("length"), "kind", "base_offset", F.sha2("data", 256).alias("data_hash"))


@register(f"""WITH {_PLAN} SELECT file_key, "offset", length, sha256(data) AS data_hash FROM plan WHERE kind = 'miss'""")
def delta_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are planned first; of the data only what misses moves."""
    client = blocks.block_signatures(_files(spark, sf_dir, "local"), BLOCK, signed=False)
    keys = client.select("file_key", "offset", F.octet_length("data").alias("length"), F.sha2("data", 256).alias("strong"))
    found = blocks.miss_data(blocks.delta_plan(keys, _signed(spark, sf_dir, "indexed")), client)
    return found.select("file_key", "offset", F.col("length").cast("long").alias("length"), F.sha2("data", 256).alias("data_hash"))


@register("SELECT coalesce(tenant_id, '') || '|' || vault_id || '|' || path AS file_key, content_hash, size FROM local_files WHERE text <> ''")
def delta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together as chunks, hashed as they stream past."""
    base, client = _signed(spark, sf_dir, "indexed"), _files(spark, sf_dir, "local")
    chunks = blocks.delta_chunks(blocks.delta_plan(blocks.block_signatures(client, BLOCK, signed=False).withColumn("strong", F.sha2("data", 256)), base), base)
    return blocks.chunk_digests(chunks).select("file_key", "content_hash", "size")


@register("SELECT coalesce(tenant_id, '') || '|' || vault_id || '|' || path AS file_key, content_hash, CAST(NULL AS VARCHAR) AS error FROM local_files")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, client = _signed(spark, sf_dir, "indexed"), _files(spark, sf_dir, "local")
    rebuilt = blocks.delta_apply(blocks.delta_plan(blocks.block_signatures(client, BLOCK), base), base, client)
    return rebuilt.select("file_key", F.sha2("content", 256).alias("content_hash"), "error")


@register(
    f"""WITH {_duck_blocks("indexed", "b")}, k AS (SELECT file_key, hex(data) AS h, max("offset") AS base_offset FROM b WHERE octet_length(data) = {BLOCK} GROUP BY ALL),
    c AS (SELECT coalesce(tenant_id, '') || '|' || vault_id || '|' || path AS file_key, hex(encode('inserted' || text)) AS h FROM local_files),
    p AS (SELECT file_key, j * 512 AS "at", substr(h, j * 1024 + 1, 1024 + {2 * BLOCK - 2}) AS h FROM c, unnest(range(length(h) // 1024 + 1)) t(j) WHERE file_key IN (SELECT file_key FROM k)),
    w AS (SELECT file_key, "at" + i AS "offset", substr(h, 2 * i + 1, {2 * BLOCK}) AS h FROM p, unnest(range(greatest(0, least(512, length(h) // 2 - {BLOCK - 1})))) t(i))
    SELECT w.file_key, w."offset", k.base_offset FROM w JOIN k ON k.file_key = w.file_key AND k.h = w.h"""
)
def shifted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _files(spark, sf_dir, "local").withColumn("content", F.concat(F.encode(F.lit("inserted"), "UTF-8"), "content"))
    return blocks.shifted_matches(moved, _signed(spark, sf_dir, "indexed"), BLOCK)


@register(
    f"""SELECT coalesce(tenant_id, '') || '|' || vault_id || '|' || path AS file_key, CASE WHEN doc_id % 10 = 1 AND text <> '' THEN 'chunk_integrity' WHEN doc_id % 10 = 2 THEN 'content_mismatch' ELSE 'ok' END AS status FROM local_files"""
)
def verify_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "local_files").withColumn("file_key", F.concat_ws("|", F.coalesce("tenant_id", F.lit("")), "vault_id", "path"))
    chunks = blocks.block_signatures(files.select("file_key", F.encode("text", "UTF-8").alias("content")), BLOCK, signed=False).join(files.select("file_key", "doc_id"), "file_key")
    strong = F.when((F.col("doc_id") % 10 == 1) & (F.col("block_no") == 0), F.sha2(F.lit("x"), 256)).when(F.col("doc_id") % 10 == 3, "").otherwise(F.sha2("data", 256))
    expected = files.select("file_key", F.when(F.col("doc_id") % 10 == 2, F.sha2(F.lit("y"), 256)).when(F.col("doc_id") % 10 == 4, "").otherwise(F.col("content_hash")).alias("content_hash"))
    return blocks.verify_upload(chunks.withColumn("strong", strong), expected)


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("a/.disk-archive/"), "path")).when(F.col("doc_id") == 1, "index.json").when(F.col("doc_id") % 31 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    return view(spark, sf_dir, "base").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))


ARCHIVE = "SELECT CASE WHEN doc_id % 31 = 0 THEN '../' || path ELSE path END AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest, doc_id FROM base WHERE doc_id % 50 <> 0 AND doc_id <> 1"


@register(f"SELECT path, size, digest FROM ({ARCHIVE}) a")
def archive_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.archive_create(archive_files(spark, sf_dir))[0]


@register(f"SELECT DISTINCT digest, left(digest, 2) AS hh FROM ({ARCHIVE}) a")
def archive_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.archive_create(archive_files(spark, sf_dir))[1].select("digest", "hh")


@register(
    f"""SELECT path, size, digest, CASE WHEN path LIKE '../%' THEN 'unsafe_path' WHEN left(digest, 1) = '0' THEN 'missing' WHEN left(digest, 1) = '1' THEN 'integrity_failed' ELSE 'ok' END AS status FROM ({ARCHIVE}) a"""
)
def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, slots = blocks.archive_create(archive_files(spark, sf_dir))
    broken = slots.where("digest not like '0%'").withColumn("content", F.when(F.startswith("digest", F.lit("1")), F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")))
    return blocks.archive_restore(index, broken)


@register(f"SELECT tenant_id, vault_id, path, content_hash, doc_id % 3 <> 0 AS good FROM indexed_files")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "indexed_files")
    data = F.encode("text", "UTF-8")
    claimed = F.when(F.col("doc_id") % 3 == 0, F.lit("0" * 64)).otherwise(F.upper("content_hash"))
    return files.select(*KEY, F.sha2(data, 256).alias("content_hash"), verify_hash(data, claimed).alias("good"))


# Merges

_CONFLICTED = "SELECT r.tenant_id, r.vault_id, r.path, r.doc_id FROM remote_files r JOIN local_files l ON " + same("l", "r") + " WHERE l.content_hash <> r.content_hash"


def _conflicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote = (view(spark, sf_dir, f"{s}_files").select(*KEY, F.encode("text", "UTF-8").alias(s), "content_hash") for s in ("local", "remote"))
    both = merge.join_on(local.withColumnRenamed("content_hash", "h"), remote, KEY, "inner").where("h <> content_hash").drop("h", "content_hash")
    return both.withColumn("node_id", F.lit("node-i"))


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = view(spark, sf_dir, "indexed_files")
    blobs = indexed.select("content_hash", F.encode("text", "UTF-8").alias("data")).dropDuplicates(["content_hash"])
    return merge.merge_bases(_conflicted(spark, sf_dir), indexed, blobs)


@register(f"WITH c AS ({_CONFLICTED}) SELECT c.tenant_id, c.vault_id, c.path, i.content_hash AS base_hash FROM c LEFT JOIN indexed_files i ON {same('i', 'c')} AND NOT i.deleted")
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir).select(*KEY, F.sha2("base", 256).alias("base_hash"))


@register(None)
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.three_way_merge(_bases(spark, sf_dir).select(*KEY, "base", "local", "remote")).select(*KEY, "outcome", "reason", F.sha2("merged", 256).alias("merged_hash"))


_SIDES = """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'a.bin' ELSE 'a.md' END AS path, CASE WHEN doc_id % 4 <> 3 THEN 'one' || NL || body || NL || 'last' || NL END AS base, 'ONE' || NL || body || NL || 'last' || NL AS local,
  CASE WHEN doc_id % 4 = 1 THEN 'Uno' || NL || body || NL || 'last' || NL ELSE 'one' || NL || body || NL || 'LAST' || NL END AS remote, body FROM (SELECT doc_id, replace(text, NL, ' ') AS body FROM $documents WHERE text IS NOT NULL) d""".replace("NL", "chr(10)")


@register(
    f"""WITH s AS ({_SIDES}) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'conflicted' ELSE 'fork' END AS outcome, CASE doc_id % 4 WHEN 2 THEN 'extension' WHEN 3 THEN 'no_base' ELSE 'ok' END AS reason,
      CASE doc_id % 4 WHEN 0 THEN sha256('ONE' || chr(10) || body || chr(10) || 'LAST' || chr(10)) WHEN 1 THEN sha256('<<<<<<< local' || chr(10) || 'ONE' || chr(10) || '=======' || chr(10) || 'Uno' || chr(10) || '>>>>>>> remote' || chr(10) || body || chr(10) || 'last' || chr(10)) END AS merged_hash FROM s"""
)
def line_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges whose outcome their making fixes: edits of different lines, of one line, a binary name, no base."""
    sides = query(spark, sf_dir, _SIDES).select("doc_id", "path", *[F.encode(c, "UTF-8").alias(c) for c in ("base", "local", "remote")])
    return merge.three_way_merge(sides).select("doc_id", "outcome", "reason", F.sha2("merged", 256).alias("merged_hash"))


@register(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_base' WHEN strlen(text) > 8000 THEN 'too_large' WHEN doc_id % 5 = 0 THEN 'binary' WHEN doc_id % 3 = 0 THEN 'not_text' ELSE 'ok' END AS verdict FROM base"""
)
def merge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")  # a null text is an empty file
    n = F.col("doc_id")
    local = F.when(n % 5 == 0, F.overlay(data, F.lit(bytearray(b"\0")), 1, 1)).otherwise(data)
    remote = F.when(n % 3 == 0, F.overlay(data, F.lit(bytearray(b"\xff")), 1, 1)).otherwise(data)  # no longer, so at the limit too
    return view(spark, sf_dir, "base").select("doc_id", paths.merge_guard(F.when(n % 7 != 0, data), local, remote, max_bytes=8000).alias("verdict"))


# Paths

_PATHS = """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN '.git/' || path WHEN 1 THEN 'a/.Dreamer/' || path WHEN 2 THEN path || '/.KB-last-push' WHEN 3 THEN '.version-blobs/' || path WHEN 4 THEN '.disk-embeddings/' || path || '.vec.bin' WHEN 5 THEN replace(path, '.md', '.TXT')
  WHEN 6 THEN '/' || path WHEN 7 THEN '../' || path WHEN 8 THEN replace(path, '.md', '') WHEN 9 THEN 'drafts/' || path WHEN 10 THEN path || '.tmp' ELSE path END AS path, tenant_id FROM base"""


@register(
    f"""SELECT doc_id, doc_id % 12 IN (0, 1, 2, 8, 9, 10) AS excluded, doc_id % 12 = 2 AS marker, doc_id % 12 = 3 AS internal, doc_id % 12 = 4 AS co_storage, '.disk-embeddings/' || path || '.manifest.json' AS manifest, '.disk-embeddings/' || path || '.vec.bin' AS vector,
      CASE doc_id % 12 WHEN 6 THEN 'absolute' WHEN 7 THEN 'parent_segment' END AS violation, CASE WHEN doc_id % 12 <> 7 THEN ltrim(path, '/') END AS normal FROM ({_PATHS}) p"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    rules = paths.FilterRules(extensions=(".MD", "txt"), deny=("DRAFTS",), ignore=("**/*.tmp",))
    odd = F.concat(F.lit("  "), F.replace(p, F.lit("/"), F.lit("\\")), F.lit("/ "))
    return query(spark, sf_dir, _PATHS).select(
        "doc_id", paths.is_excluded(p, rules).alias("excluded"), paths.is_ephemeral_marker(p).alias("marker"), paths.is_internal_path(p).alias("internal"), paths.is_co_storage(p).alias("co_storage"),
        paths.manifest_path(p).alias("manifest"), paths.vector_path(p).alias("vector"), paths.path_violation(p).alias("violation"), paths.normalize_rel(odd).alias("normal"),
    )


_HEADERS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 't' || CAST(user_id % 4 AS STRING) END AS header, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 't' || CAST(user_id % 3 AS STRING) END AS body, CASE WHEN event_id % 5 < 3 THEN 't1' END AS bound FROM $events"


@register(
    f"""WITH r AS (SELECT *, CASE WHEN header IS NOT NULL THEN nullif(header, '') ELSE nullif(body, '') END AS tenant FROM ({_HEADERS}) h), m AS (SELECT *, coalesce(tenant <> bound, false) AS bad FROM r)
    SELECT event_id, tenant, CASE WHEN NOT bad THEN coalesce(tenant, bound) END AS bound_tenant, CASE WHEN bad THEN 'mismatch' ELSE 'ok' END AS verdict, coalesce(tenant, '_legacy') AS shard FROM m"""
)
def tenant_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query(spark, sf_dir, _HEADERS).withColumn("tenant", paths.resolve_tenant(F.col("header"), F.col("body")))
    bound = rows.withColumn("b", paths.bind_tenant(F.col("tenant"), F.col("bound")))
    return bound.select("event_id", "tenant", F.col("b.tenant_id").alias("bound_tenant"), F.col("b.verdict").alias("verdict"), paths.shard_key(F.col("tenant")).alias("shard"))


@register(
    "SELECT doc_id, 'src/' || CASE doc_id % 4 WHEN 0 THEN 'a.tar.sync-conflict-' || left(h, 8) || '-20010909-' || t || '.gz' WHEN 1 THEN '.hidden.sync-conflict-' || left(h, 8) || '-20010909-' || t WHEN 2 THEN 'plain.sync-conflict-' || left(h, 8) || '-20010909-' || t "
    f"ELSE '.cfg.sync-conflict-' || left(h, 8) || '-20010909-' || t || '.json' END AS fork FROM (SELECT doc_id, sha256(path) AS h, strftime(to_timestamp({AS_OF} + doc_id % 3600) AT TIME ZONE 'UTC', '%H%M%S') AS t FROM base) b"
)
def fork_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(f"src/{n}") for n in ("a.tar.gz", ".hidden", "plain", ".cfg.json")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return view(spark, sf_dir, "base").select("doc_id", paths.fork_filename(name, F.concat(F.lit("-XG"), F.sha2("path", 256)), F.lit(AS_OF) + F.col("doc_id") % 3600).alias("fork"))


# Event streams in batch form


def _fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("change")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("v0").alias("vault_id"), F.col("user_id").cast("string").alias("path"), kind.alias("kind"), F.col("ts").alias("event_time"))


@register(
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM $events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
    SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'delete' ELSE 'change' END AS kind, arg_max(event_id, (ts, event_id)) AS event_id FROM b GROUP BY user_id, burst"""
)
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(_fs_events(spark, sf_dir), "2 hours").select("path", "kind", "event_id")


@register("SELECT epoch_us(date_trunc('hour', ts)) AS window_us, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'change' END AS kind, count(*) AS n FROM $events GROUP BY ALL")
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit_counts_stream(_fs_events(spark, sf_dir))
    return counts.select(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', window_start)").alias("window_us"), "kind", "n")


@register(
    """SELECT event_id, CAST(0 AS INTEGER) AS seq, 'p' || user_id AS path, CASE WHEN event_type IN ('error', 'purchase') THEN 'delete' ELSE 'change' END AS kind FROM $events WHERE event_type <> 'view'
    UNION ALL SELECT event_id, 1, 'q' || user_id, 'change' FROM $events WHERE event_type = 'purchase'"""
)
def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.col("event_type")
    notice = F.when(t == "error", "remove").when(t == "purchase", "rename_both").when(t == "view", "access").when(t == "click", "modify").otherwise("create")
    user = F.col("user_id").cast("string")
    both = F.array(F.concat(F.lit("p"), user), F.concat(F.lit("q"), user))
    rows = raw.select("event_id", F.lit("v0").alias("vault_id"), notice.alias("event_type"), F.when(t == "purchase", both).otherwise(F.slice(both, 1, 1)).alias("paths"), F.col("ts").alias("event_time"))
    return fs_event_rows(rows).select("event_id", "seq", "path", "kind")


