"""Reading trees, archives, sidecars and event logs; appending audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import SIDECAR_ROOT, FilterRules, is_co_storage, is_excluded
from ..operators.index import fastpath_hash
from ..schemas import ARCHIVE_INDEX, AUDIT_EVENT, SIDECAR
from .tree import hash_files, list_tree, read_files, write_files

__all__ = [
    "archive_read_entries", "archive_read_index", "archive_write_entries", "archive_write_index", "audit_append", "audit_append_stream", "fs_event_source", "fs_events",
    "known_audit_rows", "scan_manifest", "sidecar_read", "sidecar_vectors", "write_files",
]

#: The kinds an audit row may have.
AUDIT_KINDS = (
    "acl.role_mismatch", "acl.version_regress", "acl.load_failure", "acl.load_ok", "acl.reload_dedup", "acl.file_missing",
    "publisher.signature_failure", "publisher.replay_detected", "publisher.timestamp_skew", "publisher.upload_ok",
    "enrollment.token_issued", "enrollment.completed", "enrollment.token_expired", "enrollment.pending", "enrollment.ca_mismatch", "enrollment.revoked",
    "share.unknown", "config.reload",
)


def scan_manifest(spark: SparkSession, root: str, tenant_id: str | None, vault_id: str, node_id: str, rules: FilterRules = FilterRules(), prior: DataFrame | None = None) -> DataFrame:
    """Manifest rows of the regular files under ``root`` that the rules let pass, as ``list_tree`` lists them.

    Contents are read only to be hashed, and not at all where a prior row has the same size and mtime: the listing is met with
    ``prior`` first, and then the tasks that hold the misses read those, however many they are. Clocks come from the prior
    row, else they are empty. A file that goes away between listing and hashing fails the scan.
    """
    files = list_tree(spark, root).where(~is_excluded(F.col("path"), rules))
    listed = files.select(
        F.lit(tenant_id).cast("string").alias("tenant_id"), F.lit(vault_id).alias("vault_id"), F.lit(node_id).alias("node_id"), "path",
        "size", "mtime_ns", F.lit(None).cast("string").alias("content_hash"), "inode",
        F.create_map().cast("map<string,long>").alias("vector_clock"), F.lit(False).alias("deleted"),
    )
    if prior is None:
        return hash_files(listed.drop("content_hash"), root).select(*listed.columns)
    hit, miss = fastpath_hash(listed, prior)
    return hit.unionByName(hash_files(miss, root)).select(*listed.columns)


def archive_read_index(spark: SparkSession, path: str) -> DataFrame:
    """path, size, digest of each entry of an archive's index document."""
    return spark.read.schema(ARCHIVE_INDEX).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def archive_write_index(index: DataFrame, path: str) -> None:
    """The index as one document, entries by path, as archives carry it: for as many entries as one row holds.

    ``archive_write_entries`` writes any number, an entry a line.
    """
    entries = index.agg(F.array_sort(F.collect_list(F.struct("path", "size", "digest"))).alias("entries"))
    entries.select(F.lit(1).alias("version"), "entries").coalesce(1).write.mode("overwrite").json(path)


def archive_write_entries(index: DataFrame, path: str) -> None:
    """The index as lines of JSON in path order, in as many files as Spark makes."""
    index.select("path", "size", "digest").orderBy("path").write.mode("overwrite").json(path)


def archive_read_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, size, digest of each line that ``archive_write_entries`` wrote."""
    return spark.read.schema("path string, size long, digest string").json(path)


def sidecar_read(spark: SparkSession, root: str, suffix: str = ".manifest.json") -> DataFrame:
    """manifest_path and the fields of every readable sidecar manifest under ``root``; an unreadable one counts as missing.

    ``root`` is a share (its sidecars lie in a hidden folder) or any folder of sidecars; hidden names count.
    """
    named = list_tree(spark, root).where(F.endswith("path", F.lit(suffix))).select("path")
    parsed = F.from_json(F.col("content").cast("string"), SIDECAR, {"mode": "PERMISSIVE"})
    fields = read_files(named, root).select(F.col("path").alias("manifest_path"), parsed.alias("m")).select("manifest_path", "m.*")
    return fields.where("source_path is not null and content_hash is not null")


def sidecar_vectors(spark: SparkSession, root: str) -> DataFrame:
    """source_path and bytes of every vector file in the sidecar folder of the share ``root``, from the listing alone."""
    suffix, below = ".vec.bin", len(SIDECAR_ROOT) + 2
    found = list_tree(spark, root).where(is_co_storage(F.col("path")) & F.endswith("path", F.lit(suffix)))
    return found.select(F.expr(f"substring(path, {below}, length(path) - {below - 1 + len(suffix)})").alias("source_path"), F.col("size").alias("bytes"))


def known_audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows in their schema; a kind outside the closed set makes the job fail rather than slip in."""
    checked = F.when(F.col("kind").isin(*AUDIT_KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown audit kind "), F.col("kind"))))
    return events.withColumn("kind", checked).select(*[F.col(name).cast(kind).alias(name) for name, kind in AUDIT_EVENT.items()])


def audit_append(events: DataFrame, path: str) -> None:
    known_audit_rows(events).write.mode("append").parquet(path)


def audit_append_stream(events: DataFrame, path: str, checkpoint: str):
    """A stream's audit rows appended to ``path``."""
    return known_audit_rows(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def fs_events(raw: DataFrame) -> DataFrame:
    """event_id, seq, vault_id, path, kind (change, delete), event_time from raw notices (event_type, paths: array), batch or stream.

    create and modify change a path, remove deletes it; rename_from deletes, rename_to changes; rename_both deletes its first
    path and changes its second; anything else is dropped.
    """
    rows = raw.select("event_id", "vault_id", "event_type", "event_time", F.posexplode("paths").alias("seq", "path"))
    t = F.col("event_type")
    kind = (
        F.when(t.isin("create", "modify", "rename_to"), "change")
        .when(t.isin("remove", "rename_from"), "delete")
        .when((t == "rename_both") & (F.col("seq") == 0), "delete")
        .when((t == "rename_both") & (F.col("seq") == 1), "change")
    )
    return rows.withColumn("kind", kind).where("kind is not null").select("event_id", "seq", "vault_id", "path", "kind", "event_time")


def fs_event_source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of change and delete events from JSON notices that arrive in a folder."""
    schema = "event_id long, vault_id string, event_type string, paths array<string>, event_time timestamp"
    return fs_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path))
