"""Embedding sidecars: writing manifests, finding stale ones, reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FilterRules, extension, is_co_storage, is_excluded, manifest_path, normalize_rel, vector_path

#: What gets embedded.
EMBEDDED = ("md", "markdown", "txt")
SHARE = ["vault_id"]


def sidecar_write(vectors: DataFrame, sources: DataFrame, model_id: str, dimensions: int, as_of: int) -> DataFrame:
    """``vectors`` (vault_id, source_path, vector: array<float>) with status, the sidecar's paths and its manifest (JSON).

    status: invalid_path, co_storage_source, size_mismatch, source_missing, ok. ``sources`` (vault_id, path, content_hash) are
    hashed as they are embedded.
    """
    norm = vectors.withColumn("path", normalize_rel(F.col("source_path")))
    rows = norm.join(sources.select("vault_id", "path", F.col("content_hash").alias("__hash")), ["vault_id", "path"], "left")
    size = F.size("vector").cast("long") * 4
    status = (
        F.when(F.col("path").isNull(), "invalid_path")
        .when(is_co_storage(F.col("path")), "co_storage_source")
        .when(F.coalesce(size, F.lit(-1)) != dimensions * 4, "size_mismatch")
        .when(F.col("__hash").isNull(), "source_missing")
        .otherwise("ok")
    )
    manifest = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), F.col("path").alias("source_path"), F.col("__hash").alias("content_hash"), F.lit(model_id).alias("model_id"),
            F.lit(dimensions).alias("dimensions"), F.lit(dimensions * 4).cast("long").alias("vector_bytes"), F.lit(as_of).cast("long").alias("embedded_at"),
        )
    )
    ok = F.col("status") == "ok"
    return rows.withColumn("status", status).select(
        "vault_id", "source_path", "status", F.when(ok, manifest_path(F.col("path"))).alias("manifest_path"), F.when(ok, vector_path(F.col("path"))).alias("vector_path"), F.when(ok, manifest).alias("manifest")
    )


def sidecar_staleness(sources: DataFrame, manifests: DataFrame, vectors: DataFrame, model_id: str, dimensions: int, rules: FilterRules = FilterRules()) -> DataFrame:
    """vault_id, path, staleness of each embeddable source (vault_id, path, content_hash).

    The first of missing_manifest, missing_vector, stale_hash, stale_model, stale_dimensions, stale_vector_size; else fresh.
    ``manifests``: vault_id, source_path and the manifest's fields; ``vectors``: vault_id, source_path, bytes.
    """
    p = F.col("path")
    wanted = sources.where(F.coalesce(extension(p).isin(*EMBEDDED), F.lit(False)) & ~is_co_storage(p) & ~is_excluded(p, rules))
    m = manifests.select("vault_id", F.col("source_path").alias("path"), F.struct("content_hash", "model_id", "dimensions", "vector_bytes").alias("m"))
    v = vectors.select("vault_id", F.col("source_path").alias("path"), "bytes")
    rows = wanted.select("vault_id", "path", "content_hash").join(m, ["vault_id", "path"], "left").join(v, ["vault_id", "path"], "left")
    staleness = (
        F.when(F.col("m").isNull(), "missing_manifest")
        .when(F.col("bytes").isNull(), "missing_vector")
        .when(F.col("m.content_hash") != F.col("content_hash"), "stale_hash")
        .when(F.col("m.model_id") != model_id, "stale_model")
        .when(F.col("m.dimensions") != dimensions, "stale_dimensions")
        .when(F.col("m.vector_bytes") != F.col("bytes"), "stale_vector_size")
        .otherwise("fresh")
    )
    return rows.select("vault_id", "path", staleness.alias("staleness"))


def sidecar_report(staleness: DataFrame, files: DataFrame) -> DataFrame:
    """Per vault: fresh, stale, missing, co_storage_files and should_notify; ``not_fresh`` has the paths behind it as rows."""
    s = F.col("staleness")
    counts = staleness.groupBy("vault_id").agg(
        F.count_if(s == "fresh").alias("fresh"), F.count_if(F.startswith(s, F.lit("stale_"))).alias("stale"), F.count_if(F.startswith(s, F.lit("missing_"))).alias("missing"),
    )
    stored = files.where(is_co_storage(F.col("path"))).groupBy("vault_id").agg(F.count("*").alias("co_storage_files"))
    return counts.join(stored, "vault_id", "left").select(
        "vault_id", "fresh", "stale", "missing", F.coalesce("co_storage_files", F.lit(0)).alias("co_storage_files"), ((F.col("stale") > 0) | (F.col("missing") > 0)).alias("should_notify")
    )


def not_fresh(staleness: DataFrame) -> DataFrame:
    """vault_id, path, staleness of every source to embed again."""
    return staleness.where("staleness <> 'fresh'").select("vault_id", "path", "staleness")
