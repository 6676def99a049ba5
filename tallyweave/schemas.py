"""Fixed schemas and key columns; time units are part of the column names where they are not seconds."""

from __future__ import annotations

#: A share is (tenant, vault); tenants may be null and are compared null-safely.
SCOPE = ["tenant_id", "vault_id"]
KEY = [*SCOPE, "path"]

MANIFEST = ("tenant_id string, vault_id string, node_id string, path string, content_hash string, size long, mtime_ns long, inode long, "
    "vector_clock map<string,long>, deleted boolean, deleted_at long, encryption_nonce binary, version_id long, parent_version_id long")
BLOCK = "file_key string, block_no int, offset long, weak long, strong string, data binary"
VERSION = "tenant_id string, vault_id string, path string, version_id long, parent_version_id long, content_hash string, size long, mtime_ns long, created_at long, created_by string"
FS_EVENT = "event_id long, vault_id string, path string, kind string, event_time timestamp"
AUDIT_EVENT = {"ts_ms": "long", "kind": "string", "cert_fp": "string", "share": "string", "payload_json": "string"}
ARCHIVE_INDEX = "version int, entries array<struct<path:string,size:long,digest:string>>"
SIDECAR = "schema_version int, source_path string, content_hash string, model_id string, dimensions int, vector_bytes long, embedded_at long"

#: The hash of a tombstone for a path never indexed before.
ZERO_HASH = "0" * 64
