"""Column helpers on paths, tenants and names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved names.
EPHEMERAL_MARKER = ".kb-last-push"
DENIED_SEGMENTS = (".git", ".disk-archive", ".dreamer")
INTERNAL_SEGMENT = ".version-blobs"
SIDECAR_ROOT = ".disk-embeddings"
LEGACY_SHARD = "_legacy"


@dataclass(frozen=True)
class FilterRules:
    """Extensions that may pass (empty: all), further denied segments, and globs to ignore."""

    extensions: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(_segments(path), -1)


def is_ephemeral_marker(path: Column) -> Column:
    return F.lower(basename(path)) == EPHEMERAL_MARKER


def is_internal_path(path: Column) -> Column:
    return F.array_contains(_segments(path), INTERNAL_SEGMENT)


def is_co_storage(path: Column) -> Column:
    return F.lower(F.element_at(_segments(path), 1)) == SIDECAR_ROOT


def manifest_path(path: Column) -> Column:
    return F.concat(F.lit(f"{SIDECAR_ROOT}/"), path, F.lit(".manifest.json"))


def vector_path(path: Column) -> Column:
    return F.concat(F.lit(f"{SIDECAR_ROOT}/"), path, F.lit(".vec.bin"))


def extension(path: Column) -> Column:
    """Lower-cased extension, null without one; a leading dot alone starts none."""
    found = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", F.lower(found))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over whole paths; ``*`` and ``?`` may cross slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/" and (not i or glob[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 2
        elif c == "*":
            while glob[i : i + 2] == "**":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(p)[6:-2] for p in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += c if c.isalnum() or c in "/_- " else "\\" + c
        i += 1
    return rf"(?s)\A{out}\z"


def is_excluded(path: Column, rules: FilterRules) -> Column:
    """In order: marker, denied segment (any case), extension not listed (co-storage is exempt), ignored glob."""
    denied = [s.lower() for s in (*DENIED_SEGMENTS, *rules.deny)]
    out = is_ephemeral_marker(path) | F.exists(_segments(path), lambda s: F.lower(s).isin(denied))
    if rules.extensions:
        allowed = F.coalesce(extension(path).isin([e.lower().lstrip(".") for e in rules.extensions]), F.lit(False))
        out = out | (~is_co_storage(path) & ~allowed)
    for glob in rules.ignore:
        out = out | path.rlike(glob_regex(glob))
    return out


def path_violation(path: Column, max_len: int = 4096) -> Column:
    """The first lexical fault: nul_byte, parent_segment, absolute, too_long; null for a fair path."""
    return (
        F.when(F.contains(path, F.lit("\0")), "nul_byte")
        .when(F.array_contains(_segments(path), ".."), "parent_segment")
        .when(F.startswith(path, F.lit("/")), "absolute")
        .when(F.octet_length(path) > max_len, "too_long")
    )


def normalize_rel(path: Column) -> Column:
    """Trimmed, with forward slashes and none at the ends; null where empty or holding ``..``."""
    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when((p != "") & ~F.contains(p, F.lit("..")), p)


def ancestors(path: Column) -> Column:
    """The path and every directory above it."""
    parts = _segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def resolve_tenant(header: Column, body: Column) -> Column:
    """A header wins and an empty one clears; without it a body that is not empty counts."""
    return F.when(header.isNotNull(), F.nullif(header, F.lit(""))).otherwise(F.nullif(body, F.lit("")))


def bind_tenant(request: Column, bound: Column) -> Column:
    """struct(tenant_id, verdict) of a request on a node: missing inherits, equal is ok, different is a mismatch."""
    mismatch = bound.isNotNull() & request.isNotNull() & (request != bound)
    tenant = F.when(~mismatch, F.coalesce(request, bound))
    return F.struct(tenant.alias("tenant_id"), F.when(mismatch, "mismatch").otherwise("ok").alias("verdict"))


def shard_key(tenant: Column) -> Column:
    """Partition value of a tenant; null where the name is not fit for one."""
    return F.when(tenant.isNull() | (tenant == ""), LEGACY_SHARD).when(tenant.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), tenant)


def fork_filename(path: Column, node_id: Column, ts: Column) -> Column:
    """``stem.sync-conflict-id8-yyyyMMdd-HHmmss.ext`` beside the file; ``ts`` is in seconds, shown in UTC."""
    name = basename(path)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    ext = F.when(ext == ".", "").otherwise(ext)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    id8 = F.rpad(F.substring(F.regexp_replace(node_id, "[^0-9a-f]", ""), 1, 8), 8, "0")
    days, rest = F.floor(ts / 86400), F.pmod(ts, F.lit(86400))
    stamp = F.concat_ws(
        "",
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyyMMdd"),
        F.lit("-"),
        *[F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, rest % 3600 / 60, rest % 60)],
    )
    return F.concat(folder, stem, F.lit(".sync-conflict-"), id8, F.lit("-"), stamp, ext)


#: Limits of a text merge.
MERGE_MAX_BYTES, BINARY_PROBE = 10 * 1024 * 1024, 1024


def merge_guard(base: Column, local: Column, remote: Column, max_bytes: int = MERGE_MAX_BYTES) -> Column:
    """Why three binary columns cannot be merged as text: no_base, too_large, binary, not_text; else ok."""
    three = (base, local, remote)

    def any_of(test) -> Column:
        return test(three[0]) | test(three[1]) | test(three[2])

    nul = F.lit(bytearray(b"\0"))
    return (
        F.when(base.isNull(), "no_base")
        .when(any_of(lambda c: F.octet_length(c) > max_bytes), "too_large")
        .when(any_of(lambda c: F.contains(F.substring(c, 1, BINARY_PROBE), nul)), "binary")
        .when(any_of(lambda c: ~F.is_valid_utf8(c)), "not_text")
        .otherwise("ok")
    )
