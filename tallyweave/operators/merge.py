"""Three-way text merges of conflicting files."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, merge_guard
from .keys import join_on

#: Extensions that are merged; all others fork.
MERGED = ("md", "txt")
#: Characters of merged texts that a task holds before it hands them on.
MERGE_HELD = 4_000_000


def merge_bases(conflicts: DataFrame, baselines: DataFrame, blobs: DataFrame) -> DataFrame:
    """``conflicts`` (tenant_id, node_id, vault_id, path, ...) with ``base``: the content of the live baseline, or null."""
    keys = ["tenant_id", "node_id", "vault_id", "path"]
    known = baselines.where("not deleted").select(*keys, F.col("content_hash").alias("__hash"))
    rows = join_on(conflicts, known, keys)
    # Rows without a baseline have no hash to be dealt by: joined, they would all be one task's.
    met = rows.where("__hash is not null").join(blobs.select(F.col("content_hash").alias("__hash"), F.col("data").alias("base")), "__hash", "left").drop("__hash")
    lone = rows.where("__hash is null").drop("__hash")
    return met.unionByName(lone.withColumn("base", F.lit(None).cast(met.schema["base"].dataType)))


def diff3(base: str, local: str, remote: str) -> tuple[str, bool]:
    """(text, clean): edits of both sides put together by lines; where they touch, both are kept between marks."""
    b, sides = base.splitlines(True), (local.splitlines(True), remote.splitlines(True))
    edits = []
    for who, lines in enumerate(sides):
        for op, i, j, k, m in difflib.SequenceMatcher(None, b, lines, autojunk=False).get_opcodes():
            if op != "equal":
                edits.append((i, j, who, k, m))
    edits.sort()
    out, at, clean, n = [], 0, True, 0
    while n < len(edits):
        start, end, group = edits[n][0], edits[n][1], [edits[n]]
        n += 1
        while n < len(edits) and (edits[n][0] < end or edits[n][0] == start):
            end = max(end, edits[n][1])
            group.append(edits[n])
            n += 1
        out += b[at:start]
        texts = []
        for who, lines in enumerate(sides):
            own = [e for e in group if e[2] == who]
            pos, part = start, []
            for i, j, _, k, m in own:
                part += b[pos:i] + lines[k:m]
                pos = j
            texts.append(part + b[pos:end] if own else None)
        mine, theirs = texts
        if mine is None or theirs is None or mine == theirs:
            out += mine if mine is not None else theirs
        else:
            clean = False
            whole = lambda part: "".join(part) + ("" if not part or part[-1].endswith("\n") else "\n")
            out.append("<<<<<<< local\n" + whole(mine) + "=======\n" + whole(theirs) + ">>>>>>> remote\n")
        at = end
    return "".join(out + b[at:]), clean


def three_way_merge(conflicts: DataFrame) -> DataFrame:
    """``conflicts`` (path, base, local, remote: binary, and keys) with outcome (merged, conflicted, fork), reason and merged.

    Guards run on the JVM; only rows that pass them reach the line merge, which takes row by row from Spark's batch and hands merged
    texts on by MERGE_HELD. Edits of different places merge; edits that touch are conflicted, and the text then holds both sides.
    """
    listed = F.coalesce(extension(F.col("path")).isin(*MERGED), F.lit(False))
    rows = conflicts.withColumn("reason", F.when(~listed, "extension").otherwise(merge_guard(F.col("base"), F.col("local"), F.col("remote"))))
    names = conflicts.columns
    forked = rows.where("reason <> 'ok'").select(*names, F.lit("fork").alias("outcome"), "reason", F.lit(None).cast("string").alias("merged"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, out = 0, 0, []
            for i, three in enumerate(zip(*(batch.column(c) for c in ("base", "local", "remote")), strict=True)):
                out.append(diff3(*(x.as_py().decode() for x in three)))
                held += len(out[-1][0])
                if held >= MERGE_HELD or i + 1 == batch.num_rows:
                    added = [["merged" if ok else "conflicted" for _, ok in out], ["ok"] * len(out), [text for text, _ in out]]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(out)).columns, *map(pa.array, added)], [*names, "outcome", "reason", "merged"])
                    start, held, out = i + 1, 0, []

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in conflicts.schema)
    merged = rows.where("reason = 'ok'").select(*names).mapInArrow(merge, f"{columns}, outcome string, reason string, merged string")
    return forked.unionByName(merged)
