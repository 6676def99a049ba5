"""Sources and sinks on small trees, and streams against their batch form."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.paths import FilterRules
from tallyweave.operators import blocks, governance, sidecars
from tallyweave.sources import files
from tallyweave.sources import tree as sources_tree
from tallyweave.streaming import events, state, tables


ODD = {
    "a.md": "one", "sub dir/b+c.txt": "two", "sub dir/ü.md": "three", ".git/x.md": "no", "p.png": "no", "empty.md": "", ".env.md": "four", "_drafts/x.md": "five", "_index.md": "six",
    ".obsidian/app.md": "seven", "100%.md": "eight", "a%41.md": "nine", "c%.md": "ten", "[x]{y},*?.md": "eleven", "deep/er/and/deeper/z.md": "twelve",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in ODD.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "link.md").symlink_to(root / "a.md")
    (root / "linked").symlink_to(root / "sub dir")
    (root / "nothing").mkdir()
    return str(root)


def walked(root):
    """What a walk that follows no links sees."""
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            if not os.path.islink(path):
                stat = os.lstat(path)
                found[os.path.relpath(path, root)] = (stat.st_size, stat.st_mtime_ns, stat.st_ino)
    return found


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_list_tree(spark, tree, prefix):
    got = {r["path"]: tuple(r)[1:] for r in sources_tree.list_tree(spark, prefix + tree).collect()}
    assert got == walked(tree) and len(got) == len(ODD)


def test_a_deep_tree_is_dealt_out(monkeypatch, tree):
    monkeypatch.setattr(sources_tree, "FOLDERS", 3)
    monkeypatch.setattr(sources_tree, "ROWS", 2)
    reader = sources_tree.TreeReader(tree)
    parts = reader.partitions()
    got = [p for part in parts for batch in reader.read(part) for p in batch.column(0).to_pylist()]
    assert sorted(got) == sorted(walked(tree)) and len(parts) > 3 and any(part.whole for part in parts)


def test_scan_manifest(spark, tree):
    rules = FilterRules(extensions=("md", "txt"))
    scan = files.scan_manifest(spark, tree, None, "v", "n", rules)
    got = {r["path"]: r for r in scan.collect()}
    assert sorted(got) == sorted(set(ODD) - {".git/x.md", "p.png"})
    assert all(r["content_hash"] == hashlib.sha256(ODD[p].encode()).hexdigest() for p, r in got.items())
    assert got["a.md"]["size"] == 3 and got["a.md"]["deleted"] is False and got["a.md"]["vector_clock"] == {} and got["a.md"]["inode"] == os.stat(f"{tree}/a.md").st_ino
    prior = scan.withColumn("content_hash", F.lit("known")).withColumn("vector_clock", F.create_map(F.lit("n"), F.lit(4).cast("long"))).withColumn("size", F.when(F.col("path") == "a.md", 99).otherwise(F.col("size"))).persist()
    again = {r["path"]: r for r in files.scan_manifest(spark, tree, None, "v", "n", rules, prior).collect()}
    assert again["a.md"]["content_hash"] == got["a.md"]["content_hash"] and again["a.md"]["vector_clock"] == {"n": 4}
    assert {r["content_hash"] for p, r in again.items() if p != "a.md"} == {"known"}
    assert len(again) == len(got)
    prior.unpersist()


def test_only_misses_are_read(spark, tree):
    """A known file's contents are not touched: other bytes under its size and mtime go unseen; a miss is read."""
    prior = spark.createDataFrame(files.scan_manifest(spark, tree, None, "v", "n").collect(), files.scan_manifest(spark, tree, None, "v", "n").schema)
    for name, text in (("a.md", "ONE"), ("sub dir/ü.md", "threeX")):
        stat = os.stat(f"{tree}/{name}")
        with open(f"{tree}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{tree}/{name}", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    got = {r["path"]: r["content_hash"] for r in files.scan_manifest(spark, tree, None, "v", "n", prior=prior).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got["a.md"] == digest("one") and got["sub dir/ü.md"] == digest("threeX")


def test_files_round_trip(spark, tmp_path):
    rows = [("x/.y/z", b"1"), ("_a", b""), ("p%q", b"3" * 3_000_000), ("n", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    root = str(tmp_path / "out")
    assert {tuple(r) for r in sources_tree.write_files(df, root).collect()} == {(p, len(c or b"")) for p, c in rows}
    back = sources_tree.read_files(sources_tree.list_tree(spark, root).select("path"), root)
    assert {r["path"]: bytes(r["content"]) for r in back.collect()} == {p: c or b"" for p, c in rows}
    for bad in ("../x", "/x", "a/../../b"):
        with pytest.raises(Exception, match="leaves the folder"):
            sources_tree.write_files(spark.createDataFrame([(bad, b"")], df.schema), root).collect()


def test_archive_entries(spark, tmp_path):
    index = spark.range(500).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.col("id").alias("size"), F.lit("d").alias("digest"))
    files.archive_write_entries(index.repartition(7), str(tmp_path / "entries"))
    assert same(files.archive_read_entries(spark, str(tmp_path / "entries")), index)


def test_archive_round_trip(spark, tmp_path):
    rows = [("b.md", b"same"), ("a.md", b"same"), ("index.json", b"x"), ("c/.disk-archive/d", b"y"), ("e.md", b"")]
    index, slots = blocks.archive_create(spark.createDataFrame(rows, "path string, content binary"))
    files.archive_write_index(index, str(tmp_path / "index"))
    slots.write.partitionBy("hh").option("compression", "zstd").parquet(str(tmp_path / "slots"))
    read = files.archive_read_index(spark, str(tmp_path / "index"))
    assert sorted(r["path"] for r in read.collect()) == ["a.md", "b.md", "e.md"]
    stored = spark.read.parquet(str(tmp_path / "slots"))
    assert stored.count() == 2
    assert {r["status"] for r in blocks.archive_restore(read, stored).collect()} == {"ok"}


def test_sidecar_read(spark, tmp_path):
    sources = {"_x.md": "one", ".notes/y.md": "two", "notes/a.md": "three", "notes/b.md": "four"}
    field = lambda p: {"schema_version": 1, "source_path": p, "content_hash": hashlib.sha256(sources[p].encode()).hexdigest(), "model_id": "m", "dimensions": 4, "vector_bytes": 16, "embedded_at": 1}
    for p, text in sources.items():
        for name, content in ((p, text.encode()), (f".disk-embeddings/{p}.manifest.json", b"{broken" if p == "notes/b.md" else json.dumps(field(p)).encode()), (f".disk-embeddings/{p}.vec.bin", b"\0" * 16)):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(content)
    root = str(tmp_path)
    found = files.sidecar_read(spark, root)
    assert {r["source_path"]: r["manifest_path"] for r in found.collect()} == {p: f".disk-embeddings/{p}.manifest.json" for p in sources if p != "notes/b.md"}
    assert files.sidecar_read(spark, f"{root}/.disk-embeddings").count() == 3
    scan = files.scan_manifest(spark, root, None, "v", "n")
    vectors = files.sidecar_vectors(spark, root)
    assert {tuple(r) for r in vectors.collect()} == {(p, 16) for p in sources}
    vault = lambda df: df.withColumn("vault_id", F.lit("v"))
    state = sidecars.sidecar_staleness(scan, vault(found), vault(vectors), "m", 4)
    assert {r["path"]: r["staleness"] for r in state.collect()} == {p: "fresh" if p != "notes/b.md" else "missing_manifest" for p in sources}


def test_audit_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "config.reload", None, None, "{}")], "ts_ms long, kind string, cert_fp string, share string, payload_json string")
    files.audit_append(rows, str(tmp_path / "audit"))
    files.audit_append(rows, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    with pytest.raises(Exception, match="unknown audit kind"):
        files.known_audit_rows(rows.withColumn("kind", F.lit("made.up"))).collect()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "audit"))
    files.audit_append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def run(df, tmp_path, name, mode="append"):
    out = str(tmp_path / f"{name}-out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def streamed(spark, rows, schema, tmp_path, name):
    """The rows as a stream of two files, in order."""
    folder = str(tmp_path / name)
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("seq"):
                os.rename(f"{folder}/{f}", f"{folder}/seq{i}.parquet")
                os.utime(f"{folder}/seq{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    schema_ = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(folder), spark.createDataFrame(rows, schema)


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


EVENTS = [(i, None, "v", f"p{i % 3}", "delete" if i % 4 == 0 else "change", i * 400) for i in range(60)]
EVENT_SCHEMA = "event_id long, tenant_id string, vault_id string, path string, kind string, ms long"


def test_debounce_stream(spark, tmp_path):
    timed = lambda df: df.withColumn("event_time", F.timestamp_millis("ms"))
    stream, batch = streamed(spark, EVENTS, EVENT_SCHEMA, tmp_path, "ev")
    want = events.debounce(timed(batch), "1 second")
    assert want.count() > 3
    got = run(events.debounce(timed(stream), "1 second", "1 second"), tmp_path, "deb")
    settled = want.where(F.col("settled_at") < F.timestamp_millis(F.lit(59 * 400 - 1000)))
    assert got.join(settled, ["path", "event_id"]).count() == settled.count() and got.join(want, ["path", "event_id"], "left_anti").count() == 0


def test_audit_counts_stream(spark, tmp_path):
    timed = lambda df: df.withColumn("event_time", F.timestamp_millis("ms"))
    stream, batch = streamed(spark, EVENTS, EVENT_SCHEMA, tmp_path, "ac")
    got = run(events.audit_counts_stream(timed(stream), "2 seconds", "0 seconds"), tmp_path, "counts")
    want = events.audit_counts_stream(timed(batch), "2 seconds")
    assert got.count() > 4 and got.join(want, ["window_start", "kind", "n"], "left_anti").count() == 0


def test_index_stream(spark, tmp_path):
    manifest = "tenant_id string, vault_id string, path string, content_hash string, size long, deleted boolean, deleted_at long"
    before = [(None, "v", "p0", "old", 1, False, None), (None, "v", "p1", "old", 1, False, None), (None, "v", "p9", "old", 1, False, None)]
    listing = spark.createDataFrame([(None, "v", "p1", "new", 2, False, None), (None, "v", "p2", "new", 2, False, None)], manifest)
    rows = [(1, None, "v", "p0", "delete", 0), (2, None, "v", "p1", "change", 0), (3, None, "v", "p2", "change", 0), (4, None, "v", "p1", "delete", 0), (5, None, "v", "p3", "delete", 0), (6, None, "v", "p0", "delete", 0)]
    stream, batch = streamed(spark, rows, EVENT_SCHEMA, tmp_path, "ix")
    spark.createDataFrame(before, manifest).write.parquet(str(tmp_path / "index" / "v=-1"))
    events.apply_index_events(stream, str(tmp_path / "index"), lambda: listing, str(tmp_path / "ixcp"), lambda: 77).awaitTermination()
    got = {r["path"]: (r["content_hash"], r["deleted"]) for r in events.latest_index(spark, str(tmp_path / "index"), 1).collect()}
    assert got == {"p0": ("old", True), "p1": ("new", False), "p2": ("new", False), "p3": ("0" * 64, True), "p9": ("old", False)}
    want = events.applied_events(spark.createDataFrame(before, manifest), batch, listing, 77)
    assert same(events.latest_index(spark, str(tmp_path / "index"), 1), want)
    assert spark.read.parquet(str(tmp_path / "index" / "v=1")).count() < want.count()  # a later batch writes what it changed
    spark.createDataFrame(before, manifest).write.parquet(str(tmp_path / "whole" / "v=-1"))
    events.apply_index_events(stream, str(tmp_path / "whole"), lambda: listing, str(tmp_path / "wholecp"), lambda: 77, compact=1).awaitTermination()
    assert same(events.latest_index(spark, str(tmp_path / "whole"), 1, compact=1), want)


def test_replay_guard_stream(spark, tmp_path):
    rows = [("a" if i % 2 else "b", i, (i * 7) % 11) for i in range(40)]
    stream, batch = streamed(spark, rows, "key string, event_id long, sequence long", tmp_path, "rp")
    with_state(spark)
    got = run(state.replay_guard_stream(stream), tmp_path, "replay")
    assert same(got, governance.replay_check(batch, ["key"], "sequence", ["event_id"]))


def test_auth_limiter_stream(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, i * 4, i % 9 == 0) for i in range(60)]
    stream, batch = streamed(spark, rows, "key string, event_id long, second long, success boolean", tmp_path, "au")
    with_state(spark)
    got = run(state.auth_limiter_stream(stream, 3, 60), tmp_path, "auth")
    assert same(got, governance.auth_rate_limit(batch, 3, 60))


def test_revision_stream(spark, tmp_path):
    rows = [("a" if i % 2 else "b", i, i // 3) for i in range(30)]
    stream, batch = streamed(spark, rows, "path string, event_id long, expected long", tmp_path, "rv")
    with_state(spark)
    got = run(state.revision_stream(stream), tmp_path, "rev")
    want = governance.revision_bump(batch, ["path"], ["event_id"])
    named = want.withColumn("event", F.when(F.col("status") == "applied", "agent.write_ok").otherwise("agent.write_conflict")).drop("status")
    assert same(got, named)


def with_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_webhook_and_fs_streams(spark, tmp_path):
    notices = [{"event_id": 1, "vault_id": "v", "event_type": "rename_both", "paths": ["a", "b"], "event_time": "2024-01-01T00:00:00Z"}, {"event_id": 2, "vault_id": "v", "event_type": "access", "paths": ["a"], "event_time": "2024-01-01T00:00:01Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.json").write_text("\n".join(map(json.dumps, notices)))
    got = run(files.fs_event_source(spark, str(tmp_path / "in")), tmp_path, "fs")
    assert sorted((r["path"], r["kind"]) for r in got.collect()) == [("a", "delete"), ("b", "change")]
    hooks = spark.createDataFrame([(1, None, "v", "u", "s", True, '["sync.file_deleted"]'), (2, None, "v", "u", "", True, '["sync.file_deleted"]'), (3, "t", "v", "u", "s", True, '["sync.file_deleted"]')], "hook_id int, tenant_id string, vault_id string, url string, secret string, enabled boolean, events_json string")
    stream, batch = streamed(spark, [(i, None, "v", "sync.file_deleted", i, f"p{i}") for i in range(4)], "event_id long, tenant_id string, vault_id string, event string, created_at long, payload string", tmp_path, "wh")
    sent = run(events.webhook_stream(stream, hooks), tmp_path, "hooks")
    assert sent.count() == 4 and same(sent, governance.webhook_fanout(batch, hooks))


def test_old_index_versions_go(spark, tmp_path):
    """25 micro-batches with a restart leave one whole version and the changes since."""
    manifest = "tenant_id string, vault_id string, path string, content_hash string, size long, deleted boolean, deleted_at long"
    index, source = str(tmp_path / "index"), str(tmp_path / "in")
    before = spark.createDataFrame([(None, "v", f"p{i}", "old", 1, False, None) for i in range(10)], manifest)
    before.coalesce(1).write.parquet(f"{index}/v=-1")
    listing = spark.createDataFrame([(None, "v", f"p{i}", "new", 2, False, None) for i in range(0, 10, 2)], manifest)
    schema = "event_id long, tenant_id string, vault_id string, path string, kind string"
    everything = []
    for part in (range(13), range(13, 25)):
        for i in part:
            rows = [(i, None, "v", f"p{i % 13}", "delete" if i % 3 else "change")]
            everything += rows
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        events.apply_index_events(stream, index, lambda: listing, str(tmp_path / "cp"), lambda: 77, compact=10).awaitTermination()
    assert events.index_versions(spark, index) == list(range(20, 25))
    want = {f"p{i}": ("old", 1, False, None) for i in range(10)}
    for *_, path, kind in everything:  # one after the other: what is there is live, what is gone is kept as deleted
        if int(path[1:]) < 10 and int(path[1:]) % 2 == 0:
            want[path] = ("new", 2, False, None)
        elif kind == "delete":
            want[path] = (*want.get(path, ("0" * 64, 0))[:2], True, 77)
    got = {r["path"]: (r["content_hash"], r["size"], r["deleted"], r["deleted_at"]) for r in events.latest_index(spark, index, compact=10).collect()}
    assert got == want


def test_state_expires_by_event_time(spark, tmp_path):
    """A run that is over still forgets: an old sequence counts again once the watermark is past the key's time."""
    from datetime import timedelta

    with_state(spark)
    schema, source, out = "key string, event_id long, sequence long, event_time timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    hour = lambda h: f"2024-01-01T{h:02}:00:00Z"
    batches = [[("a", 1, 5, hour(0)), ("b", 2, 5, hour(0))], [("a", 3, 5, hour(1)), ("b", 4, 4, hour(1)), ("c", 5, 1, hour(1))], [("c", 6, 1, hour(4))], [("c", 7, 1, hour(5)), ("a", 8, 3, hour(5)), ("a", 9, 3, hour(5))]]
    for i, rows in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("key", "event_id", "sequence", "event_time"), r, strict=True))) for r in rows))
        stream = state.replay_guard_stream(spark.readStream.schema(schema).json(source), forget=timedelta(hours=2))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["accepted"] for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: False}
    with pytest.raises(ValueError, match="processing time or by event time"):
        state.replay_guard_stream(spark.readStream.schema(schema).json(source), keep=timedelta(hours=1), forget=timedelta(hours=1))


def test_states_in_tables_over_many_batches(spark, tmp_path):
    """Nine micro-batches in three runs, state whole every second one: the same as judging all rows at once."""
    rng = random.Random(12)
    rows = [(rng.choice(["hot"] * 5 + ["b", None, f"k{i // 300}"]), i, rng.choice([None, i // 3, rng.randrange(1 + i)]), "kept") for i in range(1800)]
    schema = "key string, event_id long, sequence long, last string"
    writes, now = [], {}
    for key, i, _, word in rows:
        expected = rng.choice([None, now.get(key, 0), now.get(key, 0), rng.randrange(30)])
        now[key] = now.get(key, 0) + (expected == now.get(key, 0))
        writes.append((key, i, expected, word))
    asked = "path string, event_id long, expected long, __x string"
    guard, revised = str(tmp_path / "guard"), str(tmp_path / "revised")
    for n in range(9):
        for source, part, kind in ((f"{guard}-in", rows, schema), (f"{revised}-in", writes, asked)):
            spark.createDataFrame(part[n * 200 : n * 200 + 200], kind).coalesce(1).write.mode("append").parquet(source)
        if n % 3 == 2:
            stream = lambda source, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
            tables.replay_guard_table(stream(f"{guard}-in", schema), guard, f"{guard}-checkpoint", 3, compact=2).awaitTermination()
            tables.revision_table(stream(f"{revised}-in", asked), revised, f"{revised}-checkpoint", compact=2).awaitTermination()
    want = governance.replay_check(spark.createDataFrame(rows, schema), ["key"], "sequence", ["event_id"]).withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    assert same(tables.judged_rows(spark, guard), want)
    whole = governance.revision_bump(spark.createDataFrame(writes, asked), ["path"], ["event_id"])
    assert same(tables.judged_rows(spark, revised).drop("event"), whole.drop("status"))
    assert {r["path"]: r["revision"] for r in tables.state_after(spark, revised, ["path"], compact=2).collect()} == now
    assert events.index_versions(spark, f"{guard}/state") == [6, 7, 8]
