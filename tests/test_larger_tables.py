"""Registered queries and operators on rows that the given tables lack, and on plans that only larger tables show."""

import os

import duckdb

import __spark_entry__ as entry
from tallyweave.operators import governance, keys, merge


def made(spark, sf_dir, tmp_path, **tables):
    """A folder with the given tables, but for ``tables`` (DataFrames)."""
    for f in os.listdir(sf_dir):
        if f.removesuffix(".parquet") not in tables:
            os.symlink(f"{sf_dir}/{f}", tmp_path / f)
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def by_sql(name, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        at = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}'")
    return sorted(c.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def by_spark(spark, name, folder):
    return sorted(map(tuple, entry.queries()[name](spark, folder).collect()), key=repr)


def test_guard_at_its_limit(spark, sf_dir, tmp_path):
    texts = [None, "", "é", *["x" * n for n in (7997, 7998, 7999, 8000, 8001)], "é" * 4000]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(t for t in texts for _ in range(105))]
    folder = made(spark, sf_dir, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert by_spark(spark, "merge_guard", folder) == by_sql("merge_guard", folder)


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().splitlines()


def fires(spark, n):
    rows = [(i, None if i % 2 else "t1", "v0", "sync.file_changed", i * 60, f"p{i}.md") for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, tenant_id string, vault_id string, event string, created_at long, payload string")


def hooks_of(spark, n):
    rows = [(i, None if i % 3 else "t1", "v0", f"https://h{i}", "s", True, '["sync.file_changed"]') for i in range(n)]
    return spark.createDataFrame(rows, "hook_id long, tenant_id string, vault_id string, url string, secret string, enabled boolean, events_json string")


def test_bodies_are_made_once_an_event(spark, monkeypatch):
    monkeypatch.setattr(governance, "PAGE_HOOKS", 7)
    sent = governance.webhook_fanout(fires(spark, 40), hooks_of(spark, 90))
    got = sent.collect()
    want = {(e, h) for e in range(40) for h in range(90) if (e % 2 != 0) == (h % 3 != 0)}
    assert len(got) == len(want) and {(r["event_id"], r["hook_id"]) for r in got} == want
    assert got[0]["body"].startswith('{"id":"evt_') and all(r["url"] == f"https://h{r['hook_id']}" for r in got)
    lines = plan_of(sent)
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("to_json" in line or "structstojson" in line for line in lines[:join])
    assert any("RepartitionByExpression" in line and line.rstrip().endswith(", 8") for line in lines)  # all partitions stay


def test_stream_keeps_matches_not_deliveries(spark, tmp_path):
    from tallyweave.streaming import events

    fires(spark, 40).write.parquet(str(tmp_path / "in"))
    governance.webhook_pages(hooks_of(spark, 90)).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(fires(spark, 1).schema).parquet(str(tmp_path / "in"))
    sink = events.webhook_matches(stream, pages).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    sink.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 40
    key = lambda rows: sorted(map(tuple, rows.collect()))
    assert key(governance.webhook_deliveries(kept, pages)) == key(governance.webhook_fanout(fires(spark, 40), hooks_of(spark, 90)).drop("body"))


def bytes_a_row(rows, folder):
    rows.write.parquet(folder)
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")) / rows.sparkSession.read.parquet(folder).count()


def many(spark, events, hooks):
    fired = spark.range(events).selectExpr("id as event_id", "if(id % 2 = 0, 't1', null) as tenant_id", "'v0' as vault_id", "'sync.file_changed' as event", "id * 60 as created_at", "concat('p', id, '.md') as payload")
    listed = spark.range(hooks).selectExpr("id as hook_id", "if(id % 3 = 0, 't1', null) as tenant_id", "'v0' as vault_id", "concat('https://h', id) as url", "'s' as secret", "true as enabled", """'["sync.file_changed"]' as events_json""")
    return fired, listed


def test_deliveries_repeat_near_each_other(spark, tmp_path):
    """3.6 million of them; laid out an event at a time, hooks alone took 1.4 bytes each."""
    sent = governance.webhook_fanout(*many(spark, 600, 12_000))
    assert sent.rdd.getNumPartitions() == 8 and bytes_a_row(sent, str(tmp_path / "sent")) < 0.6
    kept = spark.read.parquet(str(tmp_path / "sent"))
    assert kept.count() == kept.select("event_id", "hook_id").distinct().count() == 300 * 4000 + 300 * 8000
    assert kept.where("(event_id % 2 = 0) <> (hook_id % 3 = 0) or url <> concat('https://h', hook_id) or get_json_object(body, '$.id') <> concat('evt_', event_id)").count() == 0


def test_read_deliveries_repeat_near_each_other(spark, tmp_path):
    """What a stream has matched, as it is read; laid out an event at a time, hooks alone took over a byte each."""
    from tallyweave.streaming import events

    fired, hooks = many(spark, 600, 12_000)
    pages = governance.webhook_pages(hooks)
    sent = governance.webhook_deliveries(events.webhook_matches(fired, pages), pages)
    assert sent.rdd.getNumPartitions() == 8 and bytes_a_row(sent, str(tmp_path / "sent")) < 0.6
    kept = spark.read.parquet(str(tmp_path / "sent"))
    assert kept.count() == kept.select("event_id", "hook_id").distinct().count() == 300 * 4000 + 300 * 8000
    assert kept.where("(event_id % 2 = 0) <> (hook_id % 3 = 0) or url <> concat('https://h', hook_id)").count() == 0


def test_strips_lose_nothing(spark, monkeypatch):
    """Lists that are no multiple of a strip, a block or a page, and more tasks than the session's."""
    for name, n in (("STRIP", 4), ("TASK_ROWS", 50)):
        monkeypatch.setattr(keys, name, n)
    for name, n in (("PAGE_HOOKS", 7), ("BLOCK_EVENTS", 3)):
        monkeypatch.setattr(governance, name, n)
    sent = governance.webhook_fanout(fires(spark, 41), hooks_of(spark, 90))
    got = [(r["event_id"], r["hook_id"]) for r in sent.collect()]
    assert sorted(got) == [(e, h) for e in range(41) for h in range(90) if (e % 2 != 0) == (h % 3 != 0)]
    assert any("RepartitionByExpression" in line and line.rstrip().endswith(", 37") for line in plan_of(sent))  # 1,830 deliveries, 50 a task
    assert governance.webhook_fanout(fires(spark, 41), hooks_of(spark, 0)).count() == 0


def test_fan_out_keeps_its_partitions(spark):
    """Also where a key may be null on one side only."""
    rows = spark.range(64).selectExpr("id", "substr(concat('k', id), 1, 1) as k")
    few = spark.range(2).selectExpr("if(id = 0, 'k', null) as k", "id as few")
    out = keys.fan_out(rows, few.hint("merge"), ["k"], "id")
    assert out.rdd.getNumPartitions() == 8 and out.count() == 64


def test_tenants_are_written_once(spark):
    users = spark.createDataFrame([(1, "t1", 'a"@x'), (2, None, None), (3, "t9", "c"), (4, "t1", "d")], "user_id long, tenant_id string, email string")
    billing = spark.createDataFrame([("t1", "pro"), (None, None)], "tenant_id string, plan_tier string")
    vaults = spark.createDataFrame([(None, "v1", 5), ("t1", "v2", 6), ("t1", "v1", 7)], "tenant_id string, vault_id string, created_at long")
    nodes = spark.createDataFrame([("t1", "n1", 1, False), ("t1", "n0", 2, True), ("t7", "n9", 3, False)], "tenant_id string, node_id string, registered_at long, revoked boolean")
    out = governance.tenant_export(users, billing, vaults, nodes)
    t1 = '"tenant":{"tenant_id":"t1","plan_tier":"pro","vaults":[{"vault_id":"v1","created_at":7},{"vault_id":"v2","created_at":6}],"devices":[{"node_id":"n1","registered_at":1}]}}'
    assert {r["user_id"]: r["document"] for r in out.collect()} == {
        1: '{"user":{"user_id":1,"email":"a\\"@x"},' + t1,
        2: '{"user":{"user_id":2},"tenant":{"plan_tier":"free","vaults":[{"vault_id":"v1","created_at":5}],"devices":[]}}',
        3: '{"user":{"user_id":3,"email":"c"},"tenant":{"tenant_id":"t9","plan_tier":"free","vaults":[],"devices":[]}}',
        4: '{"user":{"user_id":4,"email":"d"},' + t1,
    }
    lines = plan_of(out)
    assert not any("to_json" in line for line in lines[: next(i for i, line in enumerate(lines) if "Join" in line)])


def test_small_tables_of_users_are_not_sent_to_one_task(spark, sf_dir, tmp_path):
    """180,000 users whose file is small: their documents were one task's work."""
    users = spark.range(180_000).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey", "'Customer' as c_name", "0.0d as c_acctbal", "'BUILDING' as c_mktsegment")
    folder = made(spark, sf_dir, tmp_path, customer=users)
    out = entry.queries()["tenant_export"](spark, folder)
    assert out.rdd.getNumPartitions() == 8
    sizes = out.select("user_id").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 180_000 and max(sizes) < 45_000


def test_merged_texts_are_handed_on_by_size(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merge, "MERGE_HELD", 1000)
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda rows, f, schema, *a, **k: seen.append(f) or rows.selectExpr("*", "'' as outcome", "'' as reason", "'' as merged"))
    rows = [("a.md", b"1\n", ("x" * n + "\n").encode(), b"1\n") for n in (10, 2000, 20, 30, 1500, 5)]
    merge.three_way_merge(spark.createDataFrame(rows, "path string, base binary, local binary, remote binary"))
    out = list(seen[0](iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "base", "local", "remote"])])))
    assert [b.num_rows for b in out] == [2, 3, 1]
    assert [m for b in out for m in b.column("merged").to_pylist()] == [r[2].decode() for r in rows]


def test_rows_without_a_baseline_are_not_one_tasks(spark):
    conflicts = spark.createDataFrame([("t", "n", "v", f"p{i}") for i in range(400)], "tenant_id string, node_id string, vault_id string, path string").repartition(8)
    baselines = spark.createDataFrame([("t", "n", "v", "p7", "h7", False), ("t", "n", "v", "p8", "h8", False)], "tenant_id string, node_id string, vault_id string, path string, content_hash string, deleted boolean")
    blobs = spark.createDataFrame([("h7", b"seven")], "content_hash string, data binary")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false"), strict=True):
        spark.conf.set(n, v)
    try:
        rows = merge.merge_bases(conflicts, baselines, blobs)
        got = {r["path"]: r["base"] for r in rows.collect()}
        sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(got) == 400 and {p: bytes(b) for p, b in got.items() if b is not None} == {"p7": b"seven"}
    assert max(sizes) < 200


def test_restore_plan_statuses_and_deals(spark):
    from tallyweave.operators import versions

    key = "tenant_id string, vault_id string, path string"
    at = lambda n: (None, "v", f"p{n}")
    asked = spark.createDataFrame([(*at(i), i) for i in range(8)], f"{key}, version_id long")
    live = spark.createDataFrame([(*at(1), 1, "aa"), (*at(4), 9, "ab"), (*at(5), 9, "zz"), (*at(6), 9, "AB")], f"{key}, version_id long, content_hash string")
    old = spark.createDataFrame([(*at(3), 3, "cd"), (*at(4), 4, "ab"), (*at(5), 5, "zz"), (*at(6), 6, "ab"), (*at(7), 7, "xyz"), (*at(1), 1, "aa")], f"{key}, version_id long, content_hash string")
    blobs = spark.createDataFrame([("ab",), ("ab",), ("zz",), ("xyz",), ("CD",), (None,)], "content_hash string")
    out = versions.restore_version_plan(asked, live, old, blobs)
    want = ["invalid_id", "already_current", "not_found", "blob_missing", "content_equal", "content_equal", "ok", "ok"]
    assert [r["status"] for r in sorted(out.collect(), key=lambda r: r["version_id"])] == want
    assert any("number" in line and "Join" in line or "__by" in line for line in plan_of(out))


def test_history_shuffles_columns_not_hashes(spark, sf_dir):
    from tallyweave.plans.fixtures import view

    lines = plan_of(view(spark, sf_dir, "history"))
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    assert not any("sha2" in line for line in lines[window:])


def test_steps_are_made_twice_at_most(spark):
    """Once for where segments lead, once for the rows that are carried on; the judging of starts and of writes comes on top."""
    writes = spark.createDataFrame([(f"k{i % 3}", i, i % 4 if i % 7 else None) for i in range(60)], "path string, event_id long, expected long")
    one, four = (governance.revision_bump(writes, ["path"], ["event_id"], None, n) for n in (1, 4))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, four.collect()), key=repr)
    assert sum("MapInArrow" in line for line in plan_of(four)) <= 4
