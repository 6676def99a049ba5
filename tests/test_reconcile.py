"""The decision table row by row, renames, clocks, and exchange rules on golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import clocks
from tallyweave.operators import exchange, reconcile
from tallyweave.operators.keys import insert_ignore, join_on, latest_wins, paginate, upsert
from tallyweave.schemas import KEY, SCOPE

SNAP = "tenant_id string, vault_id string, path string, content_hash string, size long, mtime_ns long, inode long, vector_clock map<string,long>, deleted boolean, deleted_at long"

#: local, remote, indexed (hash or None; lower case: a tombstone) -> action, conflict kind.
TABLE = [
    ("A..", "upload", None), (".A.", "download", None), ("AA.", "skip", None), ("AB.", "conflict_fork", "concurrent"), ("AAA", "skip", None), ("BAA", "upload", None), ("ABA", "download", None), ("BBA", "skip", None),
    ("aBB", "delete_remote", None), ("aBA", "download", "modified_deleted"), ("AaA", "delete_local", None), ("BaA", "upload", "modified_deleted"), ("aa.", "skip", None), ("aaA", "skip", None), ("aaa", "skip", None),
    ("A.a", "skip", None), ("B.a", "upload", None), (".Aa", "download", None), ("AAa", "skip", None), ("ABa", "download", "modified_deleted"), ("Aa.", "upload", "modified_deleted"), ("Aaa", "upload", "modified_deleted"),
    ("aA.", "download", "modified_deleted"), ("aAa", "download", None), (".aA", "delete_local", None), (".a.", "delete_local", None), (".aa", "delete_local", None), ("a.a", "skip", None), ("a..", "delete_remote", None), ("a.A", "delete_remote", None),
    ("..A", "skip", None), ("..a", "skip", None), ("A.A", "delete_local", None), ("B.A", "upload", "modified_deleted"), (".AA", "delete_remote", None), (".BA", "download", "modified_deleted"),
]


def row(path, mark, clock=None, inode=None, tenant=None):
    return (tenant, "v", path, mark.upper() * 64, 1, 1, inode, clock or {}, mark.islower(), 5 if mark.islower() else None)


def snapshots(spark, cases):
    return [spark.createDataFrame([row(p, m[i], c[i] if c else None, tenant=t) for p, m, c, t in cases if i < len(m) and m[i] != "."], SNAP) for i in range(3)]


def test_decision_table(spark):
    cases = [(f"{m}.md", m, None, t) for m, _, _ in TABLE for t in (None, "t1")]
    got = {(r["tenant_id"], r["path"]): r for r in reconcile.reconcile(*snapshots(spark, cases)).collect()}
    assert len(got) == 2 * len(TABLE)
    for m, action, kind in TABLE:
        for tenant in (None, "t1"):
            r = got[tenant, f"{m}.md"]
            assert (r["action"], r["conflict"] and r["conflict"]["kind"]) == (action, kind), m
            assert (r["server_version"] is not None) == (m[1] != ".")
            if kind:
                assert r["conflict"]["base_hash"] == (None if m[2] == "." else m[2].upper() * 64)


@pytest.mark.parametrize("a, b, action", [({"x": 1}, {"x": 2}, "download"), ({"x": 2}, {"x": 1}, "upload"), ({"x": 1}, {"y": 1}, "conflict_fork"), ({"x": 1}, {"x": 1}, "conflict_fork")])
def test_clocks_decide_when_both_changed(spark, a, b, action):
    found = reconcile.reconcile(*snapshots(spark, [("p.md", "BCA", (a, b, {}), None)])).collect()
    assert [r["action"] for r in found] == [action]


def test_empty_snapshots(spark):
    none = spark.createDataFrame([], SNAP)
    assert reconcile.reconcile(none, none, none).count() == 0
    assert reconcile.detect_renames(none, none).count() == 0


def test_renames(spark):
    old = spark.createDataFrame([row("old.md", "A", inode=1), row("kept.md", "B", inode=2), row("no_inode.md", "C"), row("z_old.md", "A", inode=1)], SNAP)
    new = spark.createDataFrame([row("new.md", "A", inode=1), row("kept.md", "B", inode=2), row("copy.md", "B", inode=2), row("moved.md", "C")], SNAP)
    assert [(r["from_path"], r["to_path"]) for r in reconcile.detect_renames(old, new).collect()] == [("z_old.md", "new.md")]


def test_fold_renames(spark):
    indexed = spark.createDataFrame([row("old.md", "A", inode=1), row("other.md", "B")], SNAP)
    local = spark.createDataFrame([row("new.md", "A", inode=1), row("fresh.md", "B")], SNAP)
    remote = spark.createDataFrame([row("old.md", "A"), row("other.md", "B")], SNAP)
    out = reconcile.fold_renames(reconcile.reconcile(local, remote, indexed), local, indexed)
    assert sorted((r["path"], r["action"], r["rename_to"]) for r in out.collect()) == sorted(
        [("old.md", "rename_remote", "new.md"), ("old.md", "skip", None), ("fresh.md", "upload", None), ("other.md", "delete_remote", None)], key=lambda r: (r[0], r[1])
    )


def test_one_shuffle(spark, sf_dir):
    from tallyweave.plans.reconcile_queries import three

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = reconcile.reconcile(*three(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_clock_axioms(spark):
    rng = random.Random(4)
    clock = lambda: {n: rng.randint(0, 2) for n in "abc" if rng.random() < 0.8}
    triples = [(i, clock(), clock(), clock()) for i in range(200)]
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    m = "map<string,long>"
    df = spark.createDataFrame(triples, f"i int, a {m}, b {m}, c {m}")
    out = df.select(
        "i", clocks.vc_compare(a, b).alias("ab"), clocks.vc_compare(b, a).alias("ba"), clocks.vc_compare(b, c).alias("bc"), clocks.vc_compare(a, c).alias("ac"), clocks.vc_compare(a, a).alias("aa"),
        clocks.vc_merge(a, b).alias("m"), clocks.vc_merge(b, a).alias("n"), clocks.vc_advance(a, F.lit("z")).alias("z"), clocks.vc_happens_before(a, clocks.vc_advance(a, F.lit("a"))).alias("later"),
    ).collect()
    flip = {"before": "after", "after": "before"}
    for r in out:
        assert r["aa"] == "equal" and r["ba"] == flip.get(r["ab"], r["ab"]) and r["m"] == r["n"] and r["z"]["z"] == 1 and r["later"]
        if r["ab"] == r["bc"] == "before":
            assert r["ac"] == "before"
        x, y = triples[r["i"]][1:3]
        assert r["m"] == {k: max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys()}


def test_clock_saturates(spark):
    df = spark.createDataFrame([({"a": 2**63 - 1},)], "c map<string,long>")
    assert df.select(clocks.vc_advance(F.col("c"), F.lit("a"))["a"]).first()[0] == 2**63 - 1


def test_merged_clock(spark):
    df = spark.createDataFrame([("x", {"a": 1}), ("x", {"a": 3, "b": 1}), ("y", {}), ("y", None)], "k string, vector_clock map<string,long>")
    assert {r["k"]: r["vector_clock"] for r in reconcile.merged_clock(df, ["k"]).collect()} == {"x": {"a": 3, "b": 1}, "y": {}}


def test_exchange_roles_and_rules(spark):
    cases = [("a.md", "A..", None, None), ("b.md", ".A.", None, None), ("c.md", "AB.", None, None), ("d.md", "AaA", None, None), ("x/.kb-last-push", "A..", None, None), ("in/e.md", "A..", None, None)]
    local, remote, indexed = snapshots(spark, cases)
    acts = reconcile.reconcile(local, remote, indexed)
    lists = lambda **k: sorted((r["path"], r["list"], r["resolution"]) for r in exchange.exchange_response(acts, remote, **k).collect())
    assert lists() == [("a.md", "to_download", None), ("b.md", "to_upload", None), ("c.md", "conflicts", "merge"), ("d.md", "to_delete", None), ("in/e.md", "to_download", None)]
    roles = spark.createDataFrame([(None, "v", "receive_only")], "tenant_id string, vault_id string, role string")
    assert lists(roles=roles) == [("a.md", "to_download", None), ("c.md", "to_download", None), ("d.md", "to_delete", None), ("in/e.md", "to_download", None)]
    rules = spark.createDataFrame([(None, "v", "in")], "tenant_id string, vault_id string, prefix string")
    assert lists(includes=rules) == [("c.md", "conflicts", "merge"), ("in/e.md", "to_download", None)]


def test_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("b", 20), ("b", 30)], "k string, y int")
    assert sorted(map(tuple, join_on(left, right, ["k"], "full_outer").collect()), key=repr) == sorted([(None, 1, 10), ("a", 2, None), ("b", None, 20), ("b", None, 30)], key=repr)
    assert sorted(map(tuple, latest_wins(right, ["k"], ["y"]).collect()), key=repr) == [("b", 30), (None, 10)]
    target = right.where("k is null").withColumn("z", F.lit(1))
    put = upsert(target, right.withColumn("z", F.lit(2)).withColumn("y", F.col("y") + 1), ["k"], preserve=["z"], order=["y"])
    assert sorted(map(tuple, put.collect()), key=repr) == [("b", 31, 2), (None, 11, 1)]
    assert insert_ignore(target, right.withColumn("z", F.lit(2)), ["k"], order=["y"]).count() == 2
    many = spark.range(10).withColumn("p", F.col("id") % 2)
    assert "WindowGroupLimit" in paginate(many, ["p"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    page = paginate(spark.range(10).withColumn("p", F.lit(1)), ["p"], [F.desc("id")], 3, 6).collect()
    assert [(r["id"], r["position"], r["total"], r["has_more"]) for r in page] == [(3, 7, 10, True), (2, 8, 10, True), (1, 9, 10, True)]
    assert KEY[:2] == SCOPE


def test_filter_includes_against_all_rules(spark):
    rng = random.Random(3)
    name = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    scopes = [(t, v) for t in ("s", None) for v in ("v", "w", "free")]
    rows = [(*rng.choice(scopes), name() if i % 40 else None, i % 7) for i in range(600)]
    rows += rows[:20]
    rules = [(t, v, name()) for t, v in scopes if v != "free" for _ in range(4)] + [("s", "v", "a"), ("s", "v", "a"), ("s", "v", "a/b"), ("s", "null", None), ("s", "w", ""), ("s", "w", "a//b"), ("s", "w", "b/")]
    rows += [("s", "null", "a", 1), ("s", "null", None, 1)]
    files = spark.createDataFrame(rows, "tenant_id string, vault_id string, path string, payload int")
    got = exchange.filter_includes(files, spark.createDataFrame(rules, "tenant_id string, vault_id string, prefix string"), ["tenant_id", "vault_id"])

    def kept(t, v, path):
        own = [p for a, b, p in rules if (a, b) == (t, v)]
        return not own or (path is not None and any(p and (path == p or path.startswith(p + "/")) for p in own))

    assert got.columns == files.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if kept(*r[:3]))
    none = spark.createDataFrame([], "tenant_id string, vault_id string, prefix string")
    assert exchange.filter_includes(files, none, ["tenant_id", "vault_id"]).count() == len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LogicalRDD" in line and "payload" in line for line in plan.splitlines()) == 1  # rows are read once
