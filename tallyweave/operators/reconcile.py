"""Three-way reconciliation of snapshots, and rename detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import vc_compare
from ..schemas import KEY, SCOPE
from .keys import join_on

#: What a snapshot row brings to a decision.
STATE = ["content_hash", "size", "mtime_ns", "inode", "vector_clock", "deleted"]


def union_paths(local: DataFrame, remote: DataFrame, indexed: DataFrame) -> DataFrame:
    """Distinct keys of three snapshots."""
    return local.select(*KEY).unionByName(remote.select(*KEY)).unionByName(indexed.select(*KEY)).distinct()


def _state(side: str) -> Column:
    return F.when(F.col(side).isNull(), "N").when(F.col(side)["deleted"], "T").otherwise("P")


def _same(a: str, b: str) -> Column:
    """Equal content; a missing row equals nothing."""
    return F.coalesce(F.col(a)["content_hash"] == F.col(b)["content_hash"], F.lit(False))


def decide(states: Column, lr: Column, li: Column, ri: Column, order: Column) -> Column:
    """struct(action, kind) from the three states (P, T or N each), content equalities and clock order; kind is null without conflict."""

    def is_(*names: str) -> Column:
        return states.isin(*names)

    do = lambda action, kind=None: F.struct(F.lit(action).alias("action"), F.lit(kind).cast("string").alias("kind"))
    choose = lambda test, yes, no: F.when(test, yes).otherwise(no)
    fork, gone = do("conflict_fork", "concurrent"), "modified_deleted"
    both_changed = F.when(lr, do("skip")).when(order == "before", do("download")).when(order == "after", do("upload")).otherwise(fork)
    return (
        F.when(is_("PPP"), F.when(li & ri, do("skip")).when(ri, do("upload")).when(li, do("download")).otherwise(both_changed))
        .when(is_("PNN"), do("upload"))
        .when(is_("NPN", "NPT"), do("download"))
        .when(is_("PPN"), choose(lr, do("skip"), fork))
        .when(is_("TPP"), choose(ri, do("delete_remote"), do("download", gone)))
        .when(is_("PTP"), choose(li, do("delete_local"), do("upload", gone)))
        .when(is_("PNT"), choose(li, do("skip"), do("upload")))
        .when(is_("PPT"), choose(lr, do("skip"), do("download", gone)))
        .when(is_("PTN", "PTT"), do("upload", gone))
        .when(is_("TPN"), do("download", gone))
        .when(is_("TPT"), do("download"))
        .when(is_("NTP", "NTN", "NTT"), do("delete_local"))
        .when(is_("TNN", "TNP"), do("delete_remote"))
        .when(is_("PNP"), choose(li, do("delete_local"), do("upload", gone)))
        .when(is_("NPP"), choose(ri, do("delete_remote"), do("download", gone)))
        .otherwise(do("skip"))  # TTP, TTN, TTT, TNT, NNP, NNT
    )


def sides(local: DataFrame, remote: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row for each key with the structs local, remote and indexed (null where missing), in one shuffle.

    The snapshots are tagged, united and grouped by key, in place of two full outer joins. A key must be unique in each.
    """
    columns = [c for c in local.columns if c not in KEY]
    tagged = None
    for tag, df in (("local", local), ("remote", remote), ("indexed", indexed)):
        part = df.select(*KEY, F.lit(tag).alias("__side"), F.struct(*columns).alias("__row"))
        tagged = part if tagged is None else tagged.unionByName(part)
    pick = lambda side: F.first(F.when(F.col("__side") == side, F.col("__row")), ignorenulls=True).alias(side)
    return tagged.groupBy(*KEY).agg(pick("local"), pick("remote"), pick("indexed"))


def _decided(local: DataFrame, remote: DataFrame, indexed: DataFrame) -> DataFrame:
    """The sides of every key with what is decided about them (__d)."""
    known = sides(local, remote, indexed).withColumns(
        {
            "__st": F.concat(_state("local"), _state("remote"), _state("indexed")), "__lr": _same("local", "remote"), "__li": _same("local", "indexed"), "__ri": _same("remote", "indexed"),
            "__order": vc_compare(F.col("local")["vector_clock"], F.col("remote")["vector_clock"]),
        }
    )
    return known.withColumn("__d", decide(*map(F.col, ("__st", "__lr", "__li", "__ri", "__order"))))


def _actions(decided: DataFrame, path: Column, action: Column, rename_to: Column) -> DataFrame:
    h = lambda side: F.col(side)["content_hash"].alias(f"{side.replace('indexed', 'base')}_hash")
    return decided.select(
        *SCOPE,
        path.alias("path"),
        action.alias("action"),
        rename_to.cast("string").alias("rename_to"),
        F.col("remote").alias("server_version"),
        F.when(F.col("__d.kind").isNotNull(), F.struct(F.col("__d.kind").alias("kind"), h("local"), h("remote"), h("indexed"))).alias("conflict"),
    )


def reconcile(local: DataFrame, remote: DataFrame, indexed: DataFrame, fold: bool = False) -> DataFrame:
    """Action of every path of three snapshots: KEY, action, rename_to, server_version, conflict.

    ``server_version`` is the remote row if there is one; ``conflict`` has its kind and the three hashes. An empty snapshot
    is fine; a null tenant is a tenant. With ``fold`` the rows are those of fold_renames, found in the same pass: rows that
    may pair meet in a window over their (inode, hash), all others are dealt by path, and nothing is joined back.
    """
    decided = _decided(local, remote, indexed)
    action, path = F.col("__d.action"), F.col("path")
    if not fold:
        return _actions(decided, path, action, F.lit(None))
    file = F.when(action == "upload", F.col("local")).when(action == "delete_remote", F.col("indexed"))
    able = file["inode"].isNotNull()
    keyed = decided.withColumns({"__inode": F.when(able, file["inode"]), "__file": F.when(able, file["content_hash"]).otherwise(path)})
    w = Window.partitionBy(*SCOPE, "__inode", "__file")
    last = lambda name: F.max(F.when((action == name) & F.col("__inode").isNotNull(), path)).over(w)
    paired = keyed.withColumns({"__new": last("upload"), "__old": last("delete_remote")})
    both = F.col("__new").isNotNull() & F.col("__old").isNotNull()
    renamed, freed = both & (action == "upload") & (path == F.col("__new")), both & (action == "delete_remote") & (path == F.col("__old"))
    return _actions(
        paired, F.when(renamed, F.col("__old")).otherwise(path), F.when(renamed, "rename_remote").when(freed, "skip").otherwise(action), F.when(renamed, path)
    )


def detect_renames(prior: DataFrame, current: DataFrame) -> DataFrame:
    """SCOPE, from_path, to_path, inode, content_hash: equal (inode, hash), the old path gone, the new one new.

    Of several prior rows with one (inode, hash) the largest path counts, also if that one is not gone. Null inodes match
    nothing.
    """
    file = [*SCOPE, "inode", "content_hash"]
    last = prior.where("inode is not null").groupBy(*file).agg(F.max("path").alias("path"))
    gone = join_on(last, current.select(*KEY), KEY, "left_anti").withColumnRenamed("path", "from_path")
    new = join_on(current.where("inode is not null").select(*KEY, "inode", "content_hash"), prior.select(*KEY), KEY, "left_anti").withColumnRenamed("path", "to_path")
    return join_on(new, gone, file, "inner").select(*SCOPE, "from_path", "to_path", "inode", "content_hash")


def fold_renames(actions: DataFrame, local: DataFrame, indexed: DataFrame) -> DataFrame:
    """Actions in which an upload and a remote deletion of one (inode, hash) become a remote rename.

    The upload's row turns to rename_remote with the old path and ``rename_to`` the new one; the deletion's turns to skip
    and keeps its path. Of several paths with one key the largest counts, on either side. For actions that are not at
    hand yet, ``reconcile(..., fold=True)`` gives the same rows without joins.
    """
    file = [*SCOPE, "inode", "content_hash"]
    rows = lambda action, snapshot: join_on(actions.where(F.col("action") == action).select(*KEY), snapshot.where("inode is not null").select(*KEY, "inode", "content_hash"), KEY, "inner")
    last = lambda df, name: df.groupBy(*file).agg(F.max("path").alias(name))
    pairs = join_on(last(rows("upload", local), "new"), last(rows("delete_remote", indexed), "old"), file, "inner").select(*SCOPE, "old", "new")
    # Both ends of every pair as marks on their paths: one join back onto the actions.
    marks = pairs.select(*SCOPE, F.col("new").alias("path"), F.col("old").alias("__old"), F.lit(False).alias("__was")).unionByName(
        pairs.select(*SCOPE, F.col("old").alias("path"), F.lit(None).cast("string").alias("__old"), F.lit(True).alias("__was"))
    )
    marked = join_on(actions, marks, KEY, "left")
    renamed = F.col("__old").isNotNull() & (F.col("action") == "upload")
    freed = F.coalesce("__was", F.lit(False)) & (F.col("action") == "delete_remote")
    return marked.select(
        *SCOPE,
        F.when(renamed, F.col("__old")).otherwise(F.col("path")).alias("path"),
        F.when(renamed, "rename_remote").when(freed, "skip").otherwise(F.col("action")).alias("action"),
        F.when(renamed, F.col("path")).otherwise(F.col("rename_to")).alias("rename_to"),
        *[c for c in actions.columns if c not in (*KEY, "action", "rename_to")],
    ).select(*actions.columns)


def merged_clock(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vector_clock: the pointwise maximum of a group's clocks; groups without ticks have an empty one."""
    ticks = rows.select(*keys, F.explode_outer("vector_clock").alias("node", "tick"))
    top = ticks.groupBy(*keys, "node").agg(F.max("tick").alias("tick"))
    entries = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "tick"))))
    return top.groupBy(*keys).agg(F.map_from_entries(entries).alias("vector_clock"))


def causality_matrix(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per scope, how many paths of both sides are equal, before, after and concurrent."""
    both = join_on(local.select(*KEY, F.col("vector_clock").alias("a")), remote.select(*KEY, F.col("vector_clock").alias("b")), KEY, "inner")
    kinds = ["equal", "before", "after", "concurrent"]
    seen = both.withColumn("causality", vc_compare(F.col("a"), F.col("b")))
    return seen.groupBy(*SCOPE).agg(*[F.count_if(F.col("causality") == k).alias(k) for k in kinds])
