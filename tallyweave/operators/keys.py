"""Null-safe joins, last-wins, upserts and pages: what every table operator is made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def key_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the null-safe condition that ties it to ``left``."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return renamed, reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join with null-safe keys. Left keys stay; in a full or right join they are filled from the right."""
    renamed, match = key_match(left, right, keys)
    out = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full_outer", "right"):
        out = out.withColumns({k: F.coalesce(k, f"__{k}") for k in keys})
    return out.drop(*[f"__{k}" for k in keys])


#: Copies that ``fan_out`` makes of its smaller side.
SLICES = 32


def fan_out(rows: DataFrame, few: DataFrame, keys: Sequence[str], by: str, slices: int = SLICES) -> DataFrame:
    """Inner join with null-safe keys, for few keys and results far larger than both sides; ``rows`` may be a stream.

    A key's ``rows`` are dealt over ``slices`` by the column ``by``, and each slice meets a copy of the key's ``few``. The exchange
    keeps all its partitions, for by the size of what enters them Spark would leave the whole result to a few tasks; for that too
    it is a merge join: a side that Spark took for small would be sent to the tasks of the other, which are few.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of one type on both sides: where a key may be null on one side only, Spark would cast, deal anew and gather the partitions.
    kind = StructType([StructField(k, rows.schema[k].dataType) for k in keys])
    key = F.struct(*keys).cast(kind)
    dealt = rows.withColumns({"__key": key, "__slice": F.pmod(F.xxhash64(by), F.lit(slices)).cast("int")})
    copies = few.select(key.alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__slice"), *[c for c in few.columns if c not in keys])
    return dealt.repartition(parts, "__key", "__slice").hint("merge").join(copies, ["__key", "__slice"]).drop("__key", "__slice")


def in_blocks(rows: DataFrame, keys: Sequence[str], by: str, size: int, name: str) -> DataFrame:
    """``rows`` with a number from 0: each key's rows dealt by the column ``by`` over blocks of about ``size``. Null-safe keys."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("__blocks"))
    return join_on(rows, counts, keys).withColumn(name, F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int")).drop("__blocks")


#: Entries of an inner list that ``lay_out`` repeats for the whole outer one; rows that a task of it makes, about; most tasks.
STRIP, TASK_ROWS, MOST_TASKS = 256, 1 << 20, 1 << 14


def deal(rows: DataFrame, keys: Sequence[str], tasks: float) -> DataFrame:
    """``rows`` dealt by ``keys`` to ``tasks`` tasks, or as many as the session's shuffles have, and not gathered by their size.

    They are dealt by a hash of their own: one by the keys Spark leaves out where rows lie so already, and then it gathers them.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ceil(tasks), MOST_TASKS)), F.xxhash64(*keys))


def one_by_one(values: str | Column) -> Column:
    """``explode`` with a row held at a time: the transform keeps it out of generated code, which first makes all rows that come of one."""
    return F.explode(F.transform(values, lambda x: x))


def lay_out(tiles: DataFrame, keys: Sequence[str], outer: str, inner: str, rows: float) -> DataFrame:
    """``outer``, ``inner``: each entry of the list ``outer`` with each strip (a list) of the list ``inner``, for results far larger than both.

    ``tiles`` are dealt by ``keys``, to tasks that make about TASK_ROWS of the ``rows`` each once the strips are inlined. A strip meets the
    whole outer list before the next begins, so values come in runs and soon again, and a task's different values are few: a
    columnar file keeps them once, and the rows as runs and as short numbers that repeat.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(inner), F.lit(1)), F.lit(STRIP))
    strips = deal(tiles, keys, rows / TASK_ROWS).select(outer, F.explode(F.transform(starts, lambda i: F.slice(inner, i, STRIP))).alias(inner))
    return strips.select(one_by_one(outer).alias(outer), inner)


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the last in ``order``. It is an aggregate, so equal keys meet on the map side first."""
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in others]).select(*rows.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], preserve: Sequence[str] = (), order: Sequence[str] | None = None) -> DataFrame:
    """``target`` with rows of ``source`` put in: matching keys are replaced (but for ``preserve``), others added.

    ``source`` may repeat keys if ``order`` says which comes last. One full outer join; write the result to a new place.
    """
    fresh = latest_wins(source, keys, order) if order else source
    others = [c for c in target.columns if c not in keys]
    left = target.select(*keys, F.struct(*others).alias("__old"))
    right = fresh.select(*keys, F.struct(*others).alias("__new"))
    both = join_on(left, right, keys, "full_outer")
    old_first = lambda c: F.when(F.col("__old").isNotNull(), F.col("__old")[c]).otherwise(F.col("__new")[c])
    new_first = lambda c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c])
    return both.select(*keys, *[(old_first if c in preserve else new_first)(c).alias(c) for c in others]).select(*target.columns)


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` whose keys it lacks."""
    fresh = latest_wins(source, keys, order) if order else source.dropDuplicates(list(keys))
    return target.unionByName(join_on(fresh, target, keys, "left_anti").select(*target.columns))


def paginate(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0, max_limit: int = 200, max_offset: int = 10_000) -> DataFrame:
    """Each partition's page with ``position`` (from 1), ``total`` and ``has_more``; the limit is held to 1..max_limit.

    Rows beyond the page are left out before the partition is gathered and sorted; totals are an aggregate of their own.
    """
    limit, offset = min(max(limit, 1), max_limit), min(max(offset, 0), max_offset)
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("position") <= offset + limit)
    page = ranked.where(F.col("position") > offset).withColumn("position", F.col("position").cast("long"))
    return join_on(page, rows.groupBy(*partition).agg(F.count("*").alias("total")), partition).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def in_segments(rows: DataFrame, order: str, segments: int, name: str = "__segment") -> DataFrame:
    """``rows`` with a segment number that rises with ``order`` (nulls first): about equal shares of all rows.

    The driver gets ``segments`` - 1 cuts. Rows of one ``order`` are in one segment. The numbers hang on the cuts as literals, so a
    task done again gives the same.
    """
    shares = F.array(*[F.lit(i / segments) for i in range(1, segments)])
    cuts = sorted(set(rows.agg(F.percentile_approx(order, shares).alias("cuts")).first()["cuts"] or [])) if segments > 1 else []
    number = reduce(lambda n, cut: n + F.coalesce((F.col(order) > F.lit(cut)).cast("int"), F.lit(0)), cuts, F.lit(0))
    return rows.withColumn(name, number)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, how: str, name: str, segments: int = 1) -> DataFrame:
    """``rows`` with ``name``: the ``how`` (max or sum) of ``value`` over the rows before each of its key in ``order``; null for the first.

    With more than one of ``segments``, a key's rows are cut by the first column of ``order`` and each segment is a task's: the
    segments' totals meet on the map side, are carried on (a row a key and segment) and join the rows again, so one key
    with most of all rows is many tasks' work. Both give the same.
    """
    best = {"max": F.max, "sum": F.sum}[how]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if segments <= 1:
        return rows.withColumn(name, best(value).over(before(Window.partitionBy(*keys).orderBy(*order))))
    cut = in_segments(rows.withColumn("__value", value), order[0], segments)
    totals = cut.groupBy(*keys, "__segment").agg(best("__value").alias("__total"))
    carried = totals.select(*keys, "__segment", best("__total").over(before(Window.partitionBy(*keys).orderBy("__segment"))).alias("__carried"))
    inside = best("__value").over(before(Window.partitionBy(*keys, "__segment").orderBy(*order)))
    met = join_on(cut, carried, [*keys, "__segment"]).withColumn("__inside", inside)
    both = F.greatest("__inside", "__carried") if how == "max" else F.when(F.col("__inside").isNull() | F.col("__carried").isNull(), F.coalesce("__inside", "__carried")).otherwise(F.col("__inside") + F.col("__carried"))
    return met.withColumn(name, both).select(*rows.columns, name)
