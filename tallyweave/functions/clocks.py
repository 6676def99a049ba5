"""Vector clocks as map<string,long> columns; a missing node counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: where a tick stops.
LONG_MAX = 2**63 - 1


def _diffs(a: Column, b: Column) -> Column:
    empty = F.create_map().cast("map<string,long>")
    zero = F.lit(0).cast("long")
    return F.map_values(F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, zero) - F.coalesce(y, zero)))


def vc_compare(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    d = _diffs(a, b)
    less, more = F.exists(d, lambda x: x < 0), F.exists(d, lambda x: x > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def vc_happens_before(a: Column, b: Column) -> Column:
    return vc_compare(a, b) == "before"


def vc_merge(a: Column, b: Column) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def vc_get(clock: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, node), F.lit(0).cast("long"))


def vc_advance(clock: Column, node: Column) -> Column:
    """One more tick of ``node``, saturating."""
    now = vc_get(clock, node)
    return F.map_concat(F.map_filter(clock, lambda k, v: k != node), F.map_from_arrays(F.array(node), F.array(F.when(now < LONG_MAX, now + 1).otherwise(now))))


def vc_text(clock: Column) -> Column:
    """``node=tick`` pairs in node order, for showing and comparing."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(clock)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
