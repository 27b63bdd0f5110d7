"""Ordered running values per key that survive a key too large for one task.

Normal keys use a plain window. The rows of keys that are too large, and only theirs, are cut
into ordered slices; each slice is scanned on its own, and one carry row per (key, slice) is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import hot_keys, range_slices

COUNT = object()  # the caller does not know which keys are hot


def _ordering(order: list[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in order]


def _windowed(kind: str, value: Column, ordered) -> Column:
    frame = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kind == "sum":
        return F.sum(value).over(frame)
    if kind == "max":
        return F.max(value).over(frame)
    if kind == "min":
        return F.min(value).over(frame)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    if kind == "prev":
        return F.lag(F.struct(value.alias("v"))).over(ordered)
    raise ValueError(kind)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, tuple[str, Column]],
    descending: bool = False,
    hot=COUNT,
) -> DataFrame:
    """Add running columns over `keys`, ordered by `order` (which must be unique per key).

    Kinds: `sum`, `max`, `min` and `last` (latest non-null) include the current row;
    `prev` is the value of the row before it. `descending` walks the order backwards,
    so `prev` becomes the next row's value. `hot`: the keys too large for one task (None: no key
    is); without it they are counted here.
    """
    if hot is COUNT:
        hot = hot_keys(df, keys)
    if hot is not None:
        named = hot.select(*[F.col(k).alias(f"{k}__hot") for k in keys])
        match = [F.col(k).eqNullSafe(F.col(f"{k}__hot")) for k in keys]
        rest = df.join(named, match, "left_anti")
        split = _sliced(df.join(named, match, "left_semi"), keys, order, columns, descending)
        return running(rest, keys, order, columns, descending, None).unionByName(split)
    ordered = Window.partitionBy(*keys).orderBy(*_ordering(order, descending))
    out = {}
    for name, (kind, value) in columns.items():
        col = _windowed(kind, value, ordered)
        out[name] = col["v"] if kind == "prev" else col
    return df.withColumns(out)


def _slice_total(kind: str, value: Column, order: list[str], descending: bool) -> Column:
    if kind in ("sum", "max", "min"):
        return getattr(F, kind)(value)
    seen = F.lit(True) if kind == "prev" else value.isNotNull()
    pick = F.min_by if descending else F.max_by
    return pick(
        F.struct(value.alias("v")), F.when(seen, F.struct(*[F.col(c) for c in order]))
    )


def _sliced(df, keys, order, columns, descending) -> DataFrame:
    rows = range_slices(df, keys, _ordering(order, descending))
    in_slice = Window.partitionBy(*keys, "slice_no").orderBy(*_ordering(order, descending))
    local = rows.withColumns(
        {f"{n}__local": _windowed(k, v, in_slice) for n, (k, v) in columns.items()}
    )
    totals = rows.groupBy(*keys, "slice_no").agg(
        *[_slice_total(k, v, order, descending).alias(n) for n, (k, v) in columns.items()]
    )
    # One row per (key, slice): a key has at most as many rows here as there are slices.
    before = (
        Window.partitionBy(*keys)
        .orderBy("slice_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *[F.col(c).alias(f"{c}__key") for c in [*keys, "slice_no"]],
        *[
            (
                F.last(n, ignorenulls=True)
                if kind in ("last", "prev")
                else getattr(F, kind)(n)
            )
            .over(before)
            .alias(f"{n}__carry")
            for n, (kind, _) in columns.items()
        ],
    )
    match = [F.col(c).eqNullSafe(F.col(f"{c}__key")) for c in [*keys, "slice_no"]]
    joined = local.join(carry, match, "left")
    out = []
    for name, (kind, _) in columns.items():
        here, earlier = F.col(f"{name}__local"), F.col(f"{name}__carry")
        if kind == "sum":
            value = F.when(here.isNull() & earlier.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
            )
        elif kind == "max":
            value = F.greatest(here, earlier)
        elif kind == "min":
            value = F.least(here, earlier)
        elif kind == "last":
            value = F.coalesce(here, earlier["v"])
        else:
            value = F.when(here.isNotNull(), here["v"]).otherwise(earlier["v"])
        out.append(value.alias(name))
    return joined.select(*df.columns, *out)


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn", hot=COUNT
) -> DataFrame:
    """row_number over `keys` by `order`, as a LONG."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, hot=hot)
