"""Window functions over keys of any size.

A window partitioned by a key puts the whole key on one task. Here each key is cut
into segments of bounded length along its order, so that no task ever holds more than
one segment:

* bounded frames (previous or next rows) copy the few border rows into the neighbour;
* running values add the totals of earlier segments, taken from a small aggregate.

Both are exact. ``size`` is the number of rows per segment and can be set small in tests.

Where a table has one segment only (``one_segment``, a pass over the order column), a key is as small as a segment, and
a plain window does: the table is read once and exchanged once, also for several windows along the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT_ROWS = 65_536
_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def segment(pos: str, size: int = SEGMENT_ROWS) -> Column:
    return F.floor(F.col(pos) / F.lit(size)).cast("long")


def one_segment(df: DataFrame, seg: Column) -> bool:
    """Whether all rows share a segment. Reads the columns of ``seg`` only."""
    low, high = df.agg(F.min(seg), F.max(seg)).first()
    return low == high


def over_frame(
    df: DataFrame,
    keys: Sequence[str],
    pos: str | Sequence[str],
    exprs: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    size: int = SEGMENT_ROWS,
    whole: bool = False,
) -> DataFrame:
    """Add window columns whose frame reaches ``before`` rows back and ``after`` ahead.

    ``pos`` must number the rows of a key densely; see :func:`dense_position`. With ``whole`` (a key is known to be no larger
    than a segment) it may be any order, of several columns.
    """
    if whole:
        w = Window.partitionBy(*keys).orderBy(*([pos] if isinstance(pos, str) else pos))
        return df.select("*", *[build(w).alias(name) for name, build in exprs.items()])
    if max(before, after) > size:
        raise ValueError("a frame must fit into one segment")
    p, seg = F.col(pos), segment(pos, size)

    def copy(to: Column, own: bool) -> Column:
        return F.struct(to.alias("_seg"), F.lit(own).alias("_own"))

    copies = [copy(seg, True)]
    if before:
        copies.append(F.when(F.pmod(p, F.lit(size)) >= size - before, copy(seg + 1, False)))
    if after:
        copies.append(F.when(
            (F.pmod(p, F.lit(size)) < after) & (seg > 0), copy(seg - 1, False)))
    spread = (
        df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
        .select(*df.columns, "_copy._seg", "_copy._own")
    )
    w = Window.partitionBy(*keys, "_seg").orderBy(pos)
    out = spread.select("*", *[build(w).alias(name) for name, build in exprs.items()])
    return out.filter("_own").drop("_seg", "_own")


def _carry(totals: DataFrame, keys: Sequence[str], exprs: dict[str, str]) -> DataFrame:
    """Value of all earlier segments, for every segment that has one.

    A row here is a whole segment. Where values are so sparse that a segment holds few rows, a key
    of n rows has n segments at most, of two numbers each.
    """
    earlier = (
        Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_seg")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys, "_seg",
        *[_COMBINE[how](name).over(earlier).alias(f"_carry_{name}") for name, how in exprs.items()],
        F.lag(F.lit(1)).over(earlier_order(keys)).alias("_has_carry"),
    ).filter("_has_carry is not null").drop("_has_carry")


def earlier_order(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_seg")


def _plus(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: dict[str, tuple[str, Column]],
    seg: Column,
    whole: bool | None = None,
) -> DataFrame:
    """Add running sums, maxima or minima (inclusive) along ``order``.

    ``seg`` is a number that never falls along the order; rows that share it form one
    segment. With no keys the order runs over the whole table. ``whole`` says whether there is one segment only; it is
    found out if it is not given.
    """
    if one_segment(df, seg) if whole is None else whole:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[_COMBINE[how](c).over(w).alias(n) for n, (how, c) in exprs.items()])
    based = df.withColumn("_seg", seg)
    local = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    totals = based.groupBy(*keys, "_seg").agg(
        *[_COMBINE[how](c).alias(n) for n, (how, c) in exprs.items()])
    carry = _carry(totals, keys, {n: how for n, (how, _) in exprs.items()})
    inside = based.select(
        "*", *[_COMBINE[how](c).over(local).alias(n) for n, (how, c) in exprs.items()])
    # Keys may be null; the carry must still find its segment.
    joined = inside.alias("l").join(
        carry.alias("r"),
        _all([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_seg"]]),
        "left",
    )
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[_plus(how, F.col(f"l.{n}"), F.col(f"r._carry_{n}")).alias(n)
          for n, (how, _) in exprs.items()],
    )


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seg: Column,
    name: str = "pos",
    whole: bool | None = None,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2 … along ``order``; keys may be of any size."""
    numbered = running(df, keys, order, {name: ("sum", F.lit(1))}, seg, whole)
    return numbered.withColumn(name, F.col(name) - 1)


def hash_segment(hex_column: str) -> Column:
    """Segment for an order by a hexadecimal digest: its first four digits."""
    return F.conv(F.substring(hex_column, 1, 4), 16, 10).cast("long")
