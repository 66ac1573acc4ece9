"""Expression helpers shared by every operator. All of them stay in the JVM."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str) -> str:
    """Pattern with Unicode classes and with ``\\n`` as the only line end."""
    return "(?dU)" + pattern


def escape(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def alternation(terms: Iterable[str]) -> str:
    """Non-capturing alternation of literal terms; among terms that start alike, the given
    order decides.

    A flat alternation tries every term at every place of the text. Terms with different
    first characters exclude each other, so long lists are grouped by ranges of first
    characters, each behind one range test, and long groups again.
    """
    terms = list(terms)

    def flat(ts: list[str]) -> str:
        return "(?:" + "|".join(escape(t) for t in ts) + ")"

    firsts = sorted({t[0] for t in terms})
    if len(firsts) <= 6:
        return flat(terms)
    width, groups = -(-len(firsts) // 3), []
    for i in range(0, len(firsts), width):
        part = firsts[i:i + width]
        span = "-".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in (part[0], part[-1]))
        groups.append(f"(?=[{span}])" + alternation([t for t in terms if t[0] in part]))
    return "(?:" + "|".join(groups) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result many times in ``body``.

    Lambda bodies are evaluated per element, so an expression written out inside one
    would be computed again for each element; a bound variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unpack(df: DataFrame, keep: Sequence, array: Column, on: str, place: str | None = None,
           names: Sequence[str] = ()) -> DataFrame:
    """One row per struct (or, with ``names``, per element) of a computed array.

    A plain explode makes the optimizer test the size of the array below it, which
    computes the array again; the outer form does not, and its empty rows are dropped by
    a field that is never null.
    """
    if names:
        made = (F.posexplode_outer(array).alias(place, *names) if place
                else F.explode_outer(array).alias(*names))
    else:
        made = F.inline_outer(array)
    return df.select(*keep, made).filter(F.col(on).isNotNull())


def nz(c: Column | str) -> Column:
    """Null text as empty text."""
    return F.coalesce(col(c), F.lit(""))


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(numbers: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, numbers, F.lit(0))


def literal(value: str | bool) -> str:
    """A value as SQL text."""
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Sequence[str]) -> Column:
    """Literal string array (typed also when empty).

    Rule tables become one parsed expression and not one call to the JVM per entry.
    """
    if not values:
        return F.array().cast("array<string>")
    return F.expr("array(" + ", ".join(literal(v) for v in values) + ")")


def structs(names: Sequence[str], rows: Sequence[Sequence[str | Sequence[str]]]) -> Column:
    """Literal array of structs; a list value becomes a string array."""
    def value(v) -> str:
        return literal(v) if isinstance(v, str) else "array(" + ", ".join(literal(x) for x in v) + ")"

    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {value(v)}" for n, v in zip(names, r)) + ")"
        for r in rows) + ")")


def mapping(pairs: Iterable[tuple[str, str | Sequence[str]]]) -> Column:
    """Literal map from strings to strings or string arrays."""
    def value(v) -> str:
        return literal(v) if isinstance(v, str) else "array(" + ", ".join(literal(x) for x in v) + ")"

    return F.expr("map(" + ", ".join(f"{literal(k)}, {value(v)}" for k, v in pairs) + ")")


def strip(c: Column) -> Column:
    """Trim every kind of white space (the built-in ``trim`` only takes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def rank_of(level: Column, levels: Sequence[str]) -> Column:
    """Position of a level in its order, 0 for an unknown one."""
    return F.greatest(F.array_position(strings(levels), level).cast("int") - 1, F.lit(0))


def let_sql(value: str, name: str, body: str) -> str:
    """:func:`let` in SQL text."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def apply_sql(value: Column, name: str, body: str) -> Column:
    """Bind a value to a name in an SQL expression. Kernels with many nested lambdas are
    written this way, as text that the JVM parses once; built call by call they would
    cost the driver seconds."""
    bound = F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}"))
    return F.element_at(bound, 1)


def part(array: Column, start: Column, n: Column) -> Column:
    """``n`` elements from place ``start`` (from 0). The built-in ``slice`` copies the whole array first,
    so many parts of a long array would cost its square."""
    return F.when(n > 0, F.transform(F.sequence(start, start + n - 1), lambda i: F.get(array, i))).otherwise(
        F.slice(array, 1, 0))


def part_sql(array: str, start: str, n: int | str, name: str = "j_") -> str:
    """:func:`part` in SQL text, up to the end of the array."""
    return (f"transform(filter(sequence({start}, {start} + {n} - 1), {name} -> {name} < size({array})), "
            f"{name} -> get({array}, {name}))")


def prefix_sums_sql(n: str, item: str) -> str:
    """Exclusive running totals of ``n`` ints, of which ``item`` is number ``j_`` (from 0).

    Appending to an array copies it, so a plain fold is quadratic in the number of
    elements. Folding inside blocks and then over block totals keeps long texts cheap; blocks
    grow with the cube root of the number, which makes both copy the same.
    """
    block = f"greatest(8, cast(cbrt({n}) as int))"
    local = (f"transform(sequence(0, cast(ceil({n} / {block}) as int) - 1), k_ -> "
             f"aggregate(sequence(k_ * {block}, cast(least((k_ + 1) * {block}, {n}) as int) - 1), array(0), "
             f"(acc, j_) -> concat(acc, array(element_at(acc, -1) + {item}))))")
    base = ("aggregate(l_, array(0), "
            "(acc, x) -> concat(acc, array(element_at(acc, -1) + element_at(x, -1))))")
    totals = ("flatten(transform(l_, (p_, i_) -> "
              "transform(slice(p_, 1, size(p_) - 1), x -> x + get(s_, i_))))")
    return f"if({n} = 0, cast(array() as array<int>), {let_sql(local, 'l_', let_sql(base, 's_', totals))})"


def prefix_sums(values: Column) -> Column:
    return apply_sql(values, "v_", prefix_sums_sql("size(v_)", "get(v_, j_)"))
