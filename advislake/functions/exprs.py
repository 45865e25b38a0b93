"""Small Column builders shared by the operators."""
import functools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def words(values) -> Column:
    """Array literal of strings; typed even when empty."""
    # one parsed literal is far cheaper to build on the driver than a Column per item
    return F.expr("cast(array(" + ", ".join(_literal(v) for v in values) + ") as array<string>)")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Literal map lookup; null or ``default`` where the key is absent."""
    pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in mapping.items())
    # a null key is an error in map access, so it is replaced by a non-key
    found = F.try_element_at(F.expr(f"map({pairs})"), F.coalesce(key, F.lit("\0")))
    return found if default is None else F.coalesce(found, F.lit(default))


def index_of(labels, value: Column) -> Column:
    """0-based position of ``value`` in ``labels``; -1 when absent or null."""
    return F.coalesce(F.array_position(words(labels), value), F.lit(0)).cast("int") - 1


def label_of(labels, index: Column) -> Column:
    return F.try_element_at(words(labels), (index + 1).cast("int"))


def branches(terms) -> str:
    """An alternation of the terms with their common beginnings written once, longer terms first."""
    by_first: dict = {}
    for term in terms:
        by_first.setdefault(term[:1], []).append(term[1:])
    ends = by_first.pop("", None) is not None
    parts = [re.escape(first) + branches(rest) for first, rest in sorted(by_first.items())]
    inner = "|".join(parts)
    if ends:
        return f"(?:{inner})?" if parts else ""
    return inner if len(parts) == 1 else f"(?:{inner})"


def has(array: Column, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def overlaps(array: Column, values) -> Column:
    other = values if isinstance(values, Column) else words(values)
    return F.coalesce(F.arrays_overlap(array, other), F.lit(False))


def truthy(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def filled(text: Column) -> Column:
    """True when the text is present and not blank."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def within(value: Column, options) -> Column:
    return F.coalesce(F.array_contains(words(options), value), F.lit(False))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def reasons(*items: Column) -> Column:
    """Array of the items that are not null, in order."""
    return F.array_compact(F.array(*items))


def let(value: Column, body) -> Column:
    """``body`` applied to a value computed once.

    A chain of projections would be inlined by filter pushdown, so a value used many
    times would be repeated in the plan many times over; a bound value is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(numbers: Column) -> Column:
    """Sums of a number array up to and with each element, in n log n steps.

    Every round adds the element 1, 2, 4, .. places before. An accumulator that grew by appending would be
    copied whole for every element.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))

    def add(sums, k):
        before = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= before, F.get(sums, i - before)).otherwise(0))

    return F.aggregate(rounds, numbers, add)


def struct_of(**fields) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()])


def attach(df: DataFrame, values: Column) -> DataFrame:
    """Adds the fields of a struct as columns, computed exactly once per row.

    A generator over a one-row array is a barrier: a later filter or field access
    cannot copy the expression, as it would from a projection.
    """
    return df.select("*", F.inline(F.array(values)))


def settle(df: DataFrame, keep, columns: dict) -> DataFrame:
    """``keep`` plus the computed ``columns`` behind a barrier.

    The values come from staged projections (compiled code, each computed once); the
    barrier stops a later filter from being pushed through the stages, which would copy
    the whole expression tree into the predicate.
    """
    return attach(df, struct_of(**columns)).select(*keep, *columns)


def reusable(build):
    """Keeps a built Column for later calls with the same arguments.

    A Column is an unresolved expression, so it serves any DataFrame; building a large
    one costs thousands of driver round trips.
    """
    kept: dict = {}

    @functools.wraps(build)
    def cached(*args):
        from pyspark import SparkContext
        context = SparkContext._active_spark_context
        key = (id(context), getattr(context, "applicationId", None), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return cached
