"""Array helpers with the order and duplicate rules that page metadata needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_prefix(tags: Column, *prefixes: str) -> Column:
    return F.filter(tags, lambda t: F.greatest(*[t.startswith(p) for p in prefixes]) if len(prefixes) > 1 else t.startswith(prefixes[0]))


def any_with_prefix(tags: Column, prefix: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t.startswith(prefix)), F.lit(False))


def appended(items: Column, item: Column) -> Column:
    """``item`` at the end unless it is there."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def in_first_order(items: Column) -> Column:
    return F.array_distinct(items)


def sorted_union(collected: Column) -> Column:
    """Sorted distinct elements of an array of arrays."""
    return F.array_sort(F.array_distinct(F.flatten(collected)))


def union_without(items: Column, more: Column, gone: Column) -> Column:
    return F.array_remove(F.array_distinct(F.concat(items, more)), gone)


def retagged(tags: Column, old: Column, new: Column) -> Column:
    """``old`` becomes ``new`` in place; ``new`` stands once, where either came first, or at the end.

    Other repeated tags are kept.
    """
    moved = F.transform(tags, lambda t: F.when(t == old, new).otherwise(t))
    once = F.filter(F.transform(moved, lambda t, i: F.when((t == new) & (i > F.array_position(moved, new) - 1), F.lit(None)).otherwise(t)), lambda t: t.isNotNull())
    return F.when(F.array_contains(moved, new), once).otherwise(F.array_append(moved, new))


def text_list(value: Column) -> Column:
    """An array from JSON text that holds an array or a scalar; blank gives an empty one."""
    many = F.from_json(value, "array<string>")
    trimmed = F.trim(value)
    return F.when(value.isNull() | (trimmed == "") | (trimmed == "null"), F.array().cast("array<string>")).when(trimmed.startswith("["), many).otherwise(F.array(F.regexp_replace(trimmed, '^"|"$', "")))


def numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def last_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))
