"""Positional edits of array columns. Indices count from 0; one out of range is an error where the edit needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fail(what: str, a: Column, i: Column | None = None) -> Column:
    where = F.concat(F.lit(f"{what}: index "), i.cast("string"), F.lit(" of "), F.size(a).cast("string")) if i is not None else F.lit(f"{what}: the list is empty")
    return F.raise_error(where)


def array_insert_at(a: Column, i: Column, v: Column) -> Column:
    """a with v before index i; i may be the length."""
    return F.when((i < 0) | (i > F.size(a)), _fail("insert", a, i)).otherwise(F.concat(F.slice(a, F.lit(1), i.cast("int")), F.array(v), F.slice(a, (i + 1).cast("int"), F.greatest((F.size(a) - i).cast("int"), F.lit(0)))))


def array_remove_at(a: Column, i: Column) -> Column:
    """a without its element at index i; what was there is array_index(a, i)."""
    return F.when((i < 0) | (i >= F.size(a)), _fail("remove", a, i)).otherwise(F.concat(F.slice(a, F.lit(1), F.greatest(i, F.lit(0)).cast("int")), F.slice(a, (F.greatest(i, F.lit(0)) + 2).cast("int"), F.greatest((F.size(a) - i - 1).cast("int"), F.lit(0)))))


def array_push_front(a: Column, v: Column) -> Column:
    return F.concat(F.array(v), a)


def array_push_back(a: Column, v: Column) -> Column:
    return F.concat(a, F.array(v))


def array_pop_front(a: Column) -> Column:
    """struct(value, rest)."""
    return F.when(F.size(a) == 0, _fail("pop_front", a)).otherwise(F.struct(F.get(a, F.lit(0)).alias("value"), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))).alias("rest")))


def array_pop_back(a: Column) -> Column:
    """struct(value, rest)."""
    return F.when(F.size(a) == 0, _fail("pop_back", a)).otherwise(F.struct(F.get(a, F.size(a) - 1).alias("value"), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))).alias("rest")))


def array_get(a: Column, i: Column) -> Column:
    """The element at index i, null if out of range."""
    return F.get(a, i.cast("int"))


def array_index(a: Column, i: Column) -> Column:
    """The element at index i, an error if out of range."""
    return F.when((i < 0) | (i >= F.size(a)), _fail("index", a, i)).otherwise(F.get(a, i.cast("int")))


def array_set(a: Column, i: Column, v: Column) -> Column:
    """a with v in place of the element at index i."""
    return F.when((i < 0) | (i >= F.size(a)), _fail("set", a, i)).otherwise(F.transform(a, lambda x, j: F.when(j == i, v).otherwise(x)))


def array_concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def array_split(a: Column, i: Column, left_inclusive: bool = False) -> Column:
    """struct(left, right): the first i elements, one more if left_inclusive, and the others."""
    n = F.least(F.greatest((i + (1 if left_inclusive else 0)).cast("int"), F.lit(0)), F.size(a))
    return F.struct(F.slice(a, F.lit(1), n).alias("left"), F.slice(a, n + 1, F.size(a) - n).alias("right"))
