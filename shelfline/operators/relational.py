"""Filters, whitelisted sorts, pages and set operations shared by the list views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: dict[str, object] | None = None, search: tuple[str, str] | None = None, one_of: dict[str, list] | None = None) -> DataFrame:
    """Conjunction of optional filters; `search` is (column, text), matched anywhere and without case, wildcards kept."""
    terms = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    terms += [F.col(c).isin(v) for c, v in (one_of or {}).items() if v]
    if search and search[1]:
        terms.append(F.col(search[0]).ilike(f"%{search[1]}%"))
    return df.filter(reduce(lambda a, b: a & b, terms)) if terms else df


def page(df: DataFrame, allowed: dict[str, str], default: str, key: str, sort: str | None = None, order: str = "desc", number: int = 1, size: int = 50) -> DataFrame:
    """One page of `df` by a whitelisted column; unknown columns fall back, ties go by the key."""
    column = F.col(allowed.get(sort or "", default))
    by = column.desc() if order == "desc" else column.asc()
    return df.orderBy(by, F.col(key)).offset((max(1, number) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size).cast("int")).alias("pages"))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def recent(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), F.desc(key)).limit(n)


def reconciled(desired: DataFrame, running: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) of what to start, stop or restart so that running becomes desired."""
    d, r = desired.select(key, F.col(value).alias("d")), running.select(key, F.col(value).alias("r"))
    change = F.when(F.col("r").isNull(), "added").when(F.col("d").isNull(), "removed").when(F.col("d") != F.col("r"), "changed")
    return d.join(r, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def tags_union(df: DataFrame, key: str, tags: str, order: str) -> DataFrame:
    """Tags of a key in order of first appearance, each once."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, tags))), lambda x: x[tags])
    return df.groupBy(key).agg(F.array_join(F.array_distinct(F.flatten(ordered)), ",").alias("tags"))
