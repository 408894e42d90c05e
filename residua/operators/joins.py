"""Keyed joins of the pipelines: resume, read-through caches, upserts and file maps. All plain joins that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resume(todo: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return todo if force else todo.join(done.select(key), key, "left_anti")


def read_through(wanted: DataFrame, cached: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of wanted keys from the cache, the others from the source; origin says which."""
    hit = cached.join(wanted.select(key), key, "left_semi").withColumn("origin", F.lit("cache"))
    miss = source.join(wanted.select(key), key, "left_semi").join(cached.select(key), key, "left_anti").withColumn("origin", F.lit("source"))
    return hit.unionByName(miss)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed union in which new rows replace old ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_of(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each combination of keys: the first in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def file_map(rows: DataFrame, key: str, file: str) -> DataFrame:
    """key and the sorted list of its files."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(file)).alias("files"))
