"""Mutations of tables as pure functions of DataFrames: upserts, deletions, deduplication, change detection.

Each shuffles by its key once. Null keys never match; where noted they are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.sources.tables import latest_by


def last_writer(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order`` (nulls first), as insert-or-replace leaves it; null keys are equal to one another. Combined before the shuffle."""
    return latest_by(df, keys, *order).select(*df.columns)


def least_id(df: DataFrame, keys: list[str], key_id: str) -> DataFrame:
    """Of rows with equal keys the one with the least id."""
    best = df.groupBy(*keys).agg(F.min(key_id).alias("__least"))
    same = [df[k].eqNullSafe(best[k]) for k in keys]
    return df.join(best, [*same, df[key_id] == best["__least"]], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``new`` over ``old`` by key: new rows win, but keep the old row's ``kept`` columns; both have the same columns and unique keys."""
    o, n = old.alias("o"), new.alias("n")
    pick = [F.when(F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in kept else F.col(f"n.{c}")).alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*pick)


def delete_by(df: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """The rows whose key isn't in ``gone``; rows with a null key stay."""
    return df.join(gone.select(F.col(gone_key or key).alias(key)).distinct(), key, "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """delete_by() for each of (table, its key column); files that aren't there are no error."""
    return {name: delete_by(df, gone, column, key) for name, (df, column) in tables.items()}


def stale(known: DataFrame, seen: DataFrame, keys: list[str], exists: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of ``known`` that aren't in ``seen``; with ``exists`` only those that it doesn't give back, as a look at the file system does. Null keys were never seen."""
    left = known.join(seen.select(*keys).distinct(), keys, "left_anti")
    return left.join(exists(left).select(*keys).distinct(), keys, "left_anti") if exists else left


def changed(current: DataFrame, known: DataFrame, key: str, *marks: str) -> DataFrame:
    """current with a ``state``: new, changed or unchanged; unchanged only if all marks are equal, nulls too."""
    k = known.select(F.col(key).alias("__key"), *[F.col(m).alias(f"__{m}") for m in marks])
    same: Column = F.lit(True)
    for m in marks:
        same = same & current[m].eqNullSafe(k[f"__{m}"])
    joined = current.join(k, current[key] == k["__key"], "left")
    return joined.withColumn("state", F.when(F.col("__key").isNull(), "new").when(same, "unchanged").otherwise("changed")).select(*current.columns, "state")


def overlay(base: DataFrame, over: DataFrame, key: str, fields: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """base with the values of ``over`` that are neither null, zero nor blank; the ``always`` fields override whenever there is a row."""
    o = over.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    types = dict(base.dtypes)

    def value(f: str) -> Column:
        mine, theirs = F.col(f), F.col(f"__{f}")
        if f in always:
            return F.when(F.col("__key").isNull(), mine).otherwise(theirs)
        blank = F.trim(theirs) == "" if types[f] == "string" else theirs == 0
        return F.when(theirs.isNull() | blank, mine).otherwise(theirs)

    rest = [c for c in base.columns if c not in fields]
    return base.join(o, base[key] == F.col("__key"), "left").select(*rest, *[value(f).alias(f) for f in fields])


def resolve_keys(paths: DataFrame, known: DataFrame, rounds: int = 8) -> DataFrame:
    """(path, file_id, placeholder): the key of each path, a known one's own, and for others one that no path has; these are placeholders until their file is written.

    New keys are hashes of the path; where two paths fall on one key, or on a known one, the greater path is hashed again with the round's number.
    """
    wanted = paths.select("path").where("path is not null").distinct().join(known.select("path", "file_id"), "path", "left")
    done = wanted.where("file_id is not null").withColumn("placeholder", F.lit(False))
    taken, new = known.select("file_id"), wanted.where("file_id is null").select("path")
    for n in range(rounds):
        tried = new.withColumn("file_id", F.xxhash64("path", F.lit(n)) if n else F.xxhash64("path"))
        first = tried.groupBy("file_id").agg(F.min("path").alias("path")).join(taken, "file_id", "left_anti").withColumn("placeholder", F.lit(True)).select("path", "file_id", "placeholder")
        done = done.unionByName(first)
        new = new.join(first, "path", "left_anti")
        if not new.limit(1).count():
            return done
        taken = taken.unionByName(first.select("file_id"))
    raise RuntimeError("no free keys were found")
