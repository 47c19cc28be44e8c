"""Modification of registered tables: each call makes a new DataFrame under the same name (copy on write)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.hashing import with_hash
from rangeloom.operators.routing import ladder, with_shard
from rangeloom.operators.store import numbered
from rangeloom.plans.model import HASH_SPACE, KeyRange, MetadataError


def _distributed(engine, name: str) -> bool:
    return any(name in d.relations for d in engine.meta.distributions.values())


def _routed(engine, name: str, rows: DataFrame) -> None:
    """Refuses rows whose key is null or has no key range.

    Hashes are made of the distinct keys, apart from what made these, and counted: a filter on the shard would be pushed through
    the steps of the hash and grow with each.
    """
    if not _distributed(engine, name):
        return
    keys = rows.select(*sorted(key_names(engine, name)))
    if any(c.method != "identity" for c in engine.meta.of(name)[1].key):
        keys = keys.distinct()
    if with_shard(keys, engine.meta, name).agg(F.count_if(F.col("__shard").isNull())).first()[0]:
        raise MetadataError(f"a key of {name} is null or has no key range")


def _unique(engine, name: str, changed: set[str], rows: DataFrame, others: DataFrame) -> None:
    """Refuses new or changed rows that repeat each other, or other rows, in a unique index's columns; the others are only joined."""
    for index in engine.meta.indexes.values():
        if index.relation == name and changed & set(index.columns):
            if not violations(rows, index.columns).isEmpty() or not others.join(rows.select(*index.columns), index.columns, "left_semi").isEmpty():
                raise MetadataError(f'unique index "{index.id}" is violated')


def insert(engine, name: str, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Appends rows by name; missing columns are null, or a sequence's next values where the table has one.

    A distributed table's rows are routed first, so a key without a range stops the insert; a unique index's columns
    must stay unique. Returns the rows as they were inserted.
    """
    target = engine.tables[name]
    rows = rows.toDF(*columns) if columns else rows
    if extra := set(rows.columns) - set(target.columns):
        raise MetadataError(f"table {name} has no columns {sorted(extra)}")
    sequences = engine.meta.references[name].sequences if name in engine.meta.references else {}
    for column in target.columns:
        if column not in rows.columns:
            if column in sequences:
                rows, n = numbered(rows, column, engine.meta.sequences[sequences[column]] + 1)
                if n:
                    engine.meta.next_range(sequences[column], n)
            else:
                rows = rows.withColumn(column, F.lit(None).cast(target.schema[column].dataType))
    rows = rows.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    _routed(engine, name, rows)
    _unique(engine, name, set(target.columns), rows, target)
    engine.register(name, target.unionByName(rows))
    return rows


def key_names(engine, name: str) -> set[str]:
    """The columns that a table's distribution key is made of."""
    return {c for d in engine.meta.distributions.values() if name in d.relations for k in d.relations[name].key for c in ([p for p, _ in k.parts] or [k.name])}


def update(engine, name: str, changes: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """Sets columns where the condition holds. Keys may change: rows are routed by their new key afterwards, and a key without a
    range, or a repeated value of a unique index, stops the update. Returns the rows as they are now."""
    df = engine.tables[name]
    if unknown := set(changes) - set(df.columns):
        raise MetadataError(f"table {name} has no columns {sorted(unknown)}")
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    new = df.where(hit).select(*(changes[c].cast(df.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in df.columns))
    if key_names(engine, name) & set(changes):
        _routed(engine, name, new)
    _unique(engine, name, set(changes), new, df.where(~hit))
    out = df.select(*(F.when(hit, changes[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))
    engine.register(name, out)
    return new


def delete(engine, name: str, condition: Column | None = None) -> DataFrame:
    """Removes the rows for which the condition is true; null counts as false."""
    df = engine.tables[name]
    return engine.register(name, df.limit(0) if condition is None else df.where(~F.coalesce(condition, F.lit(False))))


def affected(engine, name: str, condition: Column | None = None) -> DataFrame:
    """The rows that an update or delete with this condition returns."""
    df = engine.tables[name]
    return df if condition is None else df.where(condition)


def upsert(engine, name: str, rows: DataFrame, keys: list[str], changes: dict[str, Column] | None = None, nothing: bool = False) -> DataFrame:
    """Inserts rows; a row whose key is there sets ``changes`` (columns of "old" and "new"), by default all columns.

    ``nothing``: what is there stays, and of new rows that share a key one is inserted. Otherwise a repeated new key is refused, as
    the order of two changes of one row would decide. Keys need a range and unique indexes hold, as in ``insert``.
    """
    df = engine.tables[name]
    rows = rows.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns))
    if nothing:
        rows = rows.where(functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).union(rows.dropna(subset=keys).dropDuplicates(keys))
    elif not violations(rows, keys).isEmpty():
        raise MetadataError("an upsert can't change a row twice")
    old, new = df.alias("old"), rows.alias("new")
    match = functools.reduce(lambda a, b: a & b, (F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys))
    both = old.withColumn("__old", F.lit(True)).alias("old").join(new.withColumn("__new", F.lit(True)).alias("new"), match, "full_outer")
    there, given = F.col("old.__old").isNotNull(), F.col("new.__new").isNotNull()
    changes = {} if nothing else changes

    def column(c: str) -> Column:
        changed = (changes or {}).get(c, F.col(f"new.{c}") if changes is None else F.col(f"old.{c}"))
        return F.when(there & given, changed).when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).cast(df.schema[c].dataType).alias(c)

    out = both.select(*(column(c) for c in df.columns), given.alias("__given"))
    mine = out.where("__given").drop("__given")
    _routed(engine, name, mine if key_names(engine, name) & set(changes or ()) else rows)
    _unique(engine, name, set(df.columns), mine, out.where("not __given").drop("__given"))
    return engine.register(name, out.drop("__given"))


def truncate(engine, name: str) -> DataFrame:
    return engine.register(name, engine.tables[name].limit(0))


def drop(engine, name: str) -> None:
    engine.tables.pop(name)
    engine.layouts.pop(name, None)
    engine.spark.catalog.dropTempView(name)


def violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the columns that stand in more than one row; rows with a null among them don't count."""
    clean = df
    for c in columns:
        clean = clean.where(F.col(c).isNotNull())
    return clean.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def index_table(engine, index_id: str) -> DataFrame:
    """The index's columns with the table's key columns and the shard of the index entry: Murmur of its first column."""
    index = engine.meta.indexes[index_id]
    _, relation = engine.meta.of(index.relation)
    keys = [k.name for k in relation.key if not k.parts] + [p for k in relation.key for p, _ in k.parts]
    df = engine.tables[index.relation].select(*dict.fromkeys([*index.columns, *keys]))
    first, kind = index.columns[0], index.kinds[0]
    df = with_hash(df, first, "integer" if kind in ("integer", "uinteger") else kind, "murmur", "__hash")
    shards = list(engine.meta.shards)
    step = HASH_SPACE // len(shards)
    parts = [KeyRange(s, "", s, (i * step,)) for i, s in enumerate(shards)]
    return df.withColumn("__shard", ladder(["__hash"], parts, "shard")).drop("__hash")
