"""Rows to key ranges and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.hashing import with_expression_hash, with_hash
from rangeloom.plans.model import Distribution, KeyRange, Metadata, Relation

#: Beyond this many ranges a row's range is found by binary search in an array instead of a ladder of conditions.
LADDER = 64


def key_columns(df: DataFrame, d: Distribution, relation: Relation) -> tuple[DataFrame, list[str], list[str]]:
    """Adds the routed form of each key column; (df, names, names that were added)."""
    names, added = [], []
    for i, (column, kind) in enumerate(zip(relation.key, d.kinds, strict=True)):
        if column.method == "identity":
            if kind == "uuid":
                df = df.withColumn(f"__key{i}", F.lower(F.col(column.name)))
                names.append(f"__key{i}")
                added.append(f"__key{i}")
            else:
                names.append(column.name)
            continue
        names.append(f"__key{i}")
        added.append(f"__key{i}")
        df = with_expression_hash(df, list(column.parts), f"__key{i}") if column.parts else with_hash(df, column.name, "integer" if kind == "uinteger" else kind, column.method, f"__key{i}")
    return df, names, added


def reaches(names: list[str], lower: tuple) -> Column:
    """key >= bound, column by column from the left."""
    out = None
    for name, value in reversed(list(zip(names, lower, strict=True))):
        c, v = F.col(name), F.lit(value)
        out = c >= v if out is None else (c > v) | ((c == v) & out)
    return out


def ladder(names: list[str], ranges: list[KeyRange], attribute: str) -> Column:
    """The attribute of the last range that the key reaches; null for null keys and keys below all ranges."""
    if not ranges:
        return F.lit(None).cast("string")
    if len(ranges) > LADDER and len(names) == 1:
        # counts of reached bounds by bisection: log2(n) comparisons a row, on a constant array
        bounds, values = F.array(*(F.lit(r.lower[0]) for r in ranges)), F.array(*(F.lit(getattr(r, attribute)) for r in ranges))
        steps = [1 << i for i in reversed(range(len(ranges).bit_length()))]
        higher = lambda at, s: F.when((at + s <= len(ranges)) & (F.col(names[0]) >= F.get(bounds, at + s - 1)), at + s).otherwise(at)
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), higher)
        return F.when(F.col(names[0]).isNotNull(), F.get(values, at - 1))
    out = F.lit(None).cast("string")
    for r in ranges:
        out = F.when(reaches(names, r.lower), F.lit(getattr(r, attribute))).otherwise(out)
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    return F.when(known, out)


def with_shard(df: DataFrame, meta: Metadata, relation: str, key_range: bool = False, keys: bool = False) -> DataFrame:
    """Adds __shard, and __key_range if asked: null where the key is null or below all ranges. keys: hashed key columns stay, as __key0 on."""
    d, r = meta.of(relation)
    ranges = meta.sorted_ranges(d.id)
    keep = df.columns
    df, names, added = key_columns(df, d, r)
    out = [F.col(f"`{c}`") for c in keep] + [F.col(c) for c in added if keys] + [ladder(names, ranges, "shard").alias("__shard")]
    return df.select(*out, *([ladder(names, ranges, "id").alias("__key_range")] if key_range else []))


def placed(df: DataFrame, meta: Metadata, relation: str) -> DataFrame:
    """with_shard for rows to be written: a key without a range is an error of the job."""
    df = with_shard(df, meta, relation)
    return df.withColumn("__shard", F.coalesce("__shard", F.raise_error(F.lit(f"a key of {relation} is null or has no key range")).cast("string")))


def range_condition(meta: Metadata, relation: str, name: str) -> Column:
    """Rows of one key range, over all key columns; identity keys only."""
    d, rel = meta.of(relation)
    r = meta.range(name)
    names = [c.name for c in rel.key]
    later = [x for x in meta.sorted_ranges(d.id) if x.lower > r.lower]
    return reaches(names, r.lower) & (~reaches(names, later[0].lower) if later else F.lit(True))
