"""Statistics of sharded tables that balancing and the console use."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.routing import with_shard


def key_stats(engine, distribution: str) -> DataFrame:
    """relation, key_range_id, n: rows of every relation of a distribution by key range."""
    parts = []
    for name in engine.meta.distribution(distribution).relations:
        df = with_shard(engine.tables[name], engine.meta, name, key_range=True)
        parts.append(df.groupBy(F.col("__key_range").alias("key_range_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "key_range_id", "n"))
    return reduce(DataFrame.unionByName, parts)


def biggest_relation(engine, distribution: str, key_range: str | None = None) -> DataFrame:
    """The relation with most rows, and its share of all; ties go to the greater name."""
    stats = key_stats(engine, distribution)
    if key_range is not None:
        stats = stats.where(F.col("key_range_id") == key_range)
    sums = stats.groupBy("relation").agg(F.sum("n").alias("n"))
    best = sums.agg(F.max(F.struct("n", "relation")).alias("b"), F.sum("n").alias("total"))
    return best.select(F.col("b.relation").alias("relation"), F.col("b.n").alias("n"), (F.col("b.n") / F.col("total")).alias("share"))


#: Bytes of a value of a type of fixed width.
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def sizes(engine, relation: str) -> DataFrame:
    """key_range_id, size (bytes of the values; texts in UTF-8, nested ones as JSON), n."""
    df = with_shard(engine.tables[relation], engine.meta, relation, key_range=True)

    def size(f):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in _WIDTH:
            return F.when(c.isNull(), 0).otherwise(_WIDTH[kind])
        plain = c if kind in ("string", "binary") else F.to_json(F.struct(c)) if kind.startswith(("struct", "array", "map")) else c.cast("string")
        return F.coalesce(F.octet_length(plain), F.lit(0))

    row = reduce(lambda a, b: a + b, (size(f).cast("long") for f in engine.tables[relation].schema.fields))
    return df.groupBy(F.col("__key_range").alias("key_range_id")).agg(F.sum(row).alias("size"), F.count("*").alias("n"))


def shards_diff(spark, old, new) -> DataFrame:
    """shard, change (added, deleted, changed): two states of the shards' metadata, as an outer join."""

    def rows(meta):
        return spark.createDataFrame([(s, json.dumps(o, sort_keys=True)) for s, o in meta.shards.items()], "shard string, options string")

    both = rows(old).withColumnRenamed("options", "a").join(rows(new).withColumnRenamed("options", "b"), "shard", "full_outer").where("not (a <=> b)")
    return both.select("shard", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("changed").alias("change"))


def latest_range(engine, relation: str) -> DataFrame:
    """The table's key columns and key_range_id: the range with the greatest lower bound up to the key."""
    d, r = engine.meta.of(relation)
    columns = [c.name for c in r.key]
    return with_shard(engine.tables[relation].select(*columns), engine.meta, relation, key_range=True).select(*columns, F.col("__key_range").alias("key_range_id"))


def load(engine, relation: str, json_column: str, path: str, time_column: str, since, until) -> DataFrame:
    """key_range_id, load: a number in a JSON column, summed over a time interval [since, until)."""
    df = engine.tables[relation].where((F.col(time_column) >= F.lit(since)) & (F.col(time_column) < F.lit(until)))
    df = with_shard(df, engine.meta, relation, key_range=True)
    return df.groupBy(F.col("__key_range").alias("key_range_id")).agg(F.sum(F.get_json_object(json_column, path).cast("long")).alias("load"))


#: Buckets of a round of the exact quantiles, and of a factor of e in its first one.
_BUCKETS, _PER_E = 1 << 16, 22


def _magnitude(v):
    """A bucket that grows with the number: its sign and logarithm. Zero, the infinities and NaN have their own."""
    size = F.floor((F.least(F.ln(F.abs(v)), F.lit(710.0)) + 746) * _PER_E) + 1
    return F.when(F.isnan(v), 1 << 16).when(v > 0, size).when(v < 0, -size).otherwise(0)


def _held(cells: DataFrame, group: list[str], at: str) -> DataFrame:
    """Cells that hold wanted ranks: counts are summed in the order of ``at`` within a group, ranks then count from the cell's start."""
    before = F.col("upto") - F.col("n")
    cells = cells.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.filter("wanted", lambda w: (w.rank >= before) & (w.rank < F.col("upto")))
    return cells.withColumn("wanted", F.transform(inside, lambda w: w.withField("rank", w.rank - before))).where(F.size("wanted") > 0)


def _exact(df: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    """By selection: each round counts the rows of the cells [lo, hi] that hold a wanted rank in finer buckets, so that no
    task has more than a round's buckets of a group. A double has 2**48 others at most in its first bucket, 2**16 after
    two more rounds; these are counted by value. Groups of nulls alone have null quantiles."""
    g = [f"__g{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, g, strict=True)), F.col(column).cast("double").alias("v"))
    values = rows.where(F.col("v").isNotNull())

    def wanted(i: int, share: float) -> list:
        at = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        return [F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), rank.alias("rank"), weight.alias("weight")) for up, rank, weight in ((False, low, high - at), (True, high, at - low))]

    counted = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = values.groupBy(*g, _magnitude(F.col("v")).alias("at")).agg(*counted)
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy(*g)))
    cells = _held(first.withColumn("wanted", F.array(*(w for i, q in enumerate(shares) for w in wanted(i, q)))), g, "at")

    def inside(cells: DataFrame) -> DataFrame:
        cells = cells.select(*(F.col(k).alias(f"{k}_c") for k in g), F.col("lo").alias("from"), F.col("hi").alias("to"), "wanted")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_c")) for k in g]
        return values.join(cells if g else F.broadcast(cells), reduce(lambda a, b: a & b, [*same, F.col("v").between(F.col("from"), F.col("to"))]))

    cell = [*g, "from", "to"]
    for _ in range(2):
        finer = F.when(F.col("from") == F.col("to"), 0).otherwise(F.floor((F.col("v") - F.col("from")) / F.nullif(F.col("to") - F.col("from"), F.lit(0.0)) * _BUCKETS))
        cells = _held(inside(cells).groupBy(*cell, "wanted", finer.alias("at")).agg(*counted), cell, "at")
    last = _held(inside(cells).groupBy(*cell, "wanted", "v").agg(F.count("*").alias("n")), cell, "v")
    last = last.select(*g, "v", F.explode("wanted").alias("w"))
    low, high = (F.max(F.when(F.col("w.up") == up, F.struct("v", "w.weight"))) for up in (False, True))
    found = last.groupBy(*(F.col(k).alias(f"{k}_c") for k in g), F.col("w.i").alias("i_c")).agg(low.alias("low"), high.alias("high"))
    value = F.when(F.col("low.v") == F.col("high.v"), F.col("low.v")).otherwise(F.col("low.v") * F.col("low.weight") + F.col("high.v") * F.col("high.weight"))
    points = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("quantile")) for i, q in enumerate(shares)))
    groups = rows.groupBy(*g).agg(F.count("*").alias("n")).where("n > 0").select(*g, F.explode(points).alias("p"))
    same = reduce(lambda a, b: a & b, [F.col("p.i") == F.col("i_c"), *(F.col(k).eqNullSafe(F.col(f"{k}_c")) for k in g)])
    return groups.join(found, same, "left").select(*(F.col(k).alias(b) for b, k in zip(by, g, strict=True)), F.col("p.quantile").alias("quantile"), value.alias("value"))


def quantiles(df: DataFrame, column: str, shares: list[float], exact: bool = False, by: list[str] | None = None) -> DataFrame:
    """One row a quantile: quantile, value. Exact ones interpolate; others use a bounded sketch."""
    if exact:
        return _exact(df, column, shares, by or [])
    points = F.array(*(F.lit(s) for s in shares))
    rows = df.groupBy(*(by or [])).agg(F.percentile_approx(column, points, 10_000).alias("v"))
    return rows.select(*(by or []), F.explode(F.arrays_zip(points.alias("quantile"), F.col("v").alias("value"))).alias("x")).select(*(by or []), "x.quantile", "x.value")
