"""The engine's queries over the demo tables, each with the SQL that states its result."""

from __future__ import annotations

import copy
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions import hashing
from rangeloom.operators import dml, movement, stats
from rangeloom.operators.store import shared_dir
from rangeloom.plans.engine import Engine
from rangeloom.plans.model import KeyColumn, Metadata, Relation
from rangeloom.sources import copy as copying
from rangeloom.sources import remote

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
SHARDS = ("sh1", "sh2", "sh3", "sh4")
QUARTER = 1 << 30


@functools.lru_cache(maxsize=8)
def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a folder; their schemas and file lists are read once a session."""
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


@functools.cache
def _metadata() -> Metadata:
    meta = Metadata(SHARDS)
    meta.create_distribution("ds_ord", ["integer"])
    meta.create_distribution("ds_cust", ["integer hash"])
    meta.create_distribution("ds_evt", ["integer", "varchar"])
    meta.create_distribution("ds_expr", ["integer hash"])
    meta.create_distribution("ds_doc", ["varchar hash"])
    bounds = {"ds_ord": [(0,), (500,), (5000,), (10000,)], "ds_evt": [(0, ""), (5, "m"), (50, ""), (100, "click")]}
    for d in ("ds_cust", "ds_expr"):
        bounds[d] = [(i * QUARTER,) for i in range(4)]
    for d, lower in bounds.items():
        for i in reversed(range(4)):
            meta.create_range(f"{d}_{i + 1}", lower[i], SHARDS[i], d)
    meta.create_range("ds_doc_2", (2 * QUARTER,), "sh2", "ds_doc")
    meta.create_range("ds_doc_1", (0,), "sh1", "ds_doc")
    plain = lambda *names: [KeyColumn(n) for n in names]
    meta.attach("ds_ord", Relation("orders", plain("o_orderkey")))
    meta.attach("ds_ord", Relation("lineitem", plain("l_orderkey")))
    meta.attach("ds_cust", Relation("customer", [KeyColumn("c_custkey", "murmur")]))
    meta.attach("ds_cust", Relation("orders_by_cust", [KeyColumn("o_custkey", "murmur")]))
    meta.attach("ds_evt", Relation("events", plain("user_id", "event_type")))
    meta.attach("ds_expr", Relation("lineitem_ps", [KeyColumn("murmur", "murmur", (("l_partkey", "uinteger"), ("l_suppkey", "uinteger")))]))
    meta.attach("ds_doc", Relation("documents", [KeyColumn("source", "murmur")]))
    for name in ("region", "nation", "supplier", "part"):
        meta.create_reference(name)
    return meta


def demo(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the tables: five distributions on four shards and four reference tables."""
    engine = Engine(spark, copy.deepcopy(_metadata()))
    for name, df in frames(spark, sf_dir).items():
        engine.register(name, df)
    engine.register("orders_by_cust", engine.tables["orders"])
    engine.register("lineitem_ps", engine.tables["lineitem"])
    return engine


_QUERIES, _ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    """Registers a function of an engine; its oracle is DuckDB SQL."""

    def put(f):
        _QUERIES[name] = lambda spark, sf_dir: f(demo(spark, sf_dir))
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return put


def same(name: str, sql: str, settings: str = "") -> None:
    """Registers a query whose text is its own oracle: pruning and planning must not change rows."""
    _QUERIES[name] = lambda spark, sf_dir: demo(spark, sf_dir).sql(settings + sql)
    _ORACLES[name] = sql


def _ladder(key: str, bounds, names=SHARDS) -> str:
    steps = "".join(f" WHEN {key} >= {b} THEN '{s}'" for b, s in reversed(list(zip(bounds, names, strict=True))))
    return f"CASE{steps} END"


ORD = (0, 500, 5000, 10000)
HASHED = tuple(i * QUARTER for i in range(4))
_EVT = (
    "CASE WHEN user_id > 100 OR user_id = 100 AND event_type >= 'click' THEN 'sh4' WHEN user_id > 50 OR user_id = 50 AND event_type >= '' THEN 'sh3' "
    "WHEN user_id > 5 OR user_id = 5 AND event_type >= 'm' THEN 'sh2' WHEN user_id >= 0 THEN 'sh1' END"
)


def _hash_sql(source: str, key: str, method: str = "murmur") -> str:
    p = hashing.Program()
    return p.duckdb(source, p.integer(key, method), "h")


def _pair_sql(source: str, a: str, b: str) -> str:
    p = hashing.Program()
    parts = [p.integer(a, "murmur"), p.integer(b, "murmur")]
    return p.duckdb(source, p.combined(parts), "h")


# the flagship: pruned to two key ranges, a co-located join, an aggregate


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by shard and order priority for orders of a key interval."""
    e = demo(spark, sf_dir)
    orders = e.where("orders", "o_orderkey >= 600 AND o_orderkey < 9000", shard=True)
    lines = e.where("lineitem", "l_orderkey >= 600 AND l_orderkey < 9000")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return joined.groupBy(F.col("__shard").alias("shard"), "o_orderpriority").agg(F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))


_QUERIES["flagship"] = flagship
_ORACLES["flagship"] = f"""SELECT {_ladder('o_orderkey', ORD)} AS shard, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey >= 600 AND o_orderkey < 9000 GROUP BY ALL"""


# scans and routing


@query("scan_with_shard", f"SELECT 'shard ' || {_ladder('o_orderkey', ORD)} AS shard, o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(e):
    return e.provenance("orders").select("shard", "o_orderkey", "o_custkey", "o_orderstatus")


@query("route_identity", f"SELECT l_orderkey, l_linenumber, {_ladder('l_orderkey', ORD)} AS shard FROM lineitem")
def _(e):
    return e.table("lineitem", shard=True).select("l_orderkey", "l_linenumber", F.col("__shard").alias("shard"))


@query("route_composite", f"SELECT event_id, user_id, event_type, {_EVT} AS shard FROM events")
def _(e):
    return e.table("events", shard=True).select("event_id", "user_id", "event_type", F.col("__shard").alias("shard"))


@query("route_murmur_int", f"SELECT c_custkey, h, {_ladder('h', HASHED)} AS shard FROM ({_hash_sql('SELECT c_custkey FROM customer', 'c_custkey')})")
def _(e):
    return e.table("customer", shard=True, keys=True).select("c_custkey", F.col("__key0").alias("h"), F.col("__shard").alias("shard"))


@query("route_city_int", f"SELECT c_custkey, h FROM ({_hash_sql('SELECT c_custkey FROM customer', 'c_custkey', 'city')})")
def _(e):
    return hashing.with_hash(e.tables["customer"].select("c_custkey"), "c_custkey", "integer", "city", "h")


def _value_map(values, method: str) -> str:
    return ", ".join(f"('{v}', {hashing.hash_value(v, 'varchar', method)})" for v in values)


_TYPES, _SOURCES = ("click", "error", "purchase", "signup", "view"), tuple(f"src{i}" for i in range(20))


@query("route_murmur_varchar", f"SELECT d.doc_id, m.h, {_ladder('m.h', (0, 2 * QUARTER), ('sh1', 'sh2'))} AS shard FROM documents d JOIN (VALUES {_value_map(_SOURCES, 'murmur')}) m(source, h) USING (source)")
def _(e):
    return e.table("documents", shard=True, keys=True).select("doc_id", F.col("__key0").alias("h"), F.col("__shard").alias("shard"))


@query("route_city_varchar", f"SELECT e.event_type, m.h, count(*) AS n FROM events e JOIN (VALUES {_value_map(_TYPES, 'city')}) m(event_type, h) USING (event_type) GROUP BY ALL")
def _(e):
    kinds = e.tables["events"].groupBy("event_type").agg(F.count("*").alias("n"))
    return hashing.with_hash(kinds, "event_type", "varchar", "city", "h").select("event_type", "h", "n")


@query("route_expression", f"SELECT l_orderkey, l_linenumber, h, {_ladder('h', HASHED)} AS shard FROM ({_pair_sql('SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem', 'l_partkey', 'l_suppkey')})")
def _(e):
    return e.table("lineitem_ps", shard=True, keys=True).select("l_orderkey", "l_linenumber", F.col("__key0").alias("h"), F.col("__shard").alias("shard"))


@query("route_default_shard", "SELECT p_partkey, CASE WHEN p_partkey >= 1000 THEN 'sh3' WHEN p_partkey >= 100 THEN 'sh2' ELSE 'sh1' END AS shard FROM part")
def _(e):
    e.meta.create_distribution("ds_part", ["integer"], "sh1")
    e.meta.create_range("high", (1000,), "sh3", "ds_part")
    e.meta.create_range("low", (100,), "sh2", "ds_part")
    del e.meta.references["part"]
    e.meta.attach("ds_part", Relation("part", [KeyColumn("p_partkey")]))
    return e.table("part", shard=True).select("p_partkey", F.col("__shard").alias("shard"))


@query("route_many_ranges", "SELECT o_orderkey, 'r' || CAST(least(o_orderkey // 100, 149) AS VARCHAR) AS key_range FROM orders")
def _(e):
    e.meta.create_distribution("many", ["integer"])
    for i in reversed(range(150)):
        e.meta.ranges[f"r{i}"] = type(e.meta.range("ds_ord_1"))(f"r{i}", "many", SHARDS[i % 4], (i * 100,))
    e.meta.detach("ds_ord", "orders")
    e.meta.attach("many", Relation("orders", [KeyColumn("o_orderkey")]))
    df = e.table("orders", key_range=True)
    return df.select("o_orderkey", F.col("__key_range").alias("key_range"))


@query("route_key", "SELECT 'sh3' AS shard_id")
def _(e):
    return e.route_key("ds_ord", 7000)


@query("equal_split_ranges", "SELECT * FROM (VALUES ('ds1-0', 'sh1', 4611686018427387901), ('ds1-1', 'sh2', -2), ('ds1-2', 'sh3', -4611686018427387905), ('ds1-3', 'sh4', CAST('-9223372036854775808' AS BIGINT))) t(key_range_id, shard_id, lower_bound)")
def _(e):
    e.meta.create_distribution("ds1", ["integer"])
    made = e.meta.equal_split("ds1")
    return e.spark.createDataFrame([(r.id, r.shard, r.lower[0]) for r in made], "key_range_id string, shard_id string, lower_bound long")


# pruning


def _pruned(name: str, columns: str, table: str, where: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: demo(spark, sf_dir).where(table, where).selectExpr(*columns.split(", "))
    _ORACLES[name] = f"SELECT {columns} FROM {table} WHERE {where}"


_pruned("prune_point", "o_orderkey, o_totalprice", "orders", "o_orderkey = 777")
_pruned("prune_in", "o_orderkey, o_custkey", "orders", "o_orderkey IN (1, 499, 500, 9999, 12000)")
_pruned("prune_range", "l_orderkey, l_linenumber, l_quantity", "lineitem", "l_orderkey BETWEEN 450 AND 620")
_pruned("prune_or", "o_orderkey, o_orderstatus", "orders", "o_orderkey < 20 OR o_orderkey >= 14000")
_pruned("prune_or_other", "o_orderkey, o_orderstatus", "orders", "o_orderkey = 5 OR o_orderstatus = 'F'")
_pruned("prune_and_conflict", "o_orderkey, o_custkey", "orders", "o_orderkey = 15 AND o_orderkey = 1")
_pruned("prune_not", "o_orderkey, o_custkey", "orders", "NOT o_orderkey > 40")
_pruned("prune_composite", "event_id, user_id, event_type", "events", "user_id = 5 AND event_type = 'signup'")
_pruned("prune_composite_prefix", "event_id, user_id, event_type", "events", "user_id <= 5")
_pruned("prune_hashed", "c_custkey, c_name", "customer", "c_custkey = 42")


@query("prune_plan", "SELECT 'Scatter' AS plan, s AS shard_id FROM (VALUES ('sh2'), ('sh3')) t(s)")
def _(e):
    return e.explain("orders", "o_orderkey >= 600 AND o_orderkey < 9000")


@query("hint_execute_on", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 5000")
def _(e):
    return e.sql("/* execute_on: sh2 */ SELECT o_orderkey, o_custkey FROM orders")


@query("hint_sharding_key", "SELECT count(*) AS n, sum(o_totalprice) > 0 AS positive FROM orders WHERE o_orderkey >= 5000 AND o_orderkey < 10000")
def _(e):
    return e.sql("/* sharding_key: 7000, distribution: ds_ord */ SELECT count(*) AS n, sum(o_totalprice) > 0 AS positive FROM orders")


same("scatter_count", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 3", "/* scatter_query: true */ ")
same("values_scan", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) t(a, b)")


@query("catalog_columns", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'string'), ('nation', 'n_regionkey', 3, 'int'), ('region', 'r_regionkey', 1, 'int'), ('region', 'r_name', 2, 'string')) t(table_name, column_name, ordinal_position, data_type)")
def _(e):
    return remote.columns(e).where(F.col("table_name").isin("nation", "region"))


@query("catalog_tables", "SELECT * FROM (VALUES ('region', 'reference'), ('nation', 'reference'), ('customer', 'distributed'), ('supplier', 'reference'), ('part', 'reference'), ('orders', 'distributed'), ('lineitem', 'distributed'), ('events', 'distributed'), ('documents', 'distributed'), ('orders_by_cust', 'distributed'), ('lineitem_ps', 'distributed')) t(table_name, kind)")
def _(e):
    return remote.tables(e)


@query("execute_text", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(e):
    return remote.execute_text(e, "SELECT 1; SELECT n_nationkey, n_name FROM nation")


@query("prepared_statement", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 99")
def _(e):
    return e.prepare("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = :key")({"key": 99})


# joins

same("join_colocated", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
same("join_colocated_left", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
same("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
same("join_full", "SELECT count(*) AS n, count(o_orderkey) AS left_rows, count(c_custkey) AS right_rows FROM orders FULL JOIN customer ON o_orderkey = c_custkey")


@query("join_reference", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(e):
    n = e.reference("nation")
    return e.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("join_reference_chain", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(e):
    df = e.table("customer").join(e.reference("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.join(e.reference("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


same("join_cross_distribution", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
same("join_values_cte", "WITH v(id) AS (VALUES (10), (20), (25), (700)) SELECT v.id, o_custkey FROM v JOIN orders ON o_orderkey = v.id")
same("join_values_cte_left", "WITH v(id) AS (VALUES (10), (-20), (25)) SELECT v.id, o_orderkey FROM v LEFT JOIN orders ON o_orderkey = v.id")
same("join_values_cte_right", "WITH v(id) AS (VALUES (10), (20), (25)) SELECT v.id, o_orderkey FROM v RIGHT JOIN orders ON o_orderkey = v.id WHERE o_orderkey < 40")
same("join_self", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
same("join_non_equi", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
same("join_lateral", "SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t")
same("multi_relation_from", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")


@query("join_self_shard_local", f"WITH o AS (SELECT o_orderkey, o_custkey, {_ladder('o_orderkey', ORD)} AS s FROM orders) SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM o a JOIN o b ON a.s = b.s AND a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def _(e):
    df, shard = e.shard_local("orders")
    a, b = df.alias("a"), df.alias("b")
    match = (F.col("a.__shard") == F.col("b.__shard")) & (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, match).select(F.col("a.o_orderkey").alias("x"), F.col("b.o_orderkey").alias("y"))


same("semi_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
same("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")


@query("range_lookup_join", f"SELECT o_orderkey, {_ladder('o_orderkey', ORD, tuple(f'ds_ord_{i}' for i in range(1, 5)))} AS key_range_id FROM orders")
def _(e):
    own = e.meta.sorted_ranges("ds_ord")
    upper = [r.lower[0] for r in own[1:]] + [None]
    ranges = e.spark.createDataFrame([(r.id, r.lower[0], u) for r, u in zip(own, upper, strict=True)], "key_range_id string, lo long, hi long")
    inside = (F.col("o_orderkey") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("o_orderkey") < F.col("hi")))
    return e.tables["orders"].join(F.broadcast(ranges), inside).select("o_orderkey", "key_range_id")  # as many rows as key ranges


# aggregates

same("agg_count_forms", "SELECT count(*) AS a, count(1) AS b, count(o_orderkey) AS c, count(DISTINCT o_custkey) AS d FROM orders")
same("agg_min_max_sum", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")
same("agg_group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


@query("agg_partial_per_shard", f"SELECT {_ladder('o_orderkey', ORD)} AS shard, count(*) AS n FROM orders GROUP BY ALL")
def _(e):
    df, shard = e.shard_local("orders")
    return df.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


_KR = tuple(f"ds_ord_{i}" for i in range(1, 5))


@query("key_stats", f"SELECT 'orders' AS relation, {_ladder('o_orderkey', ORD, _KR)} AS key_range_id, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'lineitem', {_ladder('l_orderkey', ORD, _KR)}, count(*) FROM lineitem GROUP BY ALL")
def _(e):
    return stats.key_stats(e, "ds_ord")


@query("biggest_relation", "SELECT 'lineitem' AS relation, l.n, l.n / (l.n + o.n) AS share FROM (SELECT count(*) AS n FROM lineitem) l, (SELECT count(*) AS n FROM orders) o")
def _(e):
    return stats.biggest_relation(e, "ds_ord")


@query("size_by_key_range", f"SELECT {_ladder('o_orderkey', ORD, _KR)} AS key_range_id, CAST(sum(8 + octet_length(encode(o_orderpriority)) + octet_length(encode(o_orderstatus))) AS BIGINT) AS size, count(*) AS n FROM orders GROUP BY ALL")
def _(e):
    e.register("orders", e.tables["orders"].select("o_orderkey", "o_orderpriority", "o_orderstatus"))
    return stats.sizes(e, "orders")


_EVT_KR = _EVT.replace("'sh", "'ds_evt_")


@query("cpu_by_key_range", f"SELECT {_EVT_KR} AS key_range_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS load FROM events WHERE ts >= TIMESTAMP '1900-01-01' AND ts < TIMESTAMP '2100-01-01' GROUP BY ALL")
def _(e):
    since, until = F.lit("1900-01-01").cast("timestamp_ntz"), F.lit("2100-01-01").cast("timestamp_ntz")
    return stats.load(e, "events", "props", "$.k", "ts", since, until)


@query("quantiles", "SELECT q AS quantile, quantile_cont(o_totalprice, q) AS value FROM orders, (VALUES (0.5), (0.75), (0.99)) t(q) GROUP BY q".replace("quantile_cont(o_totalprice, q)", "CASE q WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5) WHEN 0.75 THEN quantile_cont(o_totalprice, 0.75) ELSE quantile_cont(o_totalprice, 0.99) END").replace("SELECT q AS quantile", "SELECT CAST(q AS DOUBLE) AS quantile"))
def _(e):
    return stats.quantiles(e.tables["orders"], "o_totalprice", [0.5, 0.75, 0.99], exact=True)


# order, limits, windows

same("order_by_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
same("limit_after_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
same("offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
same("order_desc_multi", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey ASC LIMIT 50")
same("window_rank", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")


@query("window_lead_ranges", "SELECT * FROM (VALUES ('ds_ord_1', 0, 500), ('ds_ord_2', 500, 5000), ('ds_ord_3', 5000, 10000), ('ds_ord_4', 10000, NULL)) t(key_range_id, lo, hi)")
def _(e):
    df = e.spark.createDataFrame([(r.id, r.distribution, int(r.lower[0])) for r in e.meta.sorted_ranges("ds_ord")], "key_range_id string, distribution_id string, lo int")
    return df.select("key_range_id", "lo", F.lead("lo").over(Window.partitionBy("distribution_id").orderBy("lo")).alias("hi"))


def _bounds_sql(order: str) -> str:
    return f"SELECT bound, n FROM (SELECT o_orderkey AS bound, CAST(row_number() OVER (ORDER BY o_orderkey {order}) AS INTEGER) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey {order} LIMIT 1000)) WHERE n % 100 = 0"


@query("split_bounds_left", _bounds_sql("ASC"))
def _(e):
    return movement.split_bounds(e.tables["orders"], "o_orderkey", 100, 1000)


@query("split_bounds_right", _bounds_sql("DESC"))
def _(e):
    return movement.split_bounds(e.tables["orders"], "o_orderkey", 100, 1000, left=False)


# set operations

_A, _B = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000"
for _n, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):
    same(f"set_{_n}", f"{_A} {_op} {_B}")


@query("set_shard_local_except", f"SELECT k FROM (SELECT o_orderkey % 1000 AS k, {_ladder('o_orderkey', ORD)} AS s FROM orders EXCEPT SELECT l_orderkey % 1000, {_ladder('l_orderkey', ORD)} FROM lineitem WHERE l_linenumber = 3)")
def _(e):
    a = e.table("orders", shard=True).select((F.col("o_orderkey") % 1000).alias("k"), "__shard")
    b = e.table("lineitem", shard=True).where("l_linenumber = 3").select((F.col("l_orderkey") % 1000).alias("k"), "__shard")
    return a.subtract(b).select("k")


# console

_ORD_ROWS = "('ds_ord_1', 'sh1', 'ds_ord', '0', 'false', '500', '0.00%'), ('ds_ord_2', 'sh2', 'ds_ord', '500', 'false', '5000', '0.00%'), ('ds_ord_3', 'sh3', 'ds_ord', '5000', 'false', '10000', '0.00%'), ('ds_ord_4', 'sh4', 'ds_ord', '10000', 'false', '+inf', '50.00%')"
_KEY_RANGES = f"(VALUES {_ORD_ROWS}) t(key_range_id, shard_id, distribution_id, lower_bound, locked, next_lower_bound, coverage)"


@query("show_key_ranges", f"SELECT key_range_id, shard_id, distribution_id, lower_bound, locked FROM {_KEY_RANGES}")
def _(e):
    return e.console("SHOW key_ranges WHERE distribution_id = 'ds_ord'")


@query("show_key_ranges_extended", f"SELECT * FROM {_KEY_RANGES}")
def _(e):
    return e.console("SHOW key_ranges_extended WHERE distribution_id = ds_ord")


@query("show_relations_filtered", "SELECT * FROM (VALUES ('customer', 'murmur'), ('orders_by_cust', 'murmur')) t(relation_name, m)".replace("SELECT *", "SELECT relation_name, 'ds_cust' AS distribution_id"))
def _(e):
    return e.console("SHOW relations (relation_name, distribution_id) WHERE distribution_id = 'ds_cust'")


@query("show_group_by", "SELECT * FROM (VALUES ('sh1', '5'), ('sh2', '5'), ('sh3', '4'), ('sh4', '4')) t(shard_id, count)")
def _(e):
    return e.console("SHOW key_ranges GROUP BY shard_id")


@query("show_order_desc", "SELECT * FROM (VALUES ('sh4'), ('sh3'), ('sh2'), ('sh1')) t(shard)")
def _(e):
    return e.console("SHOW shards ORDER BY shard DESC")


@query("show_not", "SELECT * FROM (VALUES ('ds_cust', 'uinteger'), ('ds_expr', 'uinteger')) t(distribution_id, column_types)")
def _(e):
    return e.console("SHOW distributions (distribution_id, column_types) WHERE NOT column_types <> 'uinteger' AND NOT distribution_id = 'ds_ord'")


@query("console_key_range_life", "SELECT * FROM (VALUES ('a', 'sh1', '0'), ('b', 'sh3', '50'), ('last', 'sh2', '100')) t(key_range_id, shard_id, lower_bound)")
def _(e):
    return e.console(
        "CREATE DISTRIBUTION d (integer); CREATE KEY RANGE c FROM 100 ROUTE TO sh2 FOR DISTRIBUTION d; CREATE KEY RANGE a FROM 0 ROUTE TO sh1 FOR DISTRIBUTION d;"
        "SPLIT KEY RANGE b FROM a BY 50; MOVE KEY RANGE b TO sh3; RENAME KEY RANGE c TO last; SHOW key_ranges (key_range_id, shard_id, lower_bound) WHERE distribution_id = d"
    )


@query("show_reference_relations", "SELECT * FROM (VALUES ('nation', 'sh1,sh2,sh3,sh4'), ('part', 'sh1,sh2,sh3,sh4'), ('region', 'sh1,sh2,sh3,sh4'), ('supplier', 'sh1,sh2,sh3,sh4')) t(table_name, shards)")
def _(e):
    return e.console("SHOW reference_relations (table_name, shards)")


# modification


@query("insert_batch_split", f"SELECT o_orderkey, o_custkey, {_ladder('o_orderkey', ORD)} AS shard FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT * FROM (VALUES (20000001, 1), (20000002, 2)) t(a, b))")
def _(e):
    dml.insert(e, "orders", e.spark.createDataFrame([(20000001, 1), (20000002, 2)], "o_orderkey long, o_custkey long"))
    return e.table("orders", shard=True).select("o_orderkey", "o_custkey", F.col("__shard").alias("shard"))


@query("insert_select", "SELECT count(*) AS n, max(o_orderkey) AS hi FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 30000000 FROM orders WHERE o_orderstatus = 'F')")
def _(e):
    rows = e.sql("SELECT o_orderkey + 30000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
    dml.insert(e, "orders", rows)
    return e.sql("SELECT count(*) AS n, max(o_orderkey) AS hi FROM orders")


@query("insert_auto_increment", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (102, 'X'), (103, 'Y')) t(a, b)")
def _(e):
    del e.meta.references["region"]
    e.meta.create_reference("region", sequences={"r_regionkey": 101})
    dml.insert(e, "region", e.spark.createDataFrame([("X",), ("Y",)], "r_name string"))
    return e.sql("SELECT r_regionkey, r_name FROM region")


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey < 10 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 70000001, 'new'")
def _(e):
    old = e.tables["customer"]
    new = old.where("c_custkey < 10").unionByName(old.where("c_custkey = 0").withColumn("c_custkey", F.lit(70000001).cast("long")))
    dml.upsert(e, "customer", new.withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])
    return e.sql("SELECT c_custkey, c_mktsegment FROM customer")


@query("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(e):
    dml.update(e, "customer", {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)
    return e.sql("SELECT c_custkey, c_acctbal FROM customer")


@query("delete_where", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'")
def _(e):
    dml.delete(e, "orders", F.col("o_orderstatus") == "F")
    return e.sql("SELECT o_orderkey FROM orders")


@query("split_update", f"SELECT k AS o_orderkey, {_ladder('k', ORD)} AS shard FROM (SELECT CASE WHEN o_orderkey < 300 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k FROM orders)")
def _(e):
    dml.update(e, "orders", {"o_orderkey": F.col("o_orderkey") + 100000000}, F.col("o_orderkey") < 300)
    return e.table("orders", shard=True).select("o_orderkey", F.col("__shard").alias("shard"))


@query("update_returning", "SELECT o_orderkey, 'P' AS o_orderstatus, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'")
def _(e):
    return e.sql("UPDATE orders SET o_orderstatus = 'P' WHERE o_orderstatus = 'F' RETURNING o_orderkey, o_orderstatus, o_totalprice * 2 AS doubled")


@query("unique_index_build", f"SELECT o_custkey, o_orderkey, {_ladder('h', HASHED)} AS shard FROM ({_hash_sql('SELECT o_custkey, o_orderkey FROM orders', 'o_custkey')})")
def _(e):
    e.meta.create_unique_index("ui", "orders", ["o_custkey"], ["integer"])
    return dml.index_table(e, "ui").withColumnRenamed("__shard", "shard")


@query("unique_index_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(e):
    return dml.violations(e.tables["orders"], ["o_custkey"])


@query("copy_csv_routed", f"SELECT o_orderkey, o_orderpriority, {_ladder('o_orderkey', ORD)} AS shard FROM orders")
def _(e):
    lines = copying.lines_of(e.tables["orders"].select("o_orderkey", "o_orderpriority"), delimiter="|")
    rows = copying.copy_from(e, "orders", lines, ["o_orderkey", "o_orderpriority"], delimiter="|")
    return rows.select("o_orderkey", "o_orderpriority", F.col("__shard").alias("shard"))


@query("copy_pinned", "SELECT o_orderkey, 'sh3' AS shard FROM orders")
def _(e):
    lines = copying.lines_of(e.tables["orders"].select("o_orderkey"), "csv")
    return copying.copy_from(e, "orders", lines, ["o_orderkey"], "csv", execute_on="sh3").select("o_orderkey", F.col("__shard").alias("shard"))


@query("copy_hashed_key", f"SELECT c_custkey, c_name, {_ladder('h', HASHED)} AS shard FROM ({_hash_sql('SELECT c_custkey, c_name FROM customer', 'c_custkey')})")
def _(e):
    lines = copying.lines_of(e.tables["customer"].select("c_custkey", "c_name"), "csv")
    return copying.copy_from(e, "customer", lines, ["c_custkey", "c_name"], "csv").select("c_custkey", "c_name", F.col("__shard").alias("shard"))


@query("copy_reference", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(e):
    return copying.copy_from(e, "nation", copying.lines_of(e.tables["nation"]))


@query("copy_to_lines", "SELECT CAST(n_nationkey AS VARCHAR) || '|' || n_name AS value FROM nation")
def _(e):
    path = f"{shared_dir(e.spark)}/lines-{uuid.uuid4().hex}"
    copying.copy_to(e.tables["nation"].select("n_nationkey", "n_name"), path, delimiter="|")
    return e.spark.read.text(path)


@query("copy_without_key", "SELECT 'MetadataError' AS error")
def _(e):
    return _refused(e, lambda: copying.copy_from(e, "orders", e.spark.createDataFrame([("1",)], "value string"), ["o_custkey"]))


@query("metadata_dump", "SELECT 'ds_ord_1' AS id, 'sh1' AS shard UNION ALL SELECT 'ds_ord_2', 'sh2' UNION ALL SELECT 'ds_ord_3', 'sh3' UNION ALL SELECT 'ds_ord_4', 'sh4'")
def _(e):
    again = Metadata.load(copying.metadata_json(e))
    return e.spark.createDataFrame([(r.id, r.shard) for r in again.sorted_ranges("ds_ord")], "id string, shard string")


@query("workload_replay", "SELECT n_nationkey FROM nation UNION ALL SELECT 99")
def _(e):
    e.replay(e.spark.createDataFrame([(1, "INSERT INTO nation VALUES (99, 'X', 1)"), (0, "SELECT 1")], "n long, statement string"))
    return e.sql("SELECT n_nationkey FROM nation")


# planning of whole statements

_PLAN = "SELECT * FROM (VALUES {}) t(plan, shard_id)"


def _explained(name: str, statement: str, rows: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: demo(spark, sf_dir).sql(f"EXPLAIN {statement}")
    _ORACLES[name] = _PLAN.format(rows)


_ALL = "('Scatter', 'sh1'), ('Scatter', 'sh2'), ('Scatter', 'sh3'), ('Scatter', 'sh4')"
_explained("explain_sql", "SELECT count(*) FROM orders WHERE o_orderkey >= 600 AND o_orderkey < 9000", "('Scatter', 'sh2'), ('Scatter', 'sh3')")
_explained("explain_point", "SELECT o_custkey FROM orders WHERE o_orderkey = 777", "('OneShard', 'sh2')")
_explained("explain_all", "SELECT count(*) FROM orders", _ALL)
_explained("explain_hashed", "SELECT c_name FROM customer WHERE c_custkey = 42", f"('OneShard', '{SHARDS[hashing.hash_value(42, 'integer', 'murmur') // QUARTER]}')")
_explained("explain_join_either_key", "SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey = 7000", "('OneShard', 'sh3')")
_explained("explain_join_reference", "SELECT count(*) FROM orders JOIN part ON o_orderkey = p_partkey WHERE o_orderkey < 100", "('OneShard', 'sh1')")
_explained("explain_reference", "SELECT n_name FROM nation", "('AnyShard', 'sh1')")
_explained("explain_virtual", "SELECT 1 AS a", "('Virtual', NULL)")
_explained("dispatch_union", "SELECT o_custkey FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o_custkey FROM orders WHERE o_orderkey = 20000", "('Scatter', 'sh1'), ('Scatter', 'sh4')")
_explained("dispatch_values_cte", "WITH v(id) AS (VALUES (10), (25), (700)) SELECT v.id, o_custkey FROM v JOIN orders ON o_orderkey = v.id", "('Scatter', 'sh1'), ('Scatter', 'sh2')")
_explained("dispatch_subquery", "SELECT (SELECT max(o_custkey) FROM orders WHERE o_orderkey = 5) AS a, (SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = 6000) AS b", "('Scatter', 'sh1'), ('Scatter', 'sh3')")
_explained("dispatch_in_subquery", "SELECT o_custkey FROM orders WHERE o_orderkey = 700 AND o_custkey IN (SELECT c_custkey FROM customer)", _ALL)
_explained("dispatch_cte", "WITH w AS (SELECT o_orderkey FROM orders WHERE o_orderkey = 700) SELECT * FROM w", "('OneShard', 'sh2')")


def _refused(e, action) -> DataFrame:
    """The type of the error that a statement stops with."""
    try:
        out = action()
        if out is not None:
            out.collect()
    except Exception as error:  # noqa: BLE001
        return e.spark.createDataFrame([(type(error).__name__,)], "error string")
    return e.spark.createDataFrame([("none",)], "error string")


@query("hint_pin", "SELECT count(*) AS n FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 5000")
def _(e):
    return e.sql("/* default_route_behaviour: sh2 */ SELECT count(*) AS n FROM orders")


@query("block_join", "SELECT 'DispatchError' AS error")
def _(e):
    return _refused(e, lambda: e.sql("/* default_route_behaviour: BLOCK */ SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey"))


@query("block_union", "SELECT 'DispatchError' AS error")
def _(e):
    return _refused(e, lambda: e.sql("/* default_route_behaviour: BLOCK */ SELECT o_orderkey FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey = 20000"))


@query("block_one_shard", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = 7")
def _(e):
    return e.sql("/* default_route_behaviour: BLOCK */ SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = 7")


@query("postprocessing_off", f"SELECT count(o_totalprice) AS n, max(o_totalprice) AS top FROM (VALUES ('sh1'), ('sh2'), ('sh3'), ('sh4')) s(shard) LEFT JOIN (SELECT o_totalprice, {_ladder('o_orderkey', ORD)} AS shard FROM orders) o USING (shard) GROUP BY shard")
def _(e):
    return e.sql("/* allow_postprocessing: off */ SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")


@query("postprocessing_off_limit", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY {_ladder('o_orderkey', ORD)} ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(e):
    return e.sql("/* allow_postprocessing: off */ SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")


def _laid_out(e, name: str):
    e.lay_out(name, f"{shared_dir(e.spark)}/layout-{uuid.uuid4().hex}")
    return e


@query("layout_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 777")
def _(e):
    return _laid_out(e, "orders").sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 777")


@query("layout_hashed", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (42, 43)")
def _(e):
    return _laid_out(e, "customer").where("customer", "c_custkey IN (42, 43)").select("c_custkey", "c_name")


@query("layout_whole", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders")
def _(e):
    return _laid_out(e, "orders").sql("SELECT count(*) AS n, sum(o_custkey) AS s FROM orders")


@query("any_array_subselect", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(e):
    return e.sql("SELECT c_custkey FROM customer WHERE c_custkey = ANY(ARRAY(SELECT o_custkey FROM orders WHERE o_totalprice > 300000))")


same("join_natural", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) NATURAL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')")
same("agg_mixed_targets", "SELECT l_returnflag, max(l_quantity) AS hi, 1 AS one, upper(l_returnflag) AS flag FROM lineitem GROUP BY l_returnflag")


@query("portal_max_rows", "SELECT * FROM (VALUES (10), (10), (5)) t(n)")
def _(e):
    return e.spark.createDataFrame([(len(part),) for part in e.portal("SELECT n_nationkey FROM nation", 10)], "n int")


@query("shard_metadata_diff", "SELECT * FROM (VALUES ('sh2', 'changed'), ('sh4', 'deleted'), ('sh9', 'added')) t(shard, change)")
def _(e):
    old = copy.deepcopy(e.meta)
    e.console("ALTER SHARD sh2 OPTIONS (SET az b); CREATE SHARD sh9")
    del e.meta.shards["sh4"]
    return stats.shards_diff(e.spark, old, e.meta)


@query("running_latest_range", f"SELECT o_orderkey, {_ladder('o_orderkey', ORD, tuple(f'ds_ord_{i}' for i in range(1, 5)))} AS key_range_id FROM orders")
def _(e):
    return stats.latest_range(e, "orders")


@query("catalog_mixed", "SELECT 'MetadataError' AS error")
def _(e):
    return _refused(e, lambda: e.sql("SELECT * FROM information_schema.tables, orders"))


@query("catalog_information_schema", "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('region', 'r_name')) t(table_name, column_name)")
def _(e):
    return e.sql("SELECT table_name, column_name FROM information_schema.columns WHERE table_name = 'region'")


@query("functions_session", "SELECT FALSE AS recovery, 'off' AS read_only, 'x' AS made, TRUE AS named")
def _(e):
    return e.sql("SELECT pg_is_in_recovery() AS recovery, current_setting('transaction_read_only') AS read_only, set_config('my.name', 'x', false) AS made, current_user() IS NOT NULL AS named")


def _engine_function(name: str, text: str, oracle: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: demo(spark, sf_dir).sql(text)
    _ORACLES[name] = oracle


_engine_function("function_show", "SELECT * FROM __engine__show('shards')", "SELECT * FROM (VALUES ('sh1'), ('sh2'), ('sh3'), ('sh4')) t(shard)")
_engine_function("function_shards", "SELECT __engine__shards()", "SELECT * FROM (VALUES ('sh1'), ('sh2'), ('sh3'), ('sh4')) t(shard)")
_engine_function("function_is_ready", "SELECT __engine__is_ready()", "SELECT TRUE AS is_ready")
_engine_function("function_host_status", "SELECT __engine__host_status('sh1')", "SELECT 'sh1' AS host, 'true' AS rw")
_engine_function("function_await_task", "SELECT __engine__await_task('none')", "SELECT 'COMPLETE' AS state")
_engine_function("function_console_execute", "SELECT __engine__console_execute('SHOW shards (shard) WHERE shard = sh2')", "SELECT 'sh2' AS shard")
_engine_function("function_route_key", "SELECT __engine__route_key('ds_ord', 7000)", "SELECT 'sh3' AS shard_id")

# movement


@query("move_key_range", "SELECT CASE WHEN o_orderkey < 500 OR o_orderkey >= 10000 THEN 'sh4' WHEN o_orderkey >= 5000 THEN 'sh3' ELSE 'sh2' END AS shard, count(*) AS n FROM orders GROUP BY ALL")
def _(e):
    movement.move(e, "ds_ord_1", "sh4")
    return e.table("orders", shard=True).groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("n"))


@query("unite_after_split", "SELECT * FROM (VALUES ('ds_ord_1', '0'), ('ds_ord_2', '500'), ('ds_ord_3', '5000'), ('ds_ord_4', '10000')) t(key_range_id, lower_bound)")
def _(e):
    e.meta.split("part", "ds_ord_2", (700,))
    e.meta.unite("ds_ord_2", "part")
    return e.console("SHOW key_ranges (key_range_id, lower_bound) WHERE distribution_id = ds_ord")


@query("redistribute_batches", "SELECT CASE WHEN o_orderkey >= 10000 THEN 'sh4' WHEN o_orderkey >= 5000 THEN 'sh3' WHEN o_orderkey >= 500 THEN 'sh2' ELSE 'sh3' END AS shard, count(*) AS n FROM orders GROUP BY ALL")
def _(e):
    e.meta.detach("ds_ord", "lineitem")
    movement.redistribute(e, "ds_ord_1", "sh3", batch=200)
    return e.table("orders", shard=True).groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("n"))


@query("balancer_plan", "SELECT 'k1' AS key_range, 'a' AS source, 'b' AS shard, 40 AS keys, 'right' AS \"join\"")
def _(e):
    loads = [("k1", "a", "d", 100, {"cpu": 100.0}), ("k2", "b", "d", 10, {"cpu": 10.0}), ("k3", "c", "d", 5, {"cpu": 1.0})]
    step = movement.balance(loads, {"cpu": 60.0})
    return e.spark.createDataFrame([(step.key_range, step.source, step.shard, step.keys, step.join)], "key_range string, source string, shard string, keys int, join string")


@query("redistribute_later", "SELECT 'tg' AS task_group_id, 'PLANNED' AS before, 'COMPLETE' AS after, 'sh3' AS shard_id")
def _(e):
    e.console("REDISTRIBUTE KEY RANGE ds_ord_1 TO sh3 BATCH SIZE 200 TASK GROUP tg NOWAIT")
    before = e.meta.tasks["tg"].state
    e.console("RETRY TASK GROUP tg")
    return e.spark.createDataFrame([("tg", before, e.meta.tasks["tg"].state, e.meta.range("ds_ord_1").shard)], "task_group_id string, before string, after string, shard_id string")


@query("redistribute_stopped", "SELECT 'STOPPED' AS state, 1 AS done, 'sh1' AS shard_id")
def _(e):
    task = movement.redistribute(e, "ds_ord_1", "sh3", 200, "tg", later=True)
    movement.resume(e, task, most=1)
    e.console("STOP TASK GROUP tg")
    return e.spark.createDataFrame([(task.state, sum(m["state"] == "COMPLETE" for m in task.moves), e.meta.range("ds_ord_1").shard)], "state string, done int, shard_id string")


@query("redistribute_checks", "SELECT 'MetadataError' AS batch, 'COMPLETE' AS same_shard, 'CHECKED' AS dry_run")
def _(e):
    batch = _refused(e, lambda: movement.redistribute(e, "ds_ord_1", "sh3", 0)).first()[0]
    return e.spark.createDataFrame([(batch, movement.redistribute(e, "ds_ord_1", "sh1").state, movement.redistribute(e, "ds_ord_1", "sh3", check=True).state)], "batch string, same_shard string, dry_run string")


# modification that keeps its rules


def _after(name: str, statements: list[str], oracle: str) -> None:
    """The result of the last of some statements on one engine."""

    def run(spark, sf_dir):
        e = demo(spark, sf_dir)
        for text in statements[:-1]:
            e.sql(text)
        return e.sql(statements[-1])

    _QUERIES[name], _ORACLES[name] = run, oracle


def _stops(name: str, before: list[str], statement: str, error: str = "MetadataError") -> None:
    def run(spark, sf_dir):
        e = demo(spark, sf_dir)
        for text in before:
            e.console(text[8:]) if text.startswith("console ") else e.sql(text)
        return _refused(e, lambda: e.sql(statement))

    _QUERIES[name], _ORACLES[name] = run, f"SELECT '{error}' AS error"


_after("update_count", ["UPDATE orders SET o_orderpriority = 'x' WHERE o_orderstatus = 'F'"], "SELECT 'UPDATE ' || count(*) AS result FROM orders WHERE o_orderstatus = 'F'")
_after("delete_count", ["DELETE FROM orders WHERE o_orderstatus = 'F'"], "SELECT 'DELETE ' || count(*) AS result FROM orders WHERE o_orderstatus = 'F'")
_after("insert_count", ["INSERT INTO orders (o_orderkey, o_custkey) SELECT o_orderkey + 50000000, o_custkey FROM orders"], "SELECT 'INSERT 0 ' || count(*) AS result FROM orders")
_after("delete_returning", ["DELETE FROM nation WHERE n_regionkey = 1 RETURNING n_nationkey, n_name"], "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
_after("update_everything", ["UPDATE customer SET c_mktsegment = 'ALL'", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"], "SELECT 'ALL' AS c_mktsegment, count(*) AS n FROM customer")
_after("update_reference", ["UPDATE nation SET n_name = lower(n_name) WHERE n_regionkey = 0", "SELECT n_nationkey, n_name FROM nation"], "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
_after("insert_column_order", ["INSERT INTO region (r_name, r_regionkey) VALUES ('Z', 77)", "SELECT r_regionkey, r_name FROM region"], "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'Z'")
_after("upsert_nothing", ["INSERT INTO customer (c_custkey, c_name) VALUES (1, 'x'), (70000001, 'a'), (70000001, 'a') ON CONFLICT (c_custkey) DO NOTHING", "SELECT c_custkey, c_name FROM customer"], "SELECT c_custkey, c_name FROM customer UNION ALL SELECT 70000001, 'a'")
_after("upsert_excluded", ["INSERT INTO customer (c_custkey, c_name) SELECT c_custkey, 'new' FROM customer WHERE c_custkey < 100 ON CONFLICT (c_custkey) DO UPDATE SET c_name = excluded.c_name", "SELECT c_custkey, c_name FROM customer"], "SELECT c_custkey, CASE WHEN c_custkey < 100 THEN 'new' ELSE c_name END AS c_name FROM customer")
_after("prepared_parameters", ["PREPARE p (int) AS SELECT 'cost $1' AS a, $1 AS b, o_orderkey FROM orders WHERE o_orderkey < $1", "EXECUTE p(50)"], "SELECT 'cost $1' AS a, 50 AS b, o_orderkey FROM orders WHERE o_orderkey < 50")
_after("prepared_modification", ["PREPARE p AS UPDATE nation SET n_name = $1 WHERE n_regionkey = $2", "EXECUTE p('a, $2', 3)", "SELECT n_nationkey, n_name FROM nation"], "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 'a, $2' ELSE n_name END AS n_name FROM nation")
_after("create_table_attached", ["SET auto_distribution = ds_ord", "SET distribution_key = k", "CREATE TABLE fresh (k BIGINT PRIMARY KEY, v VARCHAR(10))", "INSERT INTO fresh VALUES (7, 'a'), (700, 'b')", "SELECT * FROM __engine__ctid('fresh')"], "SELECT * FROM (VALUES ('shard sh1', 7, 'a'), ('shard sh2', 700, 'b')) t(shard, k, v)")
_after("truncate_table", ["TRUNCATE orders", "SELECT count(*) AS n FROM orders"], "SELECT 0 AS n")
_stops("update_key_without_range", [], "UPDATE orders SET o_orderkey = -5 WHERE o_orderkey = 1")
_stops("update_unique_index", ["console CREATE UNIQUE INDEX i ON customer COLUMNS (c_custkey INTEGER)"], "UPDATE customer SET c_custkey = 1")
_stops("insert_unique_index", ["console CREATE UNIQUE INDEX i ON customer COLUMNS (c_name VARCHAR HASH)"], "INSERT INTO customer SELECT * FROM customer")
_stops("upsert_repeated_key", [], "INSERT INTO customer (c_custkey, c_name) VALUES (70000001, 'a'), (70000001, 'b') ON CONFLICT (c_custkey) DO UPDATE SET c_name = excluded.c_name")
_stops("split_update_refused", ["SET allow_split_update = off"], "UPDATE orders SET o_orderkey = o_orderkey + 1")
_stops("create_table_without_key", ["console CREATE RELATION bare (k) FOR DISTRIBUTION ds_ord"], "CREATE TABLE bare (v INT)")
_stops("drop_unknown_table", [], "DROP TABLE nowhere")
_stops("hash_in_expression", [], "EXECUTE nothing(1)")


# the console's relations and statements, one query each


def _shown(name: str, script: str, rows: str, columns: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: demo(spark, sf_dir).console(script)
    _ORACLES[name] = f"SELECT * FROM (VALUES {rows}) t({columns})"


def _console_stops(name: str, script: str, error: str) -> None:
    def run(spark, sf_dir):
        e = demo(spark, sf_dir)
        return _refused(e, lambda: e.console(script))

    _QUERIES[name], _ORACLES[name] = run, f"SELECT '{error}' AS error"


_shown("show_shards_extended", "CREATE SHARD sh5 OPTIONS (dbname x); ALTER SHARD sh5 OPTIONS (SET a 1, ADD b 2, DROP dbname); SHOW shards_extended WHERE shard = sh5", "('sh5', 'a=1,b=2')", "shard, options")
_shown("show_unique_indexes", "CREATE UNIQUE INDEX ui ON customer COLUMNS (c_name VARCHAR HASH); SHOW unique_indexes", "('ui', 'customer', 'c_name', 'varchar hashed')", "id, relation_name, columns, column_types")
_shown("show_sequences", "CREATE REFERENCE TABLE z AUTO INCREMENT id START 19; SHOW sequences", "('z_id', '19')", "name, value")
_shown("show_task_groups", "REDISTRIBUTE KEY RANGE ds_ord_1 TO sh3 BATCH SIZE 100 TASK GROUP tg NOWAIT; SHOW task_groups (task_group_id, destination_shard_id, source_key_range_id, batch_size, state)", "('tg', 'sh3', 'ds_ord_1', '100', 'PLANNED')", "task_group_id, destination_shard_id, source_key_range_id, batch_size, state")
_shown("show_move_tasks", "REDISTRIBUTE KEY RANGE ds_ord_4 TO sh1 BATCH SIZE 1000000 TASK GROUP tg; SHOW move_tasks (task_group_id, move_task_id, bound, state)", "('tg', 'mt0', '10000', 'COMPLETE')", "task_group_id, move_task_id, bound, state")
_shown("show_task_groups_ext", "REDISTRIBUTE KEY RANGE ds_ord_4 TO sh1 BATCH SIZE 1000000 TASK GROUP tg; SHOW task_groups_ext", "('tg', '10000', 'USED')", "task_group_id, bound, status")
_shown("show_redistribute_tasks", "REDISTRIBUTE KEY RANGE ds_ord_1 TO sh3 TASK GROUP tg NOWAIT; SHOW redistribute_tasks", "('tg', 'tg', 'ds_ord_1', 'sh3', '500')", "redistribute_task_id, task_group_id, key_range_id, destination_shard_id, batch_size")
_shown("show_time_quantiles", "SHOW time_quantiles", ", ".join(f"('{k}_time_{q}', '0.00')" for q in ("0.75", "0.90", "0.999", "0.9999") for k in ("router", "shard")), "quantile_type, time_ms")
_shown("show_mean_lock_time", "SHOW mean_key_range_lock_time", "('0s')", "mean_key_range_lock_time")
_shown("show_move_stats", "MOVE KEY RANGE ds_ord_1 TO sh2; SHOW move_stats (statistic)", "('data_move'), ('metadata_update')", "statistic")
_shown("show_version", "SHOW version", "('1.0')", "version")
_shown("show_is_read_only", "SHOW is_read_only", "('false')", "is_read_only")
_shown("show_startup_finished", "SHOW startup_finished", "('true')", "startup_finished")
_shown("show_file_settings", "SHOW file_settings WHERE name = default_route_behaviour", "('default_route_behaviour', 'ALLOW', 'true')", "name, setting, applied")
_shown("show_users", "SHOW users (dbname, connection_limit)", "('default', '-1')", "dbname, connection_limit")
_shown("show_arithmetic", "SHOW key_ranges (key_range_id) WHERE distribution_id = ds_ord AND lower_bound + 1 > 500 * 2", "('ds_ord_3'), ('ds_ord_4')", "key_range_id")
_shown("show_integer_as_text", "SHOW key_ranges (key_range_id) WHERE lower_bound = 500", "('ds_ord_2')", "key_range_id")
_shown("show_default_order", "SHOW relations (relation_name)", "('customer'), ('documents'), ('events'), ('lineitem'), ('lineitem_ps'), ('orders'), ('orders_by_cust')", "relation_name")
_shown("console_help", "HELP LOCK", "('LOCK KEY RANGE name | ALL.')", "help")
_shown("console_create_shard", "CREATE SHARD sh5; SHOW shards WHERE shard = sh5", "('sh5')", "shard")
_shown("console_create_ranges", "CREATE DISTRIBUTION d (integer); CREATE KEY RANGES FOR DISTRIBUTION d BETWEEN 0 AND 99 USING SHARDS sh1, sh2, sh3; SHOW key_ranges (key_range_id, shard_id, lower_bound) WHERE distribution_id = d", "('d-2', 'sh3', '0'), ('d-1', 'sh2', '33'), ('d-0', 'sh1', '66')", "key_range_id, shard_id, lower_bound")
_shown("console_create_relation", "CREATE DISTRIBUTED RELATION r (a HASH MURMUR) FOR DISTRIBUTION ds_cust; SHOW relations WHERE relation_name = r", "('r', 'ds_cust', '(\"a\", murmur)', 'public')", "relation_name, distribution_id, distribution_key, schema_name")
_shown("console_create_reference", "CREATE REFERENCE TABLE z AUTO INCREMENT id START 5 ON SHARDS sh1, sh2; SHOW reference_relations WHERE table_name = z", "('z', 'public', '1', 'sh1,sh2', 'id->z_id')", "table_name, schema_name, schema_version, shards, column_sequence_mapping")
_shown("console_alter_attach", "ALTER DISTRIBUTION ds_cust DETACH RELATION customer; ALTER DISTRIBUTION ds_cust ATTACH RELATION fresh DISTRIBUTION KEY k HASH FUNCTION MURMUR; SHOW relations (relation_name) WHERE distribution_id = ds_cust", "('fresh'), ('orders_by_cust')", "relation_name")
_shown("console_default_shard", "ALTER DISTRIBUTION ds_cust DROP DEFAULT SHARD".replace("ds_cust DROP", "ds_ord ADD").replace("DEFAULT SHARD", "DEFAULT SHARD sh2") + "; SHOW distributions (distribution_id, default_shard) WHERE distribution_id = ds_ord", "('ds_ord', 'sh2')", "distribution_id, default_shard")
_shown("console_alter_relation", "ALTER RELATION orders SCHEMA sales; ALTER RELATION orders RENAME DISTRIBUTION COLUMN o_orderkey TO k; SHOW relations (distribution_key, schema_name) WHERE relation_name = orders", "('(\"k\", identity)', 'sales')", "distribution_key, schema_name")
_shown("console_alter_reference", "ALTER REFERENCE TABLE nation STORAGE TO (sh3); SYNC REFERENCE TABLE nation ON sh1; SHOW reference_relations (schema_version, shards) WHERE table_name = nation", "('2', 'sh3,sh1')", "schema_version, shards")
_shown("console_drop", "DROP KEY RANGE ds_ord_1; DROP DISTRIBUTION ds_expr CASCADE; DROP REFERENCE TABLE part; SHOW key_ranges (key_range_id) WHERE distribution_id = ds_ord OR distribution_id = ds_expr", "('ds_ord_2'), ('ds_ord_3'), ('ds_ord_4')", "key_range_id")
_shown("console_lock", "LOCK KEY RANGE ds_ord_1; SHOW key_ranges (key_range_id, locked) WHERE locked = true", "('ds_ord_1', 'true')", "key_range_id, locked")
_shown("console_unlock", "LOCK KEY RANGE ALL; UNLOCK KEY RANGE ALL; SHOW key_ranges GROUP BY locked", "('false', '18')", "locked, count")
_shown("console_sync_all", "CREATE SHARD sh5; SYNC REFERENCE TABLES ON sh5; SHOW reference_relations (table_name, shards) WHERE table_name = region", "('region', 'sh1,sh2,sh3,sh4,sh5')", "table_name, shards")
_console_stops("console_add_refused", "ADD KEY RANGE x FROM 1 ROUTE TO sh1", "SyntaxProblem")
_console_stops("console_locked_refused", "LOCK KEY RANGE ds_ord_1; MOVE KEY RANGE ds_ord_1 TO sh2", "MetadataError")
_console_stops("console_key_count", "CREATE RELATION r (a, b) FOR DISTRIBUTION ds_ord", "MetadataError")
_console_stops("console_intersects", "CREATE KEY RANGE x FROM 600 ROUTE TO sh4 FOR DISTRIBUTION ds_ord", "MetadataError")
_console_stops("hint_ambiguous_hash", "ALTER DISTRIBUTION ds_cust ATTACH RELATION other DISTRIBUTION KEY k", "MetadataError")


@query("show_errors", "SELECT 'DispatchError' AS error_type, '2' AS count")
def _(e):
    for _ in range(2):
        _refused(e, lambda: e.sql("/* default_route_behaviour: BLOCK */ SELECT count(*) AS n FROM orders"))
    return e.console("SHOW errors")


@query("show_prepared_statements", "SELECT 'p' AS name, 'SELECT 1' AS query")
def _(e):
    e.sql("PREPARE p AS SELECT 1")
    return e.console("SHOW prepared_statements (name, query)")


@query("settings_spellings", "SELECT 'off' AS setting")
def _(e):
    e.sql("SET SESSION __engine__.engine_v2 TO off")
    return e.console("SHOW file_settings (setting) WHERE name = engine_v2")


# target lists and common table expressions

same("scalar_subqueries_target_list", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey < 100) AS a, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 0), -1) AS b, (SELECT min(c_custkey) FROM customer) AS c")
same("cte_chain", "WITH v(id) AS (VALUES (10), (600), (7000)), w AS (SELECT o_orderkey, o_custkey FROM orders JOIN v ON o_orderkey = v.id) SELECT w.o_orderkey, c_name FROM w JOIN customer ON c_custkey = w.o_custkey")
same("constants", "SELECT 1 AS a, 'x' AS b, TRUE AS c")
same("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
