import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.operators import dml, movement, stats
from rangeloom.operators.routing import placed, with_shard
from rangeloom.plans import pruning
from rangeloom.plans.engine import Engine
from rangeloom.plans.model import KeyColumn, Metadata, MetadataError, Relation
from rangeloom.plans.syntax import OTHER, SyntaxProblem, hints, predicate, truth
from rangeloom.sources import copy
from rangeloom.streaming import load as streaming


@pytest.fixture()
def engine(spark):
    m = Metadata(["sh1", "sh2", "sh3", "sh4"])
    m.create_distribution("d", ["integer"])
    m.create_distribution("two", ["integer", "varchar"])
    for i in (3, 2, 1, 0):
        m.create_range(f"k{i}", (i * 100,), f"sh{i + 1}", "d")
    for i, b in reversed(list(enumerate([(0, "aaaaa"), (0, "zzzzz"), (100, "aaaaa"), (100, "zzzzz")]))):
        m.create_range(f"m{i}", b, f"sh{i + 1}", "two")
    m.attach("d", Relation("t", [KeyColumn("id")]))
    m.attach("two", Relation("c", [KeyColumn("id"), KeyColumn("addr")]))
    m.create_reference("ref")
    e = Engine(spark, m)
    e.register("t", spark.createDataFrame([(i, i % 7, None if i % 5 == 0 else f"v{i}") for i in [*range(-20, 420, 10), 99, 101]] + [(None, 1, "x")], "id long, j long, s string"))
    e.register("c", spark.createDataFrame([(0, "a"), (0, "aaaaa"), (0, "zzzzz"), (5, "b"), (100, "aa"), (100, "aaaaa"), (100, "zzzzzz"), (None, "q")], "id long, addr string"))
    e.register("ref", spark.createDataFrame([(1, "a")], "i long, v string"))
    return e


def test_shards(engine):
    got = {(r.id, r.addr): r["__shard"] for r in engine.table("c", shard=True).collect()}
    assert got == {(0, "a"): None, (0, "aaaaa"): "sh1", (0, "zzzzz"): "sh2", (5, "b"): "sh2", (100, "aa"): "sh2", (100, "aaaaa"): "sh3", (100, "zzzzzz"): "sh4", (None, "q"): None}
    with pytest.raises(Exception, match="no key range"):
        placed(engine.tables["t"], engine.meta, "t").collect()


def test_plans_reach_the_scan(spark, engine, tmp_path):
    spark.range(0, 400).toDF("id").withColumn("j", F.col("id")).withColumn("s", F.lit("x")).write.parquet(str(tmp_path / "t"))
    engine.register("t", spark.read.parquet(str(tmp_path / "t")))
    plan = engine.where("t", "id >= 120 AND id + 0 < 250 AND id < 250")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,100)" in plan and "LessThan(id,300)" in plan
    assert [r.shard_id for r in engine.explain("t", "id BETWEEN 120 AND 250").collect()] == ["sh2", "sh3"]


_values = st.integers(-30, 430)
_atoms = st.one_of(
    st.tuples(st.sampled_from(["=", "<", "<=", ">", ">=", "<>"]), _values).map(lambda x: f"id {x[0]} {x[1]}"),
    st.lists(_values, min_size=1, max_size=4).map(lambda v: f"id IN ({', '.join(map(str, v))})"),
    st.tuples(_values, _values).map(lambda x: f"id BETWEEN {x[0]} AND {x[1]}"),
    st.sampled_from(["j = 3", "s IS NULL", "id + 1 > 100", "s LIKE 'v1%'", "100 < id"]),
)
_trees = st.recursive(_atoms, lambda c: st.one_of(st.tuples(c, st.sampled_from(["AND", "OR"]), c).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), c.map(lambda x: f"NOT ({x})")), max_leaves=6)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=_trees)
def test_pruning_never_changes_rows(engine, text):
    extra = pruning.condition(engine.meta, "t", predicate(text))
    if extra is not None:
        df = engine.tables["t"].where(text)
        assert sorted(r.id for r in df.collect()) == sorted(r.id for r in df.where(extra).collect())
    touched = {r.id for r in pruning.ranges(engine.meta, "t", predicate(text))}
    found = {r[0] for r in with_shard(engine.tables["t"], engine.meta, "t", key_range=True).where(text).select("__key_range").distinct().collect()} - {None}
    assert found <= touched


_pairs = st.tuples(st.sampled_from(["=", "<", "<=", ">", ">="]), st.sampled_from([0, 5, 100, 101])).map(lambda x: f"id {x[0]} {x[1]}")
_texts = st.tuples(st.sampled_from(["=", "<", "<=", ">", ">="]), st.sampled_from(["a", "aaaaa", "b", "zzzzz"])).map(lambda x: f"addr {x[0]} '{x[1]}'")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=_pairs, b=_texts, word=st.sampled_from(["AND", "OR"]))
def test_pruning_of_two_columns(engine, a, b, word):
    text = f"{a} {word} {b}"
    df = engine.tables["c"].where(text)
    extra = pruning.condition(engine.meta, "c", predicate(text))
    if extra is not None:
        assert sorted(map(str, df.collect())) == sorted(map(str, df.where(extra).collect()))
    touched = {r.id for r in pruning.ranges(engine.meta, "c", predicate(text))}
    found = {r[0] for r in with_shard(engine.tables["c"], engine.meta, "c", key_range=True).where(text).select("__key_range").collect()} - {None}
    assert found <= touched


def test_syntax():
    assert predicate("id = 1 AND x > 2") == ("and", ("cmp", "id", "=", 1), ("cmp", "x", ">", 2))
    assert predicate("id = f(1)") == OTHER and predicate("'unclosed") == OTHER
    assert predicate("id = 1 + 1") == OTHER
    assert hints("/* execute_on: sh1, scatter_query: true */ SELECT 1") == ({"execute_on": "sh1", "scatter_query": "true"}, "SELECT 1")
    assert truth("on") and not truth("NO")
    with pytest.raises(SyntaxProblem):
        truth("maybe")


def test_sql_hints_and_blocking(engine):
    assert engine.sql("/* execute_on: sh2 */ SELECT count(*) AS n FROM t").first().n == 11
    assert engine.sql("/* sharding_key: 250, distribution: d */ SELECT max(id) AS m FROM t").first().m == 290
    with pytest.raises(ValueError, match="more than one shard"):
        engine.sql("/* default_route_behaviour: BLOCK */ SELECT * FROM t")
    assert engine.sql("/* default_route_behaviour: BLOCK */ SELECT * FROM t WHERE id = 110").count() == 1
    assert engine.sql("SELECT t.id FROM t WHERE t.id >= 390 ORDER BY id").count() == 3


def test_whole_statements(engine):
    """Every relation counts for the plan, wherever it stands."""
    plan = lambda text: sorted((r.plan, r.shard_id) for r in engine.sql(f"EXPLAIN {text}").collect())
    assert plan("SELECT * FROM t WHERE id = 110") == [("OneShard", "sh2")]
    assert plan("SELECT a.id FROM t a JOIN t b ON a.id = b.id WHERE a.id = 250") == [("OneShard", "sh3")]
    assert plan("SELECT id FROM t WHERE id = 10 UNION SELECT id FROM t WHERE id = 110") == [("Scatter", "sh1"), ("Scatter", "sh2")]
    assert plan("SELECT * FROM t, ref WHERE t.id = ref.i AND t.id = 1") == [("OneShard", "sh1")]
    assert plan("WITH v(k) AS (VALUES (5), (310)) SELECT * FROM v JOIN t ON t.id = v.k") == [("Scatter", "sh1"), ("Scatter", "sh4")]
    assert len(plan("WITH v(k) AS (VALUES (5)) SELECT * FROM v RIGHT JOIN t ON t.id = v.k")) == 4
    assert plan("SELECT 't' AS name") == [("Virtual", None)]
    for text in ("SELECT a.id FROM t a JOIN t b ON a.id = b.id", "SELECT id FROM t WHERE id = 10 UNION SELECT id FROM t WHERE id = 110", "SELECT (SELECT max(id) FROM t) AS m"):
        with pytest.raises(ValueError, match="more than one shard"):
            engine.sql(f"/* default_route_behaviour: BLOCK */ {text}")
    assert engine.sql("/* default_route_behaviour: sh2 */ SELECT min(id) AS a, 'from t' AS b, count(*) AS n FROM t x WHERE x.id > 3").first()[:] == (100, "from t", 11)
    assert sorted(r.n for r in engine.sql("/* allow_postprocessing: off */ SELECT count(*) AS n FROM t").collect()) == sorted(engine.table("t", shard=True).where("__shard is not null").groupBy("__shard").count().toPandas()["count"])
    assert engine.sql("SELECT count(*) AS n FROM t").first().n == engine.tables["t"].count()  # a pinned statement leaves no trace


def test_layout_reads_less(spark, engine, tmp_path):
    """A condition on a key, identity or hashed, opens only the folders that it can touch; moves don't disturb that."""
    engine.meta.create_distribution("h", ["integer hash"])
    for i in reversed(range(4)):
        engine.meta.create_range(f"h{i}", (i << 30,), f"sh{i + 1}", "h")
    engine.meta.attach("h", Relation("u", [KeyColumn("id", "murmur")]))
    engine.register("u", spark.range(1000).toDF("id"))
    engine.lay_out("u", str(tmp_path / "u"))
    engine.register("t", engine.tables["t"])
    engine.lay_out("t", str(tmp_path / "t"))
    movement.move(engine, "k1", "sh4")
    for df, wanted in ((engine.where("u", "id = 77"), [77]), (engine.sql("SELECT id FROM u WHERE id = 77"), [77]), (engine.where("t", "id = 150").select("id"), [150]), (engine.sql("SELECT a.id FROM t a JOIN t b ON a.id = b.id WHERE b.id = 150"), [150])):
        assert [r.id for r in df.collect()] == wanted
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(__key_range" in plan or "PartitionFilters: [__key_range" in plan or "PartitionFilters: [((__key_range" in plan, plan
        scans = [n for n in plan.split("\n") if "FileScan" in n]
        files = {len(x) for x in [df.inputFiles()]}
        assert scans and max(files) >= 1
    assert engine.sql("SELECT count(*) AS n FROM t").first().n == 47
    assert engine.where("t", "id < 0").count() == 2  # rows without a range are read, too


def test_rules_of_modification(spark, engine):
    engine.sql("DELETE FROM t WHERE id < 0 OR id IS NULL")
    before = engine.tables["t"].count()
    assert engine.sql("UPDATE t SET j = 1 WHERE id < 100").first().result == f"UPDATE {engine.where('t', 'id < 100').count()}"
    with pytest.raises(MetadataError, match="no key range"):
        engine.sql("UPDATE t SET id = -5 WHERE id = 10")
    engine.meta.create_unique_index("i", "t", ["s"], ["varchar hashed"])
    with pytest.raises(MetadataError, match="violated"):
        engine.sql("UPDATE t SET s = 'same'")
    with pytest.raises(MetadataError, match="violated"):
        engine.sql("UPDATE t SET s = 'v99' WHERE id = 10")
    engine.sql("UPDATE t SET s = s WHERE id = 10")
    assert engine.sql("INSERT INTO t (id, s) VALUES (700, 'n'), (700, 'n'), (110, 'z') ON CONFLICT (id) DO NOTHING RETURNING id").collect() == [(700,)]
    with pytest.raises(MetadataError, match="twice"):
        engine.sql("INSERT INTO t (id, j) VALUES (701, 1), (701, 2) ON CONFLICT (id) DO UPDATE SET j = excluded.j")
    assert engine.tables["t"].count() == before + 1
    engine.sql("PREPARE p AS SELECT 'x $1' AS a, $1 AS b")
    assert engine.sql("EXECUTE p(5)").first()[:] == ("x $1", 5)
    with pytest.raises(MetadataError, match="parameters"):
        engine.sql("EXECUTE p(5, 6)")


def test_statistics(engine):
    with pytest.raises(ValueError):
        engine.sql("/* default_route_behaviour: BLOCK */ SELECT * FROM t")
    assert [tuple(r) for r in engine.console("SHOW errors").collect()] == [("DispatchError", "1")]
    engine.console("LOCK KEY RANGE k0; UNLOCK KEY RANGE k0")
    assert engine.console("SHOW mean_key_range_lock_time").first()[0] != "0s"
    assert engine.console("SHOW time_quantiles WHERE quantile_type = 'router_time_0.9999'").first().time_ms != "0.00"
    assert [len(p) for p in engine.portal("SELECT * FROM c", 3)] == [3, 3, 2]


def test_console(engine):
    with pytest.raises(SyntaxProblem):
        engine.console("ADD KEY RANGE x FROM 1 ROUTE TO sh1")
    with pytest.raises(SyntaxProblem, match="does not exist"):
        engine.console("SHOW shards (nope)")
    with pytest.raises(SyntaxProblem):
        engine.console("CREATE KEY RANGE x FROM 1 ROUTE TO sh1 FOR DISTRIBUTION d NONSENSE")
    engine.console("CREATE SHARD sh5; CREATE DISTRIBUTION u (uuid hash); CREATE KEY RANGES FOR DISTRIBUTION u USING SHARDS sh1, sh5")
    assert [r.lower_bound for r in engine.console("SHOW key_ranges WHERE distribution_id = u ORDER BY shard_id").collect()] == ["2147483647", "0"]
    engine.console("CREATE RELATION x (id HASH murmur) FOR DISTRIBUTION u; ALTER RELATION x SCHEMA s; ALTER RELATION x RENAME DISTRIBUTION COLUMN id TO key")
    assert engine.console("SHOW relations WHERE relation_name = x").first().schema_name == "s"
    engine.console("CREATE REFERENCE TABLE z AUTO INCREMENT id START 19 ON SHARDS sh1, sh2; ALTER REFERENCE TABLE z STORAGE TO (sh3); SYNC REFERENCE TABLE z ON sh1")
    assert engine.console("SHOW reference_relations WHERE table_name = z").first().shards == "sh3,sh1"
    engine.console("ALTER SHARD sh5 OPTIONS (SET a 1, ADD b 2, DROP a)")
    assert engine.console("SHOW shards_extended WHERE shard = sh5").first().options == "b=2"
    engine.console("CREATE UNIQUE INDEX i ON x COLUMNS (v VARCHAR HASH)")
    assert engine.console("SHOW unique_indexes").first().column_types == "varchar hashed"
    with pytest.raises(MetadataError, match="CASCADE"):
        engine.console("DROP DISTRIBUTION u")
    engine.console("DROP DISTRIBUTION u CASCADE; DROP UNIQUE INDEX i; DROP REFERENCE TABLE z")
    for target in ("version", "users", "task_groups", "move_tasks", "sequences", "errors", "file_settings", "time_quantiles", "prepared_statements", "hosts", "routers"):
        engine.console(f"SHOW {target}").collect()
    assert engine.console("HELP").count() > 10


def test_modification(spark, engine):
    with pytest.raises(MetadataError, match="no key range"):
        dml.insert(engine, "t", spark.createDataFrame([(-5,)], "id long"))
    engine.register("t", engine.tables["t"].where("id >= 0"))
    dml.insert(engine, "t", spark.createDataFrame([(1000,)], "id long"))
    assert engine.where("t", "id = 1000", shard=True).first()["__shard"] == "sh4"
    dml.upsert(engine, "t", spark.createDataFrame([(1000, 5, "new"), (1001, 6, "in")], "id long, j long, s string"), ["id"], {"s": F.col("new.s")})
    assert {(r.id, r.j, r.s) for r in engine.where("t", "id >= 1000").collect()} == {(1000, None, "new"), (1001, 6, "in")}
    dml.update(engine, "t", {"id": F.col("id") + 1}, F.col("s").isNull() & (F.col("id") == 0))
    assert engine.where("t", "id = 1").count() == 1
    before = engine.tables["t"].count()
    dml.delete(engine, "t", F.col("s") == "v99")
    assert engine.tables["t"].count() == before - 1  # null conditions keep rows
    engine.meta.create_unique_index("i", "t", ["id"], ["integer"])
    with pytest.raises(MetadataError, match="violated"):
        dml.insert(engine, "t", spark.createDataFrame([(1000,)], "id long"))
    assert set(dml.index_table(engine, "i").columns) == {"id", "__shard"}
    dml.truncate(engine, "t")
    assert engine.tables["t"].isEmpty()


def test_copy(spark, engine):
    lines = spark.createDataFrame([("110|'x|y",), ("\\.",), ("5|\\N",)], "value string")
    got = {(r.id, r.j, r["__shard"]) for r in copy.copy_from(engine, "t", spark.createDataFrame([("110|3",), ("\\.",), ("5|\\N",)], "value string"), ["id", "j"], delimiter="|").collect()}
    assert got == {(110, 3, "sh2"), (5, None, "sh1")} and lines.count() == 3
    with pytest.raises(MetadataError, match="column offset"):
        copy.copy_from(engine, "t", lines, ["j"], delimiter="|")


def test_streaming_copy(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(5,), (150,), (-1,)], "id long").write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    streaming.load(stream, engine.meta, "t", str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination()
    assert {(r.id, r["__shard"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(5, "sh1"), (150, "sh2")}
    assert spark.read.parquet(str(tmp_path / "bad")).first().id == -1


def test_redistribution_resumes(spark, engine):
    engine.register("t", spark.range(100, 200).toDF("id"))
    engine.meta.detach("two", "c")
    task = movement.redistribute(engine, "k1", "sh4", 30, check=True)
    assert task.state == "CHECKED" and engine.meta.range("k1").shard == "sh2"
    made = movement.Task("tg", "k1", "sh4", "k1_sh4", 30)
    engine.meta.tasks["tg"] = made
    movement.resume(engine, made, most=1)
    assert made.state == "MOVING" and engine.table("t", shard=True).where("__shard = 'sh4'").count() == 30
    movement.resume(engine, made)
    assert made.state == "COMPLETE" and engine.meta.range("k1").shard == "sh4" and engine.meta.range("k1").lower == (100,)
    assert [len(made.moves), movement.redistribute(engine, "k1", "sh4", 30).state] == [4, "COMPLETE"]
    with pytest.raises(MetadataError):
        movement.redistribute(engine, "k1", "sh1", 0)
    later = movement.redistribute(engine, "k1", "sh1", 30, later=True)
    movement.resume(engine, later, most=2)
    engine.console("STOP TASK GROUP ALL")
    assert later.state == "STOPPED" and engine.table("t", shard=True).where("__shard = 'sh1'").count() == 60
    engine.console("RETRY TASK GROUP ALL")
    assert later.state == "COMPLETE" and engine.table("t", shard=True).where("__shard = 'sh1'").count() == 100


def test_balance():
    loads = [("k1", "a", "d", 100, {"cpu": 100.0, "space": 10.0}), ("k2", "b", "d", 10, {"cpu": 55.0, "space": 0.0}), ("k3", "c", "d", 5, {"cpu": 1.0, "space": 0.0})]
    step = movement.balance(loads, {"cpu": 60.0, "space": 100.0})
    assert (step.shard, step.keys, step.join) == ("c", 40, "none")
    assert movement.balance(loads, {"cpu": 200.0, "space": 100.0}) is None
    assert movement.balance([loads[0], ("k2", "b", "d", 1, {"cpu": 55.0})], {"cpu": 60.0, "space": 100.0}).keys == 5


def test_sql_statements(engine):
    q = lambda text: [tuple(r) for r in engine.sql(text).collect()]
    engine.sql("DELETE FROM t WHERE id < 0 OR id IS NULL")
    assert q("INSERT INTO t (id, s) VALUES (500, 'a, (b'), (501, NULL) RETURNING id, j") == [(500, None), (501, None)]
    assert q("UPDATE t SET j = id + 1, s = concat(s, '!') WHERE id = 500 RETURNING j, s") == [(501, "a, (b!")]
    engine.sql("INSERT INTO t (id, j, s) VALUES (500, 7, 'x'), (502, 8, 'y') ON CONFLICT (id) DO UPDATE SET j = excluded.j + t.j")
    assert q("SELECT id, j, s FROM t WHERE id >= 500 ORDER BY id") == [(500, 508, "a, (b!"), (501, None, None), (502, 8, "y")]
    engine.sql("INSERT INTO t SELECT id + 1000, j, s FROM t WHERE id = 502")
    assert q("DELETE FROM t WHERE id > 1000 RETURNING id") == [(1502,)]
    engine.sql("SET __x__.allow_split_update = off")
    engine.sql("UPDATE t SET id = id WHERE id = 500")
    with pytest.raises(MetadataError, match="key columns"):
        engine.sql("UPDATE t SET id = j")
    engine.sql("PREPARE p (int) AS SELECT id FROM t WHERE id = $1 OR s = $2")
    assert q("EXECUTE p(501, 'none')") == [(501,)]
    engine.sql("DEALLOCATE p")
    with pytest.raises(MetadataError):
        engine.sql("EXECUTE p(1, 2)")
    engine.sql("BEGIN")
    engine.sql("SET auto_distribution = d; ".rstrip("; "))
    engine.sql("SET distribution_key TO 'k'")
    engine.sql("CREATE TABLE fresh (k INT PRIMARY KEY, v VARCHAR(10) NOT NULL, w double precision, PRIMARY KEY (k))")
    engine.sql("INSERT INTO fresh VALUES (150, 'x', 1.5)")
    assert engine.table("fresh", shard=True).first()["__shard"] == "sh2" and dict(engine.tables["fresh"].dtypes) == {"k": "int", "v": "string", "w": "double"}
    engine.sql("TRUNCATE fresh")
    engine.sql("DROP TABLE fresh")
    engine.sql("DROP TABLE IF EXISTS fresh")
    assert q("SELECT __x__route_key('d', '150')") == [("sh2",)] and ("sh4",) in q("SELECT __x__shards()")
    assert q("SELECT * FROM __x__show('shards')")[0] == ("sh1",) and q("SELECT __x__is_ready()") == [(True,)]
    assert engine.sql("SELECT * FROM __x__ctid('t')").columns[0] == "shard"
    assert q("SELECT pg_is_in_recovery() AS r") == [(False,)]
    before = engine.tables["ref"].count()
    log = engine.spark.createDataFrame([(1, "INSERT INTO ref VALUES (7, 'z')"), (0, "SELECT 1")], "n long, statement string")
    assert engine.replay(log) == 2 and engine.tables["ref"].count() == before + 1
    assert engine.workload().where("statement = 'BEGIN'").count() == 1


def test_exact_quantiles_by_brute_force(spark):
    """Equal to Spark's own on any numbers; no aggregate holds a group's values, and groups of nulls alone have null quantiles."""
    rng, shares, inf = random.Random(3), [0.0, 0.1, 0.5, 0.75, 0.99, 1.0], float("inf")
    odd = [inf, -inf, float("nan"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, None, None]
    rows = [("near", 1 + i * 2.0**-52) for i in range(1000)] + [("same", 7.25)] * 1000 + [("nulls", None)] * 5 + [(None, float(i)) for i in range(10)] + [("one", -3.5)]
    rows += [("wide", rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300)) for _ in range(1000)] + [("odd", v) for v in odd * 5] + [("even", float(i % 100)) for i in range(999)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = F.array(*map(F.lit, shares))
    known = {r.g: r.v or [None] * len(shares) for r in df.groupBy("g").agg(F.percentile("v", points).alias("v")).collect()}
    found = stats.quantiles(df, "v", shares, exact=True, by=["g"])
    assert {(r.g, r.quantile): repr(r.value) for r in found.collect()} == {(g, q): repr(v + 0.0 if v == 0 else v) for g, vs in known.items() for q, v in zip(shares, vs, strict=True)}
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    for g in ("odd", "wide"):
        one = stats.quantiles(df.where(F.col("g").eqNullSafe(F.lit(g))), "v", shares, exact=True).collect()
        assert {r.quantile: repr(r.value) for r in one} == {q: repr(v + 0.0 if v == 0 else v) for q, v in zip(shares, known[g], strict=True)}, g
    assert stats.quantiles(df.where("false"), "v", shares, exact=True).count() == 0
    assert stats.quantiles(df.selectExpr("g", "cast(NULL as double) v"), "v", [0.5], exact=True).collect() == [(0.5, None)]
