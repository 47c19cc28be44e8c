"""The engine: sharded tables over DataFrames, pruned queries, hints and metadata statements."""

from __future__ import annotations

import copy
import functools
import itertools
import re
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators.routing import range_condition, with_shard
from rangeloom.plans import analysis, dispatch, pruning, statements
from rangeloom.plans.model import Metadata, MetadataError
from rangeloom.plans.statistics import Statistics
from rangeloom.plans.syntax import OTHER, hints, predicate, truth


class Engine:
    """Tables and metadata of one session."""

    def __init__(self, spark: SparkSession, meta: Metadata | None = None):
        self.spark, self.meta = spark, meta or Metadata()
        self.tables: dict[str, DataFrame] = {}
        self.prepared: dict[str, str] = {}
        self.log: deque[str] = deque(maxlen=10_000)
        self.settings = {"default_route_behaviour": "ALLOW", "allow_postprocessing": "on"}
        self.layouts: dict[str, tuple[DataFrame, Metadata]] = {}
        self.statistics = Statistics()

    # tables

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """Makes a DataFrame known under a relation's name; a distributed relation must have its key columns."""
        try:
            _, relation = self.meta.of(name)
        except MetadataError:
            relation = None
        if relation is not None:
            wanted = {c for k in relation.key for c in ([p for p, _ in k.parts] or [k.name])}
            if missing := wanted - set(df.columns):
                raise MetadataError(f"table {name} lacks key columns {sorted(missing)}")
        self.tables[name] = df
        self.layouts.pop(name, None)
        return df

    def bind(self, name: str, df: DataFrame | None = None) -> None:
        """Makes a table, or some of its rows, visible to statements; plans keep what they were made with."""
        df = self.tables[name] if df is None else df
        df.createOrReplaceTempView(name)

    def _named(self, statement: str) -> list[str]:
        words = set(re.findall(r"\w+", statement.lower()))
        return [n for n in self.tables if n.lower() in words]

    def lay_out(self, name: str, path: str) -> DataFrame:
        """Writes a distributed table in one folder a key range. Later reads with a condition on the key, hashed ones too, open
        only the folders that the condition can touch; the ranges as they are now stay the folders' names."""
        rows = with_shard(self.tables[name], self.meta, name, key_range=True).drop("__shard")
        rows.repartition("__key_range", F.pmod(F.xxhash64(*self.tables[name].columns[:2]), F.lit(8))).write.partitionBy("__key_range").parquet(path)
        return self.open_layout(name, path)

    def open_layout(self, name: str, path: str) -> DataFrame:
        """Registers a table that ``lay_out`` has written; the key ranges must be those it was written with."""
        df = self.spark.read.parquet(path)
        self.register(name, df.drop("__key_range"))
        self.layouts[name] = df, copy.deepcopy(self.meta)
        return self.tables[name]

    def _touched(self, name: str, tree) -> DataFrame | None:
        """The part of a laid-out table that a condition can touch: rows without a range and those of some folders."""
        if name not in self.layouts:
            return None
        df, meta = self.layouts[name]
        ranges = meta.sorted_ranges(meta.of(name)[0].id)
        kept = [r.id for r in pruning.ranges(meta, name, tree)]
        if len(kept) == len(ranges):
            return None
        key_range = F.col("__key_range")
        return df.where(key_range.isin(kept) | key_range.isNull()).drop("__key_range")

    def table(self, name: str, shard: bool = False, key_range: bool = False, keys: bool = False) -> DataFrame:
        df = self.tables[name]
        return df if name in self.meta.references or not (shard or key_range or keys) else with_shard(df, self.meta, name, key_range, keys)

    def reference(self, name: str) -> DataFrame:
        """A reference table; hinted for a broadcast join if the plan's statistics say that it is small."""
        df = self.tables[name]
        most = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df

    def where(self, name: str, text: str, shard: bool = False) -> DataFrame:
        """Rows of a table that meet a condition, read from the key ranges the condition can touch."""
        tree = predicate(text)
        df = self._touched(name, tree)
        extra = pruning.condition(self.meta, name, tree) if df is None else None
        df = self.tables[name] if df is None else df
        df = df.where(text) if extra is None else df.where(extra & F.expr(text))
        return with_shard(df, self.meta, name) if shard else df

    def on_shards(self, name: str, shards: list[str]) -> DataFrame:
        """Rows of some shards: a condition on the key where it is stored in key order, on the hash otherwise."""
        d, r = self.meta.of(name)
        own = [x for x in self.meta.sorted_ranges(d.id) if x.shard in shards]
        if all(c.method == "identity" for c in r.key) and "uuid" not in d.kinds:
            out = F.lit(False)
            for x in own:
                out = out | range_condition(self.meta, name, x.id)
            return self.tables[name].where(out)
        return with_shard(self.tables[name], self.meta, name).where(F.col("__shard").isin(shards)).drop("__shard")

    def provenance(self, name: str) -> DataFrame:
        """All rows of a table, each with the shard it lives on in front."""
        df = with_shard(self.tables[name], self.meta, name)
        return df.select(F.concat(F.lit("shard "), "__shard").alias("shard"), *(c for c in df.columns if c != "__shard"))

    # plans

    def _scan_plan(self, name: str, tree) -> object:
        if name in self.meta.references:
            return dispatch.AnyShard(frozenset(self.meta.references[name].shards))
        if name not in self.tables:
            raise MetadataError(f"table {name} is not known")
        if not self._distributed(name):
            return dispatch.Virtual()
        shards = [r.shard for r in pruning.ranges(self.meta, name, tree)]
        return dispatch.of_shards(shards, list(self.meta.shards)) if shards else dispatch.Virtual()

    def dispatch(self, name: str, text: str = "") -> object:
        """The dispatch plan of a filtered scan."""
        return self._scan_plan(name, predicate(text) if text else OTHER)

    def statement_plan(self, statement: str, args=None, scatter: bool = False) -> tuple[object, list]:
        """The dispatch plan of a whole query, combined from those of all tables it reads, and these scans."""
        found = analysis.scans(self._query(statement, args), self.tables)
        plan = dispatch.Virtual()
        for scan in found:
            plan = dispatch.combine(plan, self._scan_plan(scan.table, OTHER if scatter else scan.tree))
        return plan, found

    def route(self, distribution: str, *values, relation: str | None = None) -> str:
        """The shard of a key."""
        d = self.meta.distribution(distribution)
        return self.meta.locate(d, self.meta.key_of(d, d.relations[relation] if relation else None, values)).shard

    def route_key(self, distribution: str, *values) -> DataFrame:
        return self.spark.createDataFrame([(self.route(distribution, *values),)], "shard_id string")

    # statements

    def set(self, name: str, value: str) -> None:
        self.settings[name.lower()] = value

    def sql(self, text: str, args=None) -> DataFrame:
        """A query with comment hints. Hints outrank the session's settings; results are global unless the shard is forced."""
        found, statement = hints(text)
        self.log.append(statement)
        with self.statistics.timed(self.statistics.router):
            done = statements.run(self, statement) if args is None else None
            return done if done is not None else self._routed(statement, found, args)

    def _catalog(self, statement: str) -> str | None:
        """A statement over information_schema, with its relations bound; it can't read user tables as well."""
        if not re.search(r"\binformation_schema\s*\.", statement, re.I):
            return None
        from rangeloom.sources import remote

        outside = re.sub(r"'(?:[^']|'')*'", "''", statement)
        if used := set(re.findall(r"\w+", re.sub(r"\binformation_schema\s*\.\s*\w+", "", outside, flags=re.I).lower())) & {n.lower() for n in self.tables}:
            raise MetadataError(f"catalog relations can't be read together with {sorted(used)}")
        for name, rows in (("tables", remote.tables), ("columns", remote.columns)):
            rows(self).createOrReplaceTempView(f"__catalog_{name}")
        return re.sub(r"\binformation_schema\s*\.\s*(tables|columns)\b", lambda m: f"__catalog_{m[1].lower()}", statement, flags=re.I)

    def _routed(self, statement: str, found: dict[str, str], args=None) -> DataFrame:
        if (catalog := self._catalog(statement)) is not None:
            return self.spark.sql(catalog)
        statement = statements.literals(self, statement)
        settings = self.settings | found
        if "execute_on" in settings:
            self.meta.shard(settings["execute_on"])
            return self._pinned(statement, [settings["execute_on"]], args)
        if "sharding_key" in settings:
            relation = settings.get("distributed_relation")
            d = self.meta.of(relation)[0].id if relation else settings.get("distribution")
            return self._pinned(statement, [self.route(d, settings["sharding_key"], relation=relation)], args)
        names = self._named(statement)
        local, behaviour = not truth(settings.get("allow_postprocessing", "on")), settings.get("default_route_behaviour", "ALLOW")
        explained = re.match(r"\s*explain\s+(?!extended|formatted|codegen|cost)", statement, re.I)
        if not (explained or local or behaviour.upper() != "ALLOW" or any(n in self.layouts for n in names)):
            return self._query(statement, args)  # nothing depends on the shards: results are global, Spark prunes by its own means
        if explained:
            statement = statement[explained.end() :]
        plan, found = self.statement_plan(statement, args, truth(settings.get("scatter_query", "off")))
        shards = dispatch.finalize(plan, list(self.meta.shards), behaviour)
        if explained:
            return self.spark.createDataFrame([(type(plan).__name__, s) for s in shards] or [(type(plan).__name__, None)], "plan string, shard_id string")
        if isinstance(plan, dispatch.Scatter) and len(shards) == 1:
            return self._pinned(statement, shards, args)
        if local and len(shards) > 1:  # each shard answers for itself
            return functools.reduce(DataFrame.unionAll, [self._pinned(statement, [s], args) for s in shards])
        parts = {}
        for scan in found:
            parts.setdefault(scan.table, []).append(scan.tree)
        cut = {n: self._touched(n, functools.reduce(lambda a, b: ("or", a, b), trees)) for n, trees in parts.items()}
        return self._query(statement, args, {n: df for n, df in cut.items() if df is not None})

    def _distributed(self, name: str) -> bool:
        return any(name in d.relations for d in self.meta.distributions.values())

    def _query(self, statement: str, args=None, instead: dict[str, DataFrame] | None = None) -> DataFrame:
        """Runs Spark's analysis with the tables, or others in their place, under their names."""
        for name in self._named(statement):
            self.bind(name, (instead or {}).get(name))
        return self.spark.sql(statement, args=args) if args else self.spark.sql(statement)

    def _pinned(self, statement: str, shards: list[str], args=None) -> DataFrame:
        """A statement over the rows of the given shards."""
        return self._query(statement, args, {n: self.on_shards(n, shards) for n in self._named(statement) if self._distributed(n)})

    def explain(self, name: str, text: str = "") -> DataFrame:
        """The dispatch plan and the shards of a filtered scan, one row a shard."""
        plan = self.dispatch(name, text)
        rows = [(type(plan).__name__, s) for s in dispatch.finalize(plan, list(self.meta.shards))]
        return self.spark.createDataFrame(rows, "plan string, shard_id string")

    def shard_local(self, name: str) -> tuple[DataFrame, Column]:
        """A table with __shard, and the column to add to keys so that operators work shard by shard."""
        return with_shard(self.tables[name], self.meta, name), F.col("__shard")

    def console(self, text: str) -> DataFrame:
        from rangeloom.plans.console import Console

        return Console(self).run(text)

    def workload(self) -> DataFrame:
        """The latest statements, in order, to be kept or replayed."""
        return self.spark.createDataFrame(list(enumerate(self.log)), "n long, statement string")

    def replay(self, log: DataFrame) -> int:
        """Runs the statements of a log in their order; returns how many there were."""
        done = 0
        for row in log.orderBy("n").toLocalIterator():
            df = self.sql(row["statement"])
            with self.statistics.timed(self.statistics.shard):
                df.write.format("noop").mode("overwrite").save()
            done += 1
        return done

    def portal(self, text: str, max_rows: int, args=None):
        """A query's rows in portions of ``max_rows`` (0: all at once), fetched from one partition after the other."""
        rows = self.sql(text, args).toLocalIterator()
        while part := list(itertools.islice(rows, max_rows or None)):
            yield part

    def prepare(self, text: str):
        """A statement with named or positional parameters, to be run with their values."""
        return lambda args=None: self.sql(text, args)
