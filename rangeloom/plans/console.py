"""The console dialect: statements that change metadata, and SHOW relations that read it as DataFrames of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.hashing import murmur3
from rangeloom.plans import model
from rangeloom.plans.model import KeyColumn, MetadataError, Relation
from rangeloom.plans.syntax import Reader, SyntaxProblem, tokens

VERSION = "1.0"

# Columns of the SHOW relations.
HEADERS = {
    "key_ranges": ("key_range_id", "shard_id", "distribution_id", "lower_bound", "locked"),
    "key_ranges_extended": ("key_range_id", "shard_id", "distribution_id", "lower_bound", "next_lower_bound", "coverage", "locked"),
    "relations": ("relation_name", "distribution_id", "distribution_key", "schema_name"),
    "reference_relations": ("table_name", "schema_name", "schema_version", "shards", "column_sequence_mapping"),
    "distributions": ("distribution_id", "column_types", "default_shard"),
    "shards": ("shard",),
    "shards_extended": ("shard", "options"),
    "unique_indexes": ("id", "relation_name", "columns", "column_types"),
    "sequences": ("name", "value"),
    "task_groups": ("task_group_id", "destination_shard_id", "source_key_range_id", "destination_key_range_id", "batch_size", "move_task_id", "state", "message", "created_at", "updated_at"),
    "move_tasks": ("task_group_id", "move_task_id", "temporary_key_range_id", "bound", "state"),
    "task_groups_ext": ("task_group_id", "bound", "status"),
    "redistribute_tasks": ("redistribute_task_id", "task_group_id", "key_range_id", "destination_shard_id", "batch_size"),
    "time_quantiles": ("quantile_type", "time_ms"),
    "move_stats": ("statistic", "time"),
    "errors": ("error_type", "count"),
    "version": ("version",),
    "is_read_only": ("is_read_only",),
    "startup_finished": ("startup_finished",),
    "file_settings": ("name", "setting", "applied"),
    "users": ("user", "dbname", "connection_limit"),
    "mean_key_range_lock_time": ("mean_key_range_lock_time",),
    "prepared_statements": ("name", "backend_id", "hash", "query"),
    # of processes that a Spark session doesn't have: always empty
    "hosts": ("shard", "host", "alive", "rw", "time"),
    "tsa_cache": ("tsa", "host", "az", "alive", "match", "reason", "last_check_time"),
    "routers": ("router", "status", "client_connections", "version", "metadata_version"),
    "coordinator_address": ("coordinator_address",),
    "two_phase_tx": ("gid", "status", "members"),
    "dcs_storage": ("storage",),
}
ALIASES = {"task_group": "task_groups", "move_task": "move_tasks", "task_group_ext": "task_groups_ext"}

#: What each statement takes.
HELP = {
    "CREATE": "CREATE SHARD | DISTRIBUTION | KEY RANGE | KEY RANGES | RELATION | REFERENCE TABLE | UNIQUE INDEX: adds an entry to the metadata.",
    "ALTER": "ALTER DISTRIBUTION d ATTACH | DETACH RELATION, ADD | DROP DEFAULT SHARD; ALTER RELATION; ALTER REFERENCE TABLE; ALTER SHARD.",
    "DROP": "DROP SHARD | DISTRIBUTION | KEY RANGE | SEQUENCE | REFERENCE TABLE | UNIQUE INDEX | TASK GROUP name [CASCADE].",
    "SPLIT": "SPLIT KEY RANGE new FROM source BY bound: the keys from the bound on become a range of their own.",
    "UNITE": "UNITE KEY RANGE base WITH other: two neighbours on one shard become one.",
    "MOVE": "MOVE KEY RANGE name TO shard [META ONLY].",
    "REDISTRIBUTE": "REDISTRIBUTE KEY RANGE name TO shard [BATCH SIZE n] [TASK GROUP id] [CHECK | APPLY | NOWAIT].",
    "RENAME": "RENAME KEY RANGE old TO new.",
    "LOCK": "LOCK KEY RANGE name | ALL.",
    "UNLOCK": "UNLOCK KEY RANGE name | ALL.",
    "SYNC": "SYNC REFERENCE TABLE name | REFERENCE TABLES ON shard.",
    "RETRY": "RETRY TASK GROUP id | ALL: goes on from the last finished batch.",
    "STOP": "STOP [MOVE] TASK GROUP id | ALL: no further batch is begun.",
    "SHOW": "SHOW relation [(columns)] [WHERE condition] [GROUP BY columns] [ORDER BY column [ASC | DESC]].",
    "HELP": "HELP [command].",
}


def _text(value) -> str:
    return ",".join(map(str, value)) if isinstance(value, (tuple, list)) else str(value)


def _key(relation: Relation) -> str:
    def one(c: KeyColumn) -> str:
        if c.parts:
            return f"{c.method}[{','.join(f'{n} {k}' for n, k in c.parts)}]"
        return f'("{c.name}", {c.method})'

    return ",".join(map(one, relation.key))


class Console:
    """Runs statements against an engine's metadata; each gives a DataFrame."""

    def __init__(self, engine):
        self.engine, self.meta = engine, engine.meta

    def run(self, text: str) -> DataFrame:
        """One or more statements, separated by semicolons; the last one's result."""
        out, part = None, []
        for t in [*tokens(text), None]:
            if t is None or t.text == ";":
                if part:
                    out = self.statement(Reader(part))
                part = []
            else:
                part.append(t)
        if out is None:
            raise SyntaxProblem("no statement")
        return out

    def statement(self, r: Reader) -> DataFrame:
        word = r.next().text.upper()
        action = getattr(self, f"_{word.lower()}", None)
        if word == "ADD":
            raise SyntaxProblem("ADD is not supported, use CREATE")
        if action is None:
            raise SyntaxProblem(f"unknown statement {word}")
        out = action(r)
        if not r.done and word != "HELP":
            raise SyntaxProblem(f"unexpected {r.rest()!r}")
        return out if isinstance(out, DataFrame) else self.engine.spark.createDataFrame([(str(out),)], "result string")

    # pieces

    def _bound(self, r: Reader) -> tuple:
        return tuple(r.listed(lambda: r.next().value))

    def _kind(self, r: Reader) -> str:
        kind = r.name().lower()
        return f"{kind} hash" if r.take("HASH") or r.take("HASHED") else kind

    def _column(self, r: Reader) -> KeyColumn:
        name = r.name()
        if r.take("["):
            parts = tuple(r.listed(lambda: (r.name(), model.TYPES[self._kind(r)])))
            r.need("]")
            return KeyColumn(name, name.lower(), parts)
        method = r.name() if r.take("HASH", "FUNCTION") or r.take("HASH") else "identity"
        return KeyColumn(name, method)

    def _columns(self, r: Reader) -> list[KeyColumn]:
        if r.take("("):
            out = r.listed(lambda: self._column(r))
            r.need(")")
            return out
        return r.listed(lambda: self._column(r))

    def _relation_name(self, r: Reader) -> tuple[str, str]:
        name = r.name()
        schema, _, rest = name.rpartition(".")
        if r.take("SCHEMA"):
            schema = r.name()
        return schema or "public", rest

    # CREATE, ALTER, DROP

    def _create(self, r: Reader):
        m = self.meta
        if r.take("DISTRIBUTION"):
            name, kinds, shard = r.name(), [], None
            if r.take("COLUMN", "TYPES"):
                kinds = r.listed(lambda: self._kind(r))
            elif r.take("("):
                kinds = r.listed(lambda: self._kind(r))
                r.need(")")
            if r.take("DEFAULT", "SHARD"):
                shard = r.name()
            return f"distribution {m.create_distribution(name, kinds, shard).id}"
        if r.take("KEY", "RANGES"):
            d = r.name() if r.take("FOR", "DISTRIBUTION") else None
            between = shards = None
            if r.take("BETWEEN"):
                low = int(r.next().value)
                r.need("AND")
                between = (low, int(r.next().value))
            if r.take("USING", "SHARDS"):
                shards = r.listed(r.name)
            else:
                r.take("ALL", "SHARDS")
            return "key ranges " + ", ".join(x.id for x in m.equal_split(d, between, shards))
        if r.take("KEY", "RANGE"):
            name = None if r.peek("FROM") else r.name()
            r.need("FROM")
            lower = self._bound(r)
            r.need("ROUTE", "TO")
            shard = r.name()
            return f"key range {m.create_range(name, lower, shard, r.name() if r.take('FOR', 'DISTRIBUTION') else None).id}"
        if r.take("SHARD"):
            name = None if r.done or r.peek("OPTIONS") else r.name()
            return f"shard {m.create_shard(name, **self._options(r))}"
        if r.take("REFERENCE", "TABLE") or r.take("REFERENCE", "RELATION"):
            schema, name = self._relation_name(r)
            sequences, shards = {}, None
            if r.take("AUTO", "INCREMENT"):
                sequences = dict(r.listed(lambda: (r.name(), int(r.next().value) if r.take("START") else 0)))
            if r.take("ON", "SHARDS") or r.take("ON"):
                shards = r.listed(r.name)
            ref = m.create_reference(name, shards, sequences)
            ref.schema = schema
            return f"reference table {name}"
        if r.take("UNIQUE", "INDEX"):
            name = r.name()
            r.need("ON")
            _, relation = self._relation_name(r)
            r.take("COLUMNS")
            wrapped = r.take("(")
            columns = r.listed(lambda: (r.name(), model.TYPES[self._kind(r)]))
            if wrapped:
                r.need(")")
            m.create_unique_index(name, relation, [c for c, _ in columns], [k for _, k in columns])
            return f"unique index {name}"
        r.take("DISTRIBUTED")
        if r.take("RELATION") or r.take("TABLE"):
            schema, name = self._relation_name(r)
            r.take("DISTRIBUTION", "KEY")
            key = self._columns(r)
            d = r.name() if r.take("FOR", "DISTRIBUTION") or r.take("IN") else None
            m.attach(d, Relation(name, key, schema))
            return f"relation {name}"
        raise SyntaxProblem(f"can't create {r.rest()!r}")

    def _options(self, r: Reader) -> dict:
        out = {}
        if r.take("OPTIONS"):
            r.need("(")
            for key, value in r.listed(lambda: (r.name(), r.next().value)):
                out[key] = str(value)
            r.need(")")
        r.take("FORCE")
        return out

    def _alter(self, r: Reader):
        m = self.meta
        if r.take("DISTRIBUTION"):
            d = r.name()
            if r.take("ATTACH", "RELATION"):
                schema, name = self._relation_name(r)
                r.take("DISTRIBUTION", "KEY")
                m.attach(d, Relation(name, self._columns(r), schema))
            elif r.take("DETACH", "RELATION"):
                m.detach(d, r.name())
            elif r.take("ADD", "DEFAULT", "SHARD"):
                m.add_default_shard(d, r.name())
            elif r.take("DROP", "DEFAULT", "SHARD"):
                m.drop_default_shard(d)
            else:
                raise SyntaxProblem(f"can't alter {r.rest()!r}")
            return f"distribution {d}"
        if r.take("REFERENCE", "TABLE"):
            name = r.name()
            r.need("STORAGE", "TO", "(")
            shards = r.listed(r.name)
            r.need(")")
            if name not in m.references:
                raise MetadataError(f'reference table "{name}" not found')
            m.references[name].shards = [m.shard(s) for s in shards]
            m.references[name].version += 1
            return f"reference table {name}"
        if r.take("SHARD"):
            name = m.shard(r.name())
            r.need("OPTIONS", "(")
            while not r.take(")"):
                action = r.next().text.upper()
                key = r.name()
                if action == "DROP":
                    m.shards[name].pop(key, None)
                elif action in ("SET", "ADD"):
                    m.shards[name][key] = str(r.next().value)
                else:
                    raise SyntaxProblem(f"unknown option action {action}")
                r.take(",")
            return f"shard {name}"
        r.need("RELATION")
        name = r.name().rpartition(".")[2]
        d, relation = m.of(name)
        if r.take("DISTRIBUTION", "KEY"):
            key = self._columns(r)
            m.check_key(d, key)
            relation.key = key
        elif r.take("SCHEMA"):
            relation.schema = r.name()
        else:
            r.need("RENAME", "DISTRIBUTION", "COLUMN")
            old = r.name()
            r.need("TO")
            new = r.name()
            hits = [c for c in relation.key if c.name == old]
            if not hits:
                raise MetadataError(f'column "{old}" is not in the key of "{name}"')
            hits[0].name = new
        return f"relation {name}"

    def _drop(self, r: Reader):
        m = self.meta

        def gone(store: dict, what: str, name: str):
            if name not in store:
                raise MetadataError(f'{what} "{name}" not found')
            del store[name]

        if r.take("KEY", "RANGE"):
            name = r.name()
            if name.upper() == "ALL":
                m.ranges.clear()
                for d in m.distributions.values():
                    d.default_shard = None
            else:
                if m.range(name).locked:
                    raise MetadataError(f'key range "{name}" is locked')
                gone(m.ranges, "key range", name)
        elif r.take("DISTRIBUTION"):
            name = r.name()
            d = m.distribution(name)
            own = [x.id for x in m.sorted_ranges(name)]
            if (own or d.relations) and not r.take("CASCADE"):
                raise MetadataError(f'distribution "{name}" is in use, drop with CASCADE')
            for x in own:
                del m.ranges[x]
            del m.distributions[name]
        elif r.take("SHARD"):
            name = r.name()
            used = [x for x in m.ranges.values() if x.shard == name]
            if used and not r.take("CASCADE"):
                raise MetadataError(f'shard "{name}" has key ranges, drop with CASCADE')
            for x in used:
                del m.ranges[x.id]
            gone(m.shards, "shard", name)
        elif r.take("SEQUENCE"):
            gone(m.sequences, "sequence", name := r.name())
        elif r.take("REFERENCE", "TABLE") or r.take("REFERENCE", "RELATION"):
            gone(m.references, "reference table", name := r.name())
        elif r.take("UNIQUE", "INDEX"):
            gone(m.indexes, "unique index", name := r.name())
        elif r.take("TASK", "GROUP") or r.take("REDISTRIBUTE", "TASK") or r.take("MOVE", "TASK"):
            gone(m.tasks, "task", name := r.name())
        else:
            raise SyntaxProblem(f"can't drop {r.rest()!r}")
        r.take("CASCADE")
        return f"dropped {name}"

    # key ranges

    def _split(self, r: Reader):
        r.need("KEY", "RANGE")
        new = r.name()
        r.need("FROM")
        source = r.name()
        r.need("BY")
        return f"key range {self.meta.split(new, source, self._bound(r)).id}"

    def _unite(self, r: Reader):
        r.need("KEY", "RANGE")
        base = r.name()
        r.need("WITH")
        return f"key range {self.meta.unite(base, r.name()).id}"

    def _move(self, r: Reader):
        r.need("KEY", "RANGE")
        name = r.name()
        r.need("TO")
        shard = r.name()
        from rangeloom.operators.movement import move

        if r.take("META", "ONLY"):
            return f"key range {self.meta.move(name, shard).id}"
        return f"key range {move(self.engine, name, shard).id}"

    def _rename(self, r: Reader):
        r.need("KEY", "RANGE")
        old = r.name()
        r.need("TO")
        return f"key range {self.meta.rename(old, r.name()).id}"

    def _lock(self, r: Reader, on: bool = True):
        r.need("KEY", "RANGE")
        self.meta.lock(name := r.name(), on)
        for x in list(self.meta.ranges) if name.upper() == "ALL" else [name]:
            self.engine.statistics.lock(x, on)
        return f"key range {name}"

    def _unlock(self, r: Reader):
        return self._lock(r, False)

    def _redistribute(self, r: Reader):
        from rangeloom.operators.movement import redistribute

        r.need("KEY", "RANGE")
        name = r.name()
        r.need("TO")
        shard, batch, group, check, later = r.name(), 500, None, False, False
        while not r.done:
            if r.take("BATCH", "SIZE"):
                batch = int(r.next().value)
            elif r.take("TASK", "GROUP"):
                group = r.name()
            elif r.take("CHECK"):
                check = True
            elif r.take("NOWAIT"):
                later = True
            elif not r.take("APPLY"):
                raise SyntaxProblem(f"unexpected {r.rest()!r}")
        return f"task {redistribute(self.engine, name, shard, batch, group, check, later).id}"

    def _sync(self, r: Reader):
        everything = r.take("REFERENCE", "TABLES")
        names = list(self.meta.references) if everything else [r.name() for _ in range(1) if r.take("REFERENCE", "TABLE")]
        r.need("ON")
        shard = self.meta.shard(r.name())
        for n in names:
            ref = self.meta.references[n]
            if shard not in ref.shards:
                ref.shards.append(shard)
        return f"synchronised {len(names)}"

    def _retry(self, r: Reader):
        from rangeloom.operators.movement import resume

        r.need("TASK", "GROUP")
        name = r.name()
        for task in [t for t in self.meta.tasks.values() if name.upper() in ("ALL", t.id.upper())]:
            resume(self.engine, task)
        return f"task group {name}"

    def _stop(self, r: Reader):
        r.take("MOVE")
        r.need("TASK", "GROUP")
        name = r.name()
        for task in self.meta.tasks.values():
            if name.upper() in ("ALL", task.id.upper()) and task.state != "COMPLETE":
                task.state = "STOPPED"
        return f"task group {name}"

    def _help(self, r: Reader):
        if r.done:
            return self.engine.spark.createDataFrame([(w,) for w in sorted(HELP)], "command string")
        word = " ".join(t.text.upper() for t in r.items[r.at :])
        if word not in HELP:
            raise SyntaxProblem(f"no help for {word}")
        return self.engine.spark.createDataFrame([(HELP[word],)], "help string")

    # SHOW

    def rows(self, target: str) -> list[tuple]:
        m = self.meta
        if target in ("key_ranges", "key_ranges_extended"):
            out = []
            for d in m.distributions:
                own = m.sorted_ranges(d)
                for i, x in enumerate(own):
                    more = (_text(own[i + 1].lower) if i + 1 < len(own) else "+inf", m.coverage(x)) if target.endswith("extended") else ()
                    out.append((x.id, x.shard, x.distribution, _text(x.lower), *more, str(x.locked).lower()))
            return out
        if target == "relations":
            return sorted((x.name, d.id, _key(x), x.schema) for d in m.distributions.values() for x in d.relations.values())
        if target == "reference_relations":
            return sorted((x.name, x.schema, str(x.version), _text(x.shards), ",".join(f"{c}->{s}" for c, s in x.sequences.items())) for x in m.references.values())
        if target == "distributions":
            return [(d.id, _text(d.kinds), d.default_shard or "not exists") for d in m.distributions.values()]
        if target == "shards":
            return [(s,) for s in m.shards]
        if target == "shards_extended":
            return [(s, ",".join(f"{k}={v}" for k, v in o.items())) for s, o in m.shards.items()]
        if target == "unique_indexes":
            return [(x.id, x.relation, _text(x.columns), _text(x.kinds)) for x in m.indexes.values()]
        if target == "sequences":
            return [(n, str(v)) for n, v in m.sequences.items()]
        if target == "task_groups":
            return [(t.id, t.shard, t.source, t.target, str(t.batch), t.moves[-1]["id"] if t.moves else "", t.state, t.message, "", "") for t in m.tasks.values()]
        if target == "move_tasks":
            return [(t.id, x["id"], x["range"], _text(x["bound"]), x["state"]) for t in m.tasks.values() for x in t.moves]
        if target == "task_groups_ext":
            return [(t.id, _text(x["bound"]), "USED" if x["state"] == "COMPLETE" else "") for t in m.tasks.values() for x in t.moves]
        if target == "redistribute_tasks":
            return [(t.id, t.id, t.source, t.shard, str(t.batch)) for t in m.tasks.values()]
        if target == "version":
            return [(VERSION,)]
        if target == "prepared_statements":
            return [(n, "", f"{murmur3(q.encode()):08x}", q) for n, q in self.engine.prepared.items()]
        if target == "is_read_only":
            return [("false",)]
        if target == "startup_finished":
            return [("true",)]
        if target == "file_settings":
            return [(k, v, "true") for k, v in self.engine.settings.items()]
        if target == "users":
            return [(self.engine.spark.sql("SELECT current_user()").first()[0], "default", "-1")]
        return self.engine.statistics.rows(target)

    def relation(self, target: str) -> DataFrame:
        target = ALIASES.get(target.lower(), target.lower())
        if target not in HEADERS:
            raise SyntaxProblem(f"nothing to show under {target!r}")
        schema = ", ".join(f"`{c}` string" for c in HEADERS[target])
        return self.engine.spark.createDataFrame(self.rows(target), schema)

    def _show(self, r: Reader) -> DataFrame:
        """Filter, then group, then order, then project."""
        r.take("LOCAL") or r.take("GLOBAL")
        df = self.relation(r.name())
        wanted = None
        if r.take("("):
            wanted = None if r.take("*") else r.listed(r.name)
            r.need(")")
        if r.take("WHERE"):
            df = df.where(self._condition(r, df))
        if r.take("GROUP", "BY"):
            names = r.listed(r.name)
            self._known(df, names)
            df = df.groupBy(*names).agg(F.count("*").cast("string").alias("count")).orderBy(*names)
        if r.take("ORDER", "BY"):
            name = r.name()
            self._known(df, [name])
            c = F.col(name)
            descending = r.take("DESC")
            if not descending:
                r.take("ASC")
            df = df.orderBy(c.desc() if descending else c.asc())
        if wanted is not None:
            self._known(df, wanted)
            df = df.select(*wanted)
        return df

    @staticmethod
    def _known(df: DataFrame, names: list[str]) -> None:
        for n in names:
            if n not in df.columns:
                raise SyntaxProblem(f'column "{n}" does not exist')

    def _condition(self, r: Reader, df: DataFrame) -> Column:
        """Comparisons of columns with constants as texts, with AND, OR, NOT and parentheses."""

        def either():
            left = both()
            while r.take("OR"):
                left = left | both()
            return left

        def both():
            left = one()
            while r.take("AND"):
                left = left & one()
            return left

        def one():
            if r.take("NOT"):
                return ~one()
            if r.take("("):
                inner = either()
                r.need(")")
                return inner
            c, sign, value = sum_(), r.next().text, sum_()
            signs = {"=": c == value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value, "<>": c != value, "!=": c != value}
            if sign not in signs:
                raise SyntaxProblem(f"unknown operator {sign!r}")
            return signs[sign]

        def operand(first: bool):
            """A column on the left, a constant on the right of a sign; with + - * both are numbers."""
            t = r.next()
            if t.kind in ("word", "quoted") and (first or t.value in df.columns):
                self._known(df, [t.value])
                return F.col(t.value)
            return F.lit(str(t.value))

        def sum_():
            first = r.items[r.at - 1].text.upper() in ("WHERE", "AND", "OR", "NOT", "(") if r.at else True
            value = operand(first)
            while not r.done and r.items[r.at].text in ("+", "-", "*"):
                sign, more = r.next().text, operand(False)
                a, b = value.cast("double"), more.cast("double")
                value = a + b if sign == "+" else a - b if sign == "-" else a * b
            return value

        return either()
