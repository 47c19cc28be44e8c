"""SQL statements that are not queries: modification, tables, settings, prepared statements and engine functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.operators import dml
from rangeloom.plans.model import KeyColumn, MetadataError, Relation
from rangeloom.plans.syntax import SyntaxProblem, truth

_NAME = r"(?P<table>[\w.]+)"
_RETURNING = r"(?:\s+returning\s+(?P<returning>.+?))?\s*$"
_INSERT = re.compile(rf"insert\s+into\s+{_NAME}\s*(?:\((?P<columns>[\w\s,]+)\))?\s*(?P<rows>(?:values|select|with)\b.+?)(?:\s+on\s+conflict\s*\((?P<keys>[\w\s,]+)\)\s+do\s+(?P<action>nothing|update\s+set\s+(?P<sets>.+?)))?{_RETURNING}", re.I | re.S)
_UPDATE = re.compile(rf"update\s+{_NAME}\s+set\s+(?P<sets>.+?)(?:\s+where\s+(?P<where>.+?))?{_RETURNING}", re.I | re.S)
_DELETE = re.compile(rf"delete\s+from\s+{_NAME}(?:\s+where\s+(?P<where>.+?))?{_RETURNING}", re.I | re.S)
_CREATE = re.compile(rf"create\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\((?P<columns>.+)\)\s*$", re.I | re.S)
_DROP = re.compile(r"(?P<action>drop\s+table(?:\s+if\s+exists)?|truncate(?:\s+table)?)\s+(?P<table>[\w.]+)\s*$", re.I)
_SET = re.compile(r"(?:set|reset)\s+(?:session\s+|local\s+)?(?P<name>[\w.]+)(?:\s*(?:=|\bto\b)\s*(?P<value>.+?))?\s*$", re.I | re.S)
_PREPARE = re.compile(r"prepare\s+(?P<name>\w+)\s*(?:\([^)]*\))?\s+as\s+(?P<text>.+)$", re.I | re.S)
_EXECUTE = re.compile(r"execute\s+(?P<name>\w+)\s*(?:\((?P<args>.*)\))?\s*$", re.I | re.S)
_DEALLOCATE = re.compile(r"(?:deallocate(?:\s+prepare)?|discard)\s+(?P<name>\w+)\s*$", re.I)
_FUNCTION = re.compile(r"select\s+(?:\*\s+from\s+)?__[a-z]+__(?P<name>\w+)\s*\((?P<args>.*)\)\s*$", re.I | re.S)
_STRING = re.compile(r"'((?:[^']|'')*)'")
#: Strings, quoted names, and, with a group, parameters.
_OUTSIDE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\$(\d+)")

# Column types of CREATE TABLE that Spark spells differently.
TYPES = {"integer": "int", "text": "string", "uuid": "string", "varchar": "string", "numeric": "decimal(38,18)", "serial": "int", "bigserial": "bigint", "real": "float", "double precision": "double", "timestamptz": "timestamp", "bytea": "binary", "jsonb": "string", "json": "string", "int4": "int", "int8": "bigint", "int2": "smallint", "bool": "boolean"}


def _short(name: str) -> str:
    return name.rpartition(".")[2]


def split_list(text: str) -> list[str]:
    """Items between commas that stand outside parentheses and strings."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append(text[start:i])
                start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def _sets(text: str) -> dict[str, str]:
    out = {}
    for item in split_list(text):
        name, sign, value = item.partition("=")
        if not sign:
            raise SyntaxProblem(f"{item!r} is not an assignment")
        out[_short(name.strip())] = value.strip()
    return out


def _done(engine, tag: str, rows: DataFrame | None = None) -> DataFrame:
    """A command's tag, with the number of rows that it touched; they are counted when the result is read."""
    if rows is None:
        return engine.spark.createDataFrame([(tag,)], "result string")
    return rows.agg(F.concat(F.lit(f"{tag} "), F.count("*").cast("string")).alias("result"))


def _returned(rows: DataFrame, columns: str) -> DataFrame:
    return rows.selectExpr(*split_list(columns))


def _insert(engine, m: re.Match) -> DataFrame:
    name = _short(m["table"])
    target = engine.tables[name]
    rows = engine.spark.sql(f"SELECT * FROM {m['rows']}") if m["rows"].lower().startswith("values") else engine.sql(m["rows"])
    columns = [c.strip() for c in m["columns"].split(",")] if m["columns"] else target.columns[: len(rows.columns)]
    if len(columns) != len(rows.columns):
        raise SyntaxProblem(f"{len(columns)} columns, but {len(rows.columns)} values")
    rows = rows.toDF(*columns)
    if not m["action"]:
        rows = dml.insert(engine, name, rows)
        return _returned(rows, m["returning"]) if m["returning"] else _done(engine, "INSERT 0", rows)
    keys = [k.strip() for k in m["keys"].split(",")]
    rows = rows.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) if c in columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    changes = {}
    if m["sets"]:
        for c, text in _sets(m["sets"]).items():
            text = re.sub(r"\bexcluded\.", "new.", text, flags=re.I)
            changes[c] = F.expr(re.sub(rf"\b{name}\.", "old.", text))
    nothing, there = m["action"].lower() == "nothing", target.select(*keys)
    dml.upsert(engine, name, rows, keys, changes, nothing)
    now = engine.tables[name].join(rows.select(*keys), keys, "left_semi")
    if nothing:
        now = now.join(there, keys, "left_anti")  # what was there is not returned
    return _returned(now.select(*target.columns), m["returning"]) if m["returning"] else _done(engine, "INSERT 0", now)


def _update(engine, m: re.Match) -> DataFrame:
    name, sets = _short(m["table"]), _sets(m["sets"])
    keys = dml.key_names(engine, name)
    moved = {c for c in keys & set(sets) if sets[c] != c}
    if moved and not truth(engine.settings.get("allow_split_update", "on")):
        raise MetadataError(f"an update of key columns {sorted(moved)} is not allowed")
    condition = F.expr(m["where"]) if m["where"] else None
    changes = {c: F.expr(v) for c, v in sets.items()}
    new = dml.update(engine, name, changes, condition)
    return _returned(new, m["returning"]) if m["returning"] else _done(engine, "UPDATE", new)


def _delete(engine, m: re.Match) -> DataFrame:
    name = _short(m["table"])
    condition = F.expr(m["where"]) if m["where"] else None
    gone = dml.affected(engine, name, condition)
    dml.delete(engine, name, condition)
    return _returned(gone, m["returning"]) if m["returning"] else _done(engine, "DELETE", gone)


def _create(engine, m: re.Match) -> DataFrame:
    """An empty table. A distributed one must have its key columns; settings may attach it to a distribution first."""
    name, fields = _short(m["table"]), []
    for item in split_list(m["columns"]):
        words = item.split()
        if words[0].lower() in ("primary", "unique", "constraint", "foreign", "check"):
            continue
        kind = " ".join(words[1:])
        kind = re.split(r"\s+(?:primary|not|null|unique|default|references|check)\b", f" {kind}", flags=re.I)[0].strip().lower()
        kind = "string" if kind.startswith(("varchar", "character varying")) else TYPES.get(kind, kind)
        fields.append(f"`{words[0].strip('\"')}` {kind}")
    auto, key = engine.settings.get("auto_distribution"), engine.settings.get("distribution_key")
    if auto and not engine._distributed(name):
        if auto.upper() == "REPLICATED":
            engine.meta.create_reference(name)
        else:
            kind = engine.meta.distribution(auto).kinds[0]
            engine.meta.attach(auto, Relation(name, [KeyColumn(key, "murmur" if kind in ("uinteger", "varchar hashed", "uuid hashed") else "identity")]))
    engine.register(name, engine.spark.createDataFrame([], T.StructType.fromDDL(", ".join(fields))))
    return _done(engine, "CREATE TABLE")


def _drop(engine, m: re.Match) -> DataFrame:
    name = _short(m["table"])
    if name not in engine.tables:
        if "exists" in m["action"].lower():
            return _done(engine, "DROP TABLE")
        raise MetadataError(f"table {name} is not known")
    if m["action"].lower().startswith("truncate"):
        dml.truncate(engine, name)
        return _done(engine, "TRUNCATE TABLE")
    dml.drop(engine, name)
    return _done(engine, "DROP TABLE")


def _set(engine, m: re.Match) -> DataFrame:
    name = re.sub(r"^__[a-z]+__\.?", "", m["name"].lower())
    if m["value"] is None:
        engine.settings.pop(name, None)
    else:
        engine.set(name, m["value"].strip().strip("'\""))
    return _done(engine, "SET")


def _prepare(engine, m: re.Match) -> DataFrame:
    engine.prepared[m["name"]] = m["text"]
    return _done(engine, "PREPARE")


def _execute(engine, m: re.Match) -> DataFrame:
    if m["name"] not in engine.prepared:
        raise MetadataError(f'prepared statement "{m["name"]}" not found')
    text, given = engine.prepared[m["name"]], split_list(m["args"] or "")
    if wanted := max((int(x[1]) for x in _OUTSIDE.finditer(text) if x[1]), default=0):
        if len(given) != wanted:
            raise MetadataError(f'prepared statement "{m["name"]}" needs {wanted} parameters, {len(given)} are given')
    if given and re.match(r"\s*(select|with|values|table|from)\b", text, re.I):  # a query takes them as Spark's own parameters
        return engine.sql(_OUTSIDE.sub(lambda x: f":p{x[1]}" if x[1] else x[0], text), {f"p{i}": F.expr(v) for i, v in enumerate(given, 1)})
    return engine.sql(_OUTSIDE.sub(lambda x: f"({given[int(x[1]) - 1]})" if x[1] else x[0], text))


def _deallocate(engine, m: re.Match) -> DataFrame:
    if m["name"].lower() == "all":
        engine.prepared.clear()
    else:
        engine.prepared.pop(m["name"], None)
    return _done(engine, "DEALLOCATE")


def _function(engine, m: re.Match) -> DataFrame | None:
    """Engine functions: any prefix between double underscores."""
    from rangeloom.plans.console import Console
    from rangeloom.sources.remote import execute_text

    args = [_STRING.fullmatch(a)[1].replace("''", "'") if _STRING.fullmatch(a) else a for a in split_list(m["args"])]
    name = m["name"].lower()
    if name == "show":
        return Console(engine).relation(args[0])
    if name == "shards":
        return engine.spark.createDataFrame([(s,) for s in engine.meta.shards], "shard string")
    if name == "route_key":
        return engine.route_key(args[0], *args[1:])
    if name == "ctid":
        return engine.provenance(_short(args[0]))
    if name == "console_execute":
        return engine.console(args[0])
    if name == "remote_execute":
        return execute_text(engine, args[-1])
    if name == "await_task":  # tasks run when they are started
        task = engine.meta.tasks.get(args[0])
        return engine.spark.createDataFrame([(task.state if task else "COMPLETE",)], "state string")
    if name == "is_ready":
        return engine.spark.createDataFrame([(True,)], "is_ready boolean")
    if name == "host_status":  # a shard's rows are read from where they lie, and may be written
        return engine.spark.createDataFrame([(engine.meta.shard(args[0]), "true")], "host string, rw string")
    return None


_FORMS = ((_INSERT, _insert), (_UPDATE, _update), (_DELETE, _delete), (_CREATE, _create), (_DROP, _drop), (_SET, _set), (_PREPARE, _prepare), (_EXECUTE, _execute), (_DEALLOCATE, _deallocate), (_FUNCTION, _function))
_TRANSACTION = re.compile(r"(begin|start\s+transaction|commit|end|rollback|abort)\b.*$", re.I | re.S)


def run(engine, statement: str) -> DataFrame | None:
    """The result of a statement; None if it is a query. Each statement takes effect at once, so transactions do nothing."""
    text = statement.strip().rstrip(";").strip()
    if _TRANSACTION.fullmatch(text):
        return _done(engine, text.split()[0].upper())
    for form, action in _FORMS:
        if (m := form.match(text)) is not None and m.end() == len(text):
            out = action(engine, m)
            if out is not None:
                return out
    return None


_SET_CONFIG = re.compile(r"\bset_config\(\s*'([^']+)'\s*,\s*'([^']*)'\s*,\s*(?:true|false)\s*\)", re.I)


def _configured(engine, m: re.Match) -> str:
    engine.set(m[1], m[2])
    return f"'{m[2]}'"


_ANY = re.compile(r"=\s*any\s*\(\s*array\s*\((?=\s*select\b)", re.I)


def _any_array(statement: str) -> str:
    """x = ANY(ARRAY(subselect)) as x IN (subselect)."""
    while (m := _ANY.search(statement)) is not None:
        depth, at = 1, m.end()
        for part in re.finditer(r"'(?:[^']|'')*'|[()]", statement[m.end() :]):
            depth += {"(": 1, ")": -1}.get(part[0], 0)
            if not depth:
                at += part.start()
                break
        statement = f"{statement[: m.start()]} IN ({statement[m.end() : at]}{statement[at + 1 :]}"
    return statement


def literals(engine, statement: str) -> str:
    """Session functions that the engine answers itself."""
    statement = _SET_CONFIG.sub(lambda m: _configured(engine, m), statement)
    statement = _any_array(statement)
    standby = engine.settings.get("target_session_attrs", "") in ("read-only", "standby")
    statement = re.sub(r"\bpg_is_in_recovery\(\s*\)", str(standby).lower(), statement, flags=re.I)
    return re.sub(r"\bcurrent_setting\(\s*'transaction_read_only'\s*\)", f"'{'on' if standby else 'off'}'", statement, flags=re.I)
