"""COPY: delimited texts into and out of sharded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.operators.routing import placed
from rangeloom.plans.model import MetadataError


def _options(format: str, delimiter: str | None) -> dict:
    return {"sep": delimiter or ("," if format == "csv" else "\t"), "header": "false", "nullValue": "" if format == "csv" else "\\N", "mode": "FAILFAST"}


def _key_check(engine, name: str, columns: list[str]) -> bool:
    for d in engine.meta.distributions.values():
        if name in d.relations:
            wanted = {c for k in d.relations[name].key for c in ([p for p, _ in k.parts] or [k.name])}
            if missing := wanted - set(columns):
                raise MetadataError(f"failed to resolve target copy column offset: {sorted(missing)}")
            return True
    return False


def copy_from(engine, name: str, source, columns: list[str] | None = None, format: str = "text", delimiter: str | None = None, execute_on: str | None = None) -> DataFrame:
    """Rows of a file path, or of a DataFrame of lines, with the shard that each belongs to.

    All key columns have to be listed. A line of backslash and full stop ends nothing here, but isn't a row. ``execute_on``
    pins all rows to a shard; reference tables have none. Columns that aren't listed are null.
    """
    target = engine.tables[name].schema
    columns = columns or target.names
    distributed = _key_check(engine, name, columns)
    schema = T.StructType([target[c] for c in columns])
    if isinstance(source, str):
        source = engine.spark.read.text(source)
    lines = source.where(F.col(source.columns[0]) != "\\.")
    options = _options(format, delimiter)
    rows = lines.select(F.from_csv(F.col(source.columns[0]), schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    rows = rows.select(*(F.col(c) if c in columns else F.lit(None).cast(target[c].dataType).alias(c) for c in target.names))
    if execute_on is not None:
        return rows.withColumn("__shard", F.lit(engine.meta.shard(execute_on)))
    return placed(rows, engine.meta, name) if distributed else rows


def lines_of(df: DataFrame, format: str = "text", delimiter: str | None = None) -> DataFrame:
    """A table's rows as delimited lines, in the form that copy_from reads."""
    options = _options(format, delimiter)
    return df.select(F.to_csv(F.struct(*df.columns), {k: v for k, v in options.items() if k in ("sep", "nullValue")}).alias("value"))


def copy_to(df: DataFrame, path: str, format: str = "text", delimiter: str | None = None) -> None:
    lines_of(df, format, delimiter).write.text(path)


def write_by_shard(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet in one folder a shard, so that a shard's rows are read without the others."""
    rows.write.mode(mode).partitionBy("__shard").parquet(path)


def metadata_json(engine) -> str:
    """The metadata as JSON."""
    return engine.meta.dump()
