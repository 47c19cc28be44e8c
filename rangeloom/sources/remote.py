"""Scans of catalogs and of statements that run elsewhere in the session."""

from __future__ import annotations

from pyspark.sql import DataFrame


def columns(engine) -> DataFrame:
    """table_name, column_name, ordinal_position, data_type of all registered tables."""
    rows = [(n, f.name, i, f.dataType.simpleString()) for n, df in engine.tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return engine.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string")


def tables(engine) -> DataFrame:
    """table_name and its kind: distributed, reference or plain."""

    def kind(n: str) -> str:
        if n in engine.meta.references:
            return "reference"
        return "distributed" if any(n in d.relations for d in engine.meta.distributions.values()) else "plain"

    return engine.spark.createDataFrame([(n, kind(n)) for n in engine.tables], "table_name string, kind string")


def jdbc(engine, url: str, table: str, **options) -> DataFrame:
    """A table of another database, where its driver is on the class path."""
    return engine.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def execute_text(engine, statements: str) -> DataFrame:
    """Runs statements one after the other; the last one's rows as texts."""
    out = None
    for s in filter(None, (x.strip() for x in statements.split(";"))):
        out = engine.sql(s)
    return out.select(*(out[c].cast("string").alias(c) for c in out.columns))
