"""Shared helpers: table access, fault-tolerant materialisation and Arrow column building."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
#: Bounds of a batch on its way to Python, where the session has the defaults: long texts would make it very large.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
ARROW_DEFAULTS = ("10000", "64MB", "67108864b")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python once per application, wherever it was imported from."""
    for name, value in ARROW.items():
        if spark.conf.get(name, None) in (None, *ARROW_DEFAULTS):
            spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="rangeloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, which is one process, may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/rangeloom-checkpoints"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


#: Seconds between two releases of what finished plans have left behind.
RELEASE = 4.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Lets finished plans go: their broadcasts and shuffle files are cleaned once the driver's collector sees them gone."""
    global _released
    if time.monotonic() - _released > RELEASE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._rangeloom_path = path
    release(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_rangeloom_path", None)
        if not path:
            continue
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def crc_mod(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def sliced(batches, max_bytes: int = 1 << 20):
    """Re-slice Arrow batches so that one slice holds about ``max_bytes``; a longer single row stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def utf8(column) -> list[bytes]:
    """Whole texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def record_batch(names_types, columns) -> pa.RecordBatch:
    arrays = []
    for (_, kind), values in zip(names_types, columns, strict=True):
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            arrays.append(values.cast(kind))
        else:
            arrays.append(pa.array(values.tolist() if isinstance(values, np.ndarray) and values.dtype == object else values, type=kind))
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in names_types])


def complete_groups(batches, keys: int):
    """(table, group bounds) of Arrow batches that are sorted by their first ``keys`` integer columns.

    Groups are whole: rows of the last one are held back until the next begins.
    """

    def bounds(t):
        changed = np.zeros(max(t.num_rows - 1, 0), bool)
        for i in range(keys):
            changed |= np.diff(t.column(i).to_numpy()) != 0
        return np.flatnonzero(changed) + 1

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        cuts = bounds(t) if t.num_rows else []
        if len(cuts):
            yield t.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            t = t.slice(int(cuts[-1]))
        held = t
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])

