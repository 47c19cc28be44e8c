"""Row filters and rewrites that keep a table's own columns, for pipeline stages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.llm.common import sliced

FILTER_BITS = 1 << 23


def slots(column):
    """The place of an id in a bitmap."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def bitmap(ids: DataFrame) -> bytes:
    """FILTER_BITS bits with the slot of each value of column id set: of a fixed size whatever the number of ids."""
    return bitmap_of(ids.select(slots(F.col("id")).alias("slot")))


def bitmap_of(places: DataFrame) -> bytes:
    """FILTER_BITS bits with each value of column slot set; the driver gets at most one number for each 32 bits."""
    slot = F.col("slot")
    words = places.select(F.shiftright(slot, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("b"))
    out = np.zeros(FILTER_BITS // 32, "<u4")
    for part in words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.tobytes()


def member(data: bytes, slot: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(data, np.uint8)
    return (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)


def rewritten(docs: DataFrame, extra: dict, begin) -> DataFrame:
    """Passes the table's record batches through a function that ``begin()`` makes in each task.

    The function takes (batch, extras) and gives batches of the same columns; ``extra``: further columns, computed
    before, which it gets as a list of arrays.
    """
    names, n = docs.columns, len(docs.columns)
    positions = {f"__{i}": c for i, c in enumerate(extra.values())}
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])  # names may clash

    def run(batches):
        change = begin()
        for b in batches:
            for out in change(pa.RecordBatch.from_arrays(b.columns[:n], names=[f"c{i}" for i in range(n)]), b.columns[n:]):
                yield out

    source = docs.select("*", *(c.alias(k) for k, c in positions.items())).toDF(*(f"c{i}" for i in range(n)), *positions)
    return source.mapInArrow(run, plain).toDF(*names)


def without(docs: DataFrame, doubtful: DataFrame, keys: tuple[str, ...], computed) -> DataFrame:
    """The rows that are not among those of ``doubtful`` with kept false; a single row of each of those with kept true.

    ``keys``: long columns of ``doubtful`` that ``computed`` gives for a batch of the table's rows. A row with a null key stays.
    A bitmap over the second key tells most rows apart without a shuffle; only rows it can't clear are joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(doubtful.select(F.pmod(keys[1], F.lit(FILTER_BITS)).alias("slot"))))
    names, n = docs.columns, len(docs.columns)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]  # names may clash

    def part(wanted: bool):
        def run(batches):
            for b in sliced(batches):
                b = pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" for i in range(n)])
                found = computed(b)
                hit = member(shared.value, np.asarray(found[1]) & (FILTER_BITS - 1)) & ~np.asarray(found[0].is_null())
                if wanted:
                    b = pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*b.schema.names, *(f"k{i}" for i in range(len(keys)))])
                yield b.filter(pa.array(hit == wanted))

        return docs.toDF(*(f"c{i}" for i in range(n))).mapInArrow(run, T.StructType(fields + [T.StructField(f"k{i}", T.LongType()) for i in range(len(keys))] * wanted))

    own = [f"k{i}" for i in range(len(keys))]
    gone = doubtful.where("not kept").select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)))
    unsure = part(True).join(gone, own, "left_anti").dropDuplicates(own).drop(*own)
    return part(False).union(unsure).toDF(*names)
