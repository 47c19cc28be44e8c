"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

Each of the 32 two-bit segments of a fingerprint is mapped to its bit count. The Manhattan distance of two such
vectors never exceeds the fingerprints' Hamming distance, so a pair within four bits is within distance two in the first
half of the vector or within distance one in the second. Distinct fingerprints are put into the grid cells around
them (some 38 of the cells of both halves), so that pairs within these Manhattan distances share a cell; cells are
dealt out, and pairs of a cell verified exactly. Counts are kept in unary code (0: 00, 1: 01, 2: 11), in which the
Manhattan distance is the bit count of an exclusive or.

Defined cases. Null and blank texts have fingerprint zero, which links like any other. Copies share a fingerprint and are
joined once. A null id gets no say in the component's id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import complete_groups, materialize, record_batch, sliced, table, utf8
from rangeloom.llm.graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a grid cell up to which all their links are listed.
CELL = 12
#: Members of a larger cell up to which its tree takes the closest pairs of all.
TREE = 4096
_LOW = 0x5555555555555555


def shingle_hashes(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words of the lower-cased text, repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    width = min(width, len(words))
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the hashes; as a signed number."""
    h = shingle_hashes(data, width)
    if not h.size:
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > h.size, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for b in sliced(batches):
            yield record_batch([("doc_id", pa.int64()), ("fp", pa.int64())], [b.column(0), [fingerprint(t, width) for t in utf8(b.column(1))]])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _embedded(fp):
    """The segments' bit counts of a fingerprint in unary code."""
    low, shifted = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(shifted).bitwiseAND(low), fp.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _half(fp, half: int):
    """32 bits of a half of the embedding, as a long that is not negative."""
    return F.shiftrightunsigned(_embedded(fp), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def _around(cell, only_up: bool = False):
    """The cell and its neighbours: one segment's count is one higher (or, unless ``only_up``, lower)."""
    one = F.lit(1).cast("long")

    def flip(i):
        bit = F.call_function("shiftleft", one, i)
        partner = F.when(i % 2 == 0, F.call_function("shiftleft", bit, F.lit(1))).otherwise(F.call_function("shiftrightunsigned", bit, F.lit(1)))
        set_partner = cell.bitwiseAND(partner) != 0
        # the low bit may change while the high one is clear, the high bit while the low one is set
        valid = F.when(i % 2 == 0, ~set_partner).otherwise(set_partner)
        if only_up:
            valid = valid & (cell.bitwiseAND(bit) == 0)
        return F.when(valid, cell.bitwiseXOR(bit))

    moved = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), flip), lambda c: c.isNotNull())
    return F.concat(F.array(cell), moved)


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS  # signed numbers would be counted by their absolute value


def _own_cell(fp: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The cell that a fingerprint has itself, of the second half where asked."""
    x, low = fp.view(np.uint64), np.uint64(_LOW)
    shifted = x >> np.uint64(1)
    u = ((x | shifted) & low) | ((x & shifted & low) << np.uint64(1))
    return np.where(second, (u >> np.uint64(32)) + np.uint64(1 << 32), u & np.uint64(0xFFFFFFFF)).view(np.int64)


def _nearest_tree(fp: np.ndarray):
    """A tree of each component of a cell that takes the closest pairs first (Prim's algorithm)."""
    left = np.arange(1, fp.size)
    best, to = np.bitwise_count((fp[left] ^ fp[0]).view(np.uint64)), np.zeros(left.size, np.int64)
    x, y = [], []
    while left.size:
        k = int(np.argmin(best))
        at = left[k]
        if best[k] <= RADIUS:
            x.append(to[k])
            y.append(at)
        left, best, to = np.delete(left, k), np.delete(best, k), np.delete(to, k)
        now = np.bitwise_count((fp[left] ^ fp[at]).view(np.uint64))
        closer = now < best
        best, to = np.where(closer, now, best), np.where(closer, at, to)
    return fp[np.array(x, np.int64)], fp[np.array(y, np.int64)]


def _search_tree(fp: np.ndarray):
    """A tree of each component by breadth-first search: dense cells take few comparisons a member."""
    rest, out = np.arange(fp.size), [(fp[:0], fp[:0])]
    while rest.size:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            hit = _close(fp[rest], fp[at])
            if hit.any():
                found = rest[hit]
                out.append((np.full(found.size, fp[at]), fp[found]))
                queue += found.tolist()
                rest = rest[~hit]
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _reach(fp: np.ndarray):
    """Links that connect all that can be reached within a large cell, one or two a member, close pairs first."""
    fp = np.unique(fp)
    if fp.size <= TREE:
        return [_nearest_tree(fp)]
    return [_search_tree(fp), *(_nearest_tree(fp[i : i + TREE]) for i in range(0, fp.size, TREE))]


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) of pairs of distinct fingerprints of a view (columns view, node, fp) that differ in ``RADIUS`` bits or fewer.

    All of them in cells of up to ``CELL`` members; in larger cells those that connect the members, one a member and cell,
    so that a group's links never outgrow its rows. Two fingerprints within the radius share a cell: of the first half, where
    both have the cells one step around them, if they are within two steps there, and of the second half, where both have
    their own cell and those one step up, if they are within one.
    """
    first = F.explode(_around(_half(F.col("fp"), 0))).alias("cell")
    second = F.explode(_around(_half(F.col("fp"), 1), only_up=True)).alias("cell")
    spread = fps.select("view", first, "fp").union(fps.select("view", second, "fp").select("view", F.col("cell") + F.lit(1 << 32), "fp"))
    spread = spread.select((F.col("cell") + F.col("view").cast("long") * F.lit(1 << 33)).alias("cell"), "fp")

    def verify(batches):
        for t, cuts in complete_groups(batches, 1):
            cell, fp, sizes, out = t.column(0).to_numpy(), t.column(1).to_numpy(), np.diff(cuts), []
            view = cell >> 33
            cell = cell & ((1 << 33) - 1)
            own = _own_cell(fp, cell >= 1 << 32)
            end = np.repeat(np.where(sizes <= CELL, cuts[1:], cuts[:-1]), sizes)  # large cells are left out here
            at = np.flatnonzero(end - np.arange(fp.size) > 1)
            step = 1
            while at.size:
                hit = at[_close(fp[at], fp[at + step])]
                # pairs within one step also meet elsewhere; they count in a cell that one of them has itself
                far = np.bitwise_count(own[hit] ^ own[hit + step]) > 1
                hit = hit[far | (own[hit] == cell[hit]) | (own[hit + step] == cell[hit])]
                out.append((view[hit], fp[hit], fp[hit + step]))
                step += 1
                at = at[end[at] - at > step]
            for k in np.flatnonzero(sizes > CELL).tolist():
                out += [(np.full(x.size, view[cuts[k]]), x, y) for x, y in _reach(fp[cuts[k] : cuts[k + 1]])]
            if out:
                v, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
                pairs = np.unique(np.stack([v, np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                pairs = pairs[pairs[:, 1] != pairs[:, 2]]
                yield record_batch([("view", pa.int32()), ("x", pa.int64()), ("y", pa.int64())], list(pairs.T))

    pairs = spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "view int, x long, y long").distinct()
    named = pairs.join(fps.select("view", F.col("fp").alias("x"), F.col("node").alias("src")), ["view", "x"])
    return named.join(fps.select("view", F.col("fp").alias("y"), F.col("node").alias("dst")), ["view", "y"]).select("src", "dst")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable) for every row."""
    rows = materialize(fingerprints(docs, text, doc_id, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(nodes.where(F.col("node").isNotNull()).withColumn("view", F.lit(0))))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
