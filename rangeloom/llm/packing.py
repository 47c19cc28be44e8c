"""Sequence packing by non-negative least squares over shallow length combinations.

A task reads its documents in blocks of about ``BLOCK_TOKENS`` tokens. Full windows of a document become sequences of
their own. The lengths of the remainders form a histogram; pairs and triples of lengths that fill a window exactly are
enumerated, their repeat counts are solved by projected gradient against the histogram, rounded, and laid out. What is
left is packed greedily one after the other, cut where a window ends; an open window is carried into the next
block, so that only the last sequence of a task is padded. Blocks bound the memory whatever the partition's size.

Defined cases. Null text counts as empty: its document is the end id alone. Every row is a document of its own, also a
repeated one. A null id stays null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import record_batch, sliced, strings, table
from rangeloom.llm.tokens import encoder

WINDOW, END_ID, BLOCK_TOKENS = 2048, 1, 6_000_000
#: Triples tried for each shortest length, and steps of the solver.
PARTNERS, STEPS = 24, 120


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of two or three of the sorted distinct lengths (0: none) that add up to the window, a <= b <= c."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    a = lengths[(lengths * 2 <= window)]
    pairs = np.stack([np.zeros_like(a), a, window - a], axis=1)[present[window - a]]
    found = [pairs]
    for a in lengths[lengths * 3 <= window].tolist():
        b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
        b = b[present[window - a - b]]
        if b.size > PARTNERS:
            b = b[np.linspace(0, b.size - 1, PARTNERS).astype(int)]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative x that least-squares fits sum of x over a length's combinations to the histogram (length 0 is free)."""
    n, cols = len(combos), combos.T
    x = np.zeros(n)
    if not n:
        return x
    degree = np.bincount(combos.reshape(-1), minlength=histogram.size)
    rate = 1.0 / np.maximum(1, degree * (np.arange(degree.size) > 0))[cols].sum(axis=0)  # a diagonal bound of the curvature
    y, t = x, 1.0
    for _ in range(STEPS):
        filled = sum(np.bincount(c, weights=y, minlength=histogram.size) for c in cols)
        gap = histogram - filled
        gap[0] = 0
        new = np.maximum(0, y + rate * sum(gap[c] for c in cols))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
        y = np.maximum(y, 0)
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts, largest first, that never use more of a length than there is."""
    left, out = histogram.copy(), np.zeros(len(combos), np.int64)
    for i in np.argsort(-x, kind="stable").tolist():
        want = int(x[i] + 0.75)
        if not want:
            break
        parts = [p for p in combos[i].tolist() if p]
        n = min(want, *(int(left[p]) // parts.count(p) for p in parts))
        if n > 0:
            out[i] = n
            for p in parts:
                left[p] -= n
    return out


class Packer:
    """Lays out blocks of documents; keeps the open sequence between blocks."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next, self.open, self.fill = window, first_sequence, None, 0

    def take(self, n: int = 1) -> int:
        got = self.next
        self.next += n
        return got

    def block(self, sizes: np.ndarray):
        """sizes: tokens of each document. Returns arrays doc, start, length, sequence, offset."""
        w, out = self.window, []
        full, rest = np.divmod(sizes, w)
        doc = np.repeat(np.arange(sizes.size), full)
        begin = np.arange(doc.size) - np.repeat(np.cumsum(full) - full, full)
        out.append((doc, begin * w, np.full(doc.size, w), self.take(doc.size) + np.arange(doc.size), np.zeros(doc.size, np.int64)))
        docs = np.flatnonzero(rest)
        docs = docs[np.argsort(rest[docs], kind="stable")]
        histogram = np.bincount(rest[docs], minlength=w + 1)
        combos = combinations(np.flatnonzero(histogram), w)
        used = rounded(combos, repeat_counts(combos, histogram.astype(float)), histogram)
        at, ends = np.cumsum(histogram) - histogram, np.cumsum(histogram)
        for i in np.flatnonzero(used).tolist():
            n, offset, seq = int(used[i]), 0, self.take(int(used[i])) + np.arange(int(used[i]))
            for p in combos[i].tolist():
                if p:
                    d = docs[at[p] : at[p] + n]
                    at[p] += n
                    out.append((d, full[d] * w, np.full(n, p), seq, np.full(n, offset)))
                    offset += p
        left = np.concatenate([docs[a:e] for a, e in zip(at.tolist(), ends.tolist(), strict=True)]) if docs.size else docs
        if left.size:
            out.append(self.residue(left, full[left] * w, rest[left]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def residue(self, docs, starts, sizes):
        """One piece after the other from the open sequence on, cut at the ends of windows."""
        w, base = self.window, self.fill if self.open is not None else 0
        ends = base + np.cumsum(sizes)
        begins = ends - sizes
        slots = (ends - 1) // w - begins // w + 1
        row = np.repeat(np.arange(docs.size), slots)
        nth = np.arange(row.size) - np.repeat(np.cumsum(slots) - slots, slots)
        slot = begins[row] // w + nth
        lo, hi = np.maximum(begins[row], slot * w), np.minimum(ends[row], (slot + 1) * w)
        total = int((ends[-1] - 1) // w) + 1
        names = np.empty(total, np.int64)
        new = total - (self.open is not None)
        names[total - new :] = self.take(new) + np.arange(new)
        if self.open is not None:
            names[0] = self.open
        self.fill = int(ends[-1] - (total - 1) * w)
        self.open = None if self.fill == w else int(names[-1])
        return docs[row], starts[row] + lo - begins[row], hi - lo, names[slot], lo - slot * w


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids (little-endian uint32) as ``ids``."""

    def run(batches):
        encode = encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 36)
        keys, ids, held = [], [], 0

        def flush():
            sizes = np.array([len(x) for x in ids], np.int64)
            d, s, n, q, o = packer.block(sizes)
            parts = [memoryview(ids[i])[a : a + k].cast("B") for i, a, k in zip(d.tolist(), s.tolist(), n.tolist(), strict=True)]
            columns = [[keys[i] for i in d.tolist()], s, n, [zlib.crc32(p) for p in parts], sizes[d], q, o]
            if with_ids:
                columns.append([bytes(p) for p in parts])
            return record_batch(fields, columns)

        for b in sliced(batches):
            for key, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                x = np.append(encode(t), np.uint32(END_ID)).astype("<u4", copy=False)
                keys.append(key)
                ids.append(x)
                held += x.size
                if held >= BLOCK_TOKENS:
                    yield flush()
                    keys, ids, held = [], [], 0
        if keys:
            yield flush()

    fields = FIELDS + [("ids", pa.binary())] * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
