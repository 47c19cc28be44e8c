"""Soft-membership mixing of documents to target domain weights.

A classifier learnt from the labels table (hashed runs of four bytes, multinomial logistic regression on a bounded
sample) gives every document posterior weights over the domains ``DOMAINS``. Each document gets a non-negative rate, so
that the expected token totals by domain, the sum of rate x tokens x posterior, match the targets. The rates solve a
least-squares problem by projected gradient steps from one on, in the metric of the second moments of the documents that can still move; a step
needs a few sums from the cluster, and the rates follow from the list of steps, so no state is kept.

Defined cases. Null text counts as empty: no tokens, posteriors as the classifier's bias has them. Without labels all
posteriors are equal and all rates one. Repeated rows count each time and get the same rate. Targets that no non-negative
rates reach are met as closely as the steps get. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import materialize, record_batch, sliced, table, utf8
from rangeloom.llm.rows import rewritten
from rangeloom.llm.tokens import encoder

#: Domains of the labels table and their shares of the mixed tokens.
DOMAINS, TARGETS = ("good", "low"), (0.92, 0.08)
SAMPLE, SLOTS, STEPS, LEARN = 2000, 4096, 25, 150
TOLERANCE = 1e-6
#: Distance from a target, as a share of all tokens, that is reported.
STEPPED_OVER = 0.001


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every run of four bytes; ASCII letters in lower case."""
    flat = np.frombuffer(b"\n\n\n".join([t.lower() for t in texts]) + b"\n\n\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    word = flat[:-3].astype(np.uint32)
    for i in (1, 2, 3):
        word = word << np.uint32(8) | flat[i : flat.size - 3 + i]
    slot = (word * np.uint32(2654435761)) >> np.uint32(32 - SLOTS.bit_length() + 1)
    return np.repeat(np.arange(len(texts)), sizes)[: word.size], slot.astype(np.int64)


def counted(texts: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Each text's distinct slots (uint16) and their shares of all its runs (float32): the sparse row of the classifier."""
    row, slot = runs(texts)
    key, n = np.unique(row * SLOTS + slot, return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) * SLOTS)
    slot, total = (key % SLOTS).astype("<u2"), np.bincount(row, minlength=len(texts))
    share = (n / total[key // SLOTS]).astype("<f4")
    return [(slot[a:e].tobytes(), share[a:e].tobytes()) for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def fit(rows: list[tuple[bytes, bytes]], labels: list[int], prior: np.ndarray):
    """Weights (SLOTS x domains) and biases of a ridge multinomial regression on sparse rows; prior: the domains' shares.

    Columns are brought to one scale and centred without a dense matrix; the first domain's weights are zero.
    """
    k, n = len(DOMAINS), len(rows)
    if not n:
        return np.zeros((SLOTS, k), np.float32), np.zeros(k)
    slot = np.frombuffer(b"".join(s for s, _ in rows), "<u2")
    share = np.frombuffer(b"".join(x for _, x in rows), "<f4")
    sizes = np.fromiter((len(s) // 2 for s, _ in rows), np.int64, n)  # never zero, spacers count
    begins = np.cumsum(sizes) - sizes
    mean = np.bincount(slot, share, SLOTS) / n
    square = np.bincount(slot, np.square(share, dtype=np.float64), SLOTS) / n
    scale = 1 / (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-4)
    share = share * scale.astype(np.float32)[slot]
    center = mean * scale
    y = np.eye(k)[labels]
    weight = (prior / np.maximum(y.mean(axis=0), 1e-9))[labels]  # as if drawn with the true shares
    w, b = np.zeros((SLOTS, k)), np.log(np.maximum(prior, 1e-6))
    vw, rate, keep = np.zeros_like(w), 8.0 / SLOTS, 0.0005 * SLOTS
    for _ in range(LEARN):
        z = np.zeros((n, k))
        for c in range(1, k):
            z[:, c] = np.add.reduceat(share * w[:, c].astype(np.float32)[slot], begins)
        z += b - center @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - y) * weight[:, None] / n
        for c in range(1, k):
            turn = np.bincount(slot, share * np.repeat(gap[:, c].astype(np.float32), sizes), SLOTS) - center * gap[:, c].sum()
            vw[:, c] = 0.9 * vw[:, c] - rate * (turn + keep / SLOTS * 0.05 * w[:, c])
        w += vw
        b = b - 0.3 * gap.sum(axis=0)
    w = w * scale[:, None]
    return w.astype(np.float32), b - mean @ w


def posteriors(texts: list[bytes], model) -> np.ndarray:
    w, b = model
    z = np.tile(b, (len(texts), 1)).astype(float)
    row, slot = runs(texts)
    n = np.bincount(row, minlength=len(texts))
    for k in range(w.shape[1]):
        z[:, k] += np.bincount(row, weights=w[slot, k], minlength=len(texts)) / np.maximum(n, 1)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, labels: DataFrame):
    """The classifier, from about SAMPLE labelled documents of each domain, drawn by a hash of the id."""
    domain = F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select(F.col("doc_id").cast("long").alias("i"), domain.alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = np.array([n.get(k, 0) for k in range(len(DOMAINS))], float)
    if not prior.sum():
        return fit([], [], prior)
    rate = F.lit(0.0)
    for k, v in n.items():
        rate = F.when(F.col("y") == k, F.lit(min(1.0, SAMPLE / v))).otherwise(rate)
    few = known.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate)
    picked = docs.select(F.col("doc_id").cast("long").alias("i"), "text").join(F.broadcast(few), "i").where("text is not null").select("i", "y", "text")

    def features(batches):
        for x in sliced(batches):
            data = utf8(x.column(2))
            marks = [xxhash.xxh64_intdigest(t) >> 1 for t in data]
            yield record_batch([("i", pa.int64()), ("y", pa.int32()), ("h", pa.int64()), ("s", pa.binary()), ("x", pa.binary())], [x.column(0), x.column(1), marks, *zip(*counted(data), strict=True)])

    found = picked.mapInArrow(features, "i long, y int, h long, s binary, x binary").dropDuplicates(["i", "h"]).toArrow().sort_by([("i", "ascending"), ("h", "ascending")])
    rows = list(zip(found.column("s").to_pylist(), found.column("x").to_pylist(), strict=True))
    return fit(rows, found.column("y").to_pylist(), prior / prior.sum())


def memberships(docs: DataFrame, model, keep=()) -> DataFrame:
    """doc_id, n_tokens, p_<domain> of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((f"p_{d}", pa.float64()) for d in DOMAINS)]

    def run(batches):
        encode = encoder()
        for b in sliced(batches, 1 << 19):
            texts = utf8(b.column(1))
            p = posteriors(texts, shared.value)
            yield record_batch(fields, [b.column(0), [len(encode(t.decode())) for t in texts], *p.T])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def _rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the listed steps (one row a step, one number a domain)."""
    r = np.ones(len(p))
    for move in steps:
        r = np.maximum(0, r - p @ move)
    return r


def solve(members: DataFrame, targets=TARGETS) -> np.ndarray:
    """The list of steps that brings the expected totals to the targets' shares of all tokens.

    A target that no rates reach is met as closely as STEPS allow; the gap that is left is logged.
    """
    names = [f"p_{d}" for d in DOMAINS]
    k = len(names)
    goal = np.array(targets)
    fields = [(f"s{i}", pa.float64()) for i in range(1 + k + k * k)]
    steps, best, chosen = np.zeros((0, k)), np.inf, np.zeros((0, k))
    for _ in range(STEPS):

        def sums(batches, steps=steps):
            """All tokens, expected totals, and second moments of the documents whose rates can still move."""
            for b in batches:
                p = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, k + 1)], axis=1)
                t, r = b.column(0).to_numpy(zero_copy_only=False).astype(float), _rates(p, steps)
                yield record_batch(fields, [[x] for x in [t.sum(), *((t * r) @ p), *((p * (t * (r > 0))[:, None]).T @ p).reshape(-1)]])

        got = members.select("n_tokens", *names).mapInArrow(sums, ", ".join(f"{n} double" for n, _ in fields)).agg(*(F.sum(n) for n, _ in fields)).first()
        total, *rest = (x or 0.0 for x in got)
        if not total:
            break
        gap = np.array(rest[:k]) / total - goal
        if np.abs(gap).max() < best:
            best, chosen = np.abs(gap).max(), steps
        if best < TOLERANCE:
            break
        metric = np.array(rest[k:]).reshape(k, k) / total
        steps = np.concatenate([steps, [np.linalg.solve(metric + 1e-9 * np.eye(k), gap)]])
    if STEPPED_OVER < best < np.inf:
        logging.getLogger(__name__).warning("mixing: a domain's share stays %.4f away from its target", best)
    return chosen


def _spread(doc_id):
    return F.pmod(F.xxhash64(F.lit("copies"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def rated(members: DataFrame, steps: np.ndarray) -> DataFrame:
    """Adds rate and copies: the rate rounded by a hash of the id, so that copies average to the rate."""
    names = [f"p_{d}" for d in DOMAINS]
    point = F.array(*names)
    rate = F.lit(1.0)
    if len(steps):
        moves = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
        rate = F.aggregate(moves, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(point, s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)))
    spread = _spread(F.col("doc_id"))
    return members.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + F.when(spread < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets=TARGETS) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of each row."""
    members = materialize(memberships(docs, learn(docs, labels)), "members")
    return rated(members, solve(members, targets))


def mixed(docs: DataFrame, labels: DataFrame, targets=TARGETS) -> DataFrame:
    """The table with each row as often as its rounded rate says; rows of domains short of their target never go."""
    model = learn(docs, labels)
    steps = solve(materialize(memberships(docs, model), "members"), targets)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def change(batch, extras):
        if not batch.num_rows:
            return
        p = np.concatenate([posteriors(utf8(b.column(0)), shared.value) for b in sliced([pa.RecordBatch.from_arrays([extras[0]], names=["t"])], 1 << 19)])
        rate = _rates(p, steps)
        copies = np.floor(rate) + (extras[1].to_numpy(zero_copy_only=False) < rate - np.floor(rate))
        yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies.astype(np.int64))))

    return rewritten(docs, {"text": F.col("text"), "spread": _spread(F.col("doc_id").cast("long"))}, lambda: change)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_mixing": op9_mixing}
