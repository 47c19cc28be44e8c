"""Moving keys between shards: split bounds, moves, redistribution in batches, and a balancing plan."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.routing import range_condition, with_shard
from rangeloom.operators.store import numbered
from rangeloom.plans.model import KeyRange, MetadataError, Task


def split_bounds(df: DataFrame, key: str, step: int, limit: int, left: bool = True) -> DataFrame:
    """Every step-th key of the first (or last) ``limit`` rows in key order: where batches of a range end.

    The rows are cut to ``limit`` before they are numbered, so the numbering window never holds more.
    """
    order = F.col(key).asc() if left else F.col(key).desc()
    first = df.select(key).where(F.col(key).isNotNull()).orderBy(order).limit(limit)
    ranked = first.withColumn("n", F.row_number().over(Window.orderBy(order)))
    return ranked.where(F.col("n") % step == 0).select(F.col(key).alias("bound"), "n")


def batch_step(batch: int, coefficient: float) -> int:
    """Rows of the biggest relation that make a batch of ``batch`` keys."""
    return max(1, math.ceil(batch * coefficient - 1e-3))


def _check(engine, source: KeyRange, shard: str) -> None:
    engine.meta.shard(shard)
    if source.locked:
        raise MetadataError(f'key range "{source.id}" is locked')
    for name, relation in engine.meta.distribution(source.distribution).relations.items():
        wanted = {c for k in relation.key for c in ([p for p, _ in k.parts] or [k.name])}
        if name in engine.tables and (missing := wanted - set(engine.tables[name].columns)):
            raise MetadataError(f"table {name} lacks key columns {sorted(missing)}")


def rows_of(engine, relation: str, key_range: str) -> DataFrame:
    """A relation's rows in a key range."""
    _, r = engine.meta.of(relation)
    if all(c.method == "identity" for c in r.key):
        return engine.tables[relation].where(range_condition(engine.meta, relation, key_range))
    return with_shard(engine.tables[relation], engine.meta, relation, key_range=True).where(F.col("__key_range") == key_range).drop("__shard", "__key_range")


#: States of a move, in order; a state is set before its work, so that an interrupted move goes on from there.
STATES = ("PLANNED", "LOCKED", "DATA_MOVED", "METADATA_UPDATED", "COMPLETE")


def move(engine, key_range: str, shard: str, record: dict | None = None) -> KeyRange:
    """Relabels a range, locked meanwhile. A row's shard is computed from its range, so no row is copied."""
    r = engine.meta.range(key_range)
    _check(engine, r, shard)
    if r.shard == shard:
        return r
    record = {} if record is None else record
    r.locked = True
    engine.statistics.lock(key_range, True)
    record["state"] = "LOCKED"
    try:
        with engine.statistics.step("data_move"):
            record["state"] = "DATA_MOVED"
        with engine.statistics.step("metadata_update"):
            r.shard = shard
            record["state"] = "METADATA_UPDATED"
    finally:
        r.locked = False
        engine.statistics.lock(key_range, False)
    record["state"] = "COMPLETE"
    return r


def redistribute(engine, key_range: str, shard: str, batch: int = 500, group: str | None = None, check: bool = False, later: bool = False) -> Task:
    """Moves a range batch by batch, from its last keys on. ``later``: only the task is made, ``resume`` does the work."""
    meta = engine.meta
    source = meta.range(key_range)
    if batch < 1:
        raise MetadataError("a batch has at least one key")
    _check(engine, source, shard)
    for t in meta.tasks.values():
        if t.source == key_range and t.shard == shard and t.state not in ("COMPLETE", "CHECKED"):
            return t if later else resume(engine, t)
    task = Task(group or f"tg{uuid.uuid4().hex[:8]}", key_range, shard, f"{key_range}_{shard}", batch)
    if source.shard == shard:
        task.state = "COMPLETE"
        return task
    if check:
        task.state = "CHECKED"
        return task
    meta.tasks[task.id] = task
    return task if later else resume(engine, task)


def batch_bounds(engine, source: KeyRange, batch: int) -> list:
    """Where a range is split into batches, from its last keys on: one pass that numbers the distinct keys of its biggest relation.

    The first batches hold ``batch`` keys of that relation's share of all rows; the driver gets one key a batch. A range of hashed,
    uuid or several key columns is one batch: its keys have no order that a split could use.
    """
    from rangeloom.operators.stats import biggest_relation

    d = engine.meta.distribution(source.distribution)
    names = [n for n in d.relations if n in engine.tables]
    if not names or len(d.kinds) != 1 or d.kinds[0] not in ("integer", "varchar"):
        return []
    big = biggest_relation(engine, d.id, source.id).first()
    if big is None or big["relation"] is None:
        return []
    key = d.relations[big["relation"]].key[0].name
    keys = rows_of(engine, big["relation"], source.id).select(F.col(key).alias("key")).distinct().orderBy(F.col("key").desc())
    ranked, n = numbered(keys, "n", 1)
    step = batch_step(batch, big["share"])
    return [r["key"] for r in ranked.where((F.col("n") % step == 0) & (F.col("n") < n)).orderBy("n").select("key").toLocalIterator() if r["key"] != source.lower[0]]


def resume(engine, task: Task, most: int | None = None) -> Task:
    """Goes on with a task from its last finished batch; ``most``: batches to do now. A stopped task begins no further batch."""
    meta = engine.meta
    if task.state == "COMPLETE":
        return task
    task.state, done = "MOVING", 0
    if not any(x["state"] != "COMPLETE" for x in task.moves):
        at = [*batch_bounds(engine, meta.range(task.source), task.batch), None] if task.source in meta.ranges else []
        number = len(task.moves)
        task.moves += [{"id": f"mt{number + i}", "range": f"{task.id}_{number + i}", "bound": [b] if b is not None else list(meta.range(task.source).lower), "state": "PLANNED"} for i, b in enumerate(at)]
    for record in task.moves:
        if record["state"] == "COMPLETE" or task.state == "STOPPED" or (most is not None and done >= most):
            continue
        last = tuple(record["bound"]) == meta.range(task.source).lower if task.source in meta.ranges else False
        if record["range"] not in meta.ranges:
            if last:
                meta.rename(task.source, record["range"])
            else:
                meta.split(record["range"], task.source, tuple(record["bound"]))
        move(engine, record["range"], task.shard, record)
        if task.target in meta.ranges:
            meta.unite(task.target, record["range"])
        else:
            meta.rename(record["range"], task.target)
        record["state"] = "COMPLETE"
        done += 1
    if all(x["state"] == "COMPLETE" for x in task.moves):
        if task.source not in meta.ranges:
            meta.rename(task.target, task.source)
        task.state = "COMPLETE"
    return task


@dataclass(frozen=True)
class Move:
    """A step of a balancing plan."""

    key_range: str
    source: str
    shard: str
    keys: int
    join: str


def balance(loads: list[tuple[str, str, str, int, dict[str, float]]], thresholds: dict[str, float]) -> Move | None:
    """One step that relieves the most loaded shard, or None.

    ``loads``: a bounded list, one entry a key range in key order: (range, shard, distribution, keys, metrics). A shard's
    criterion is its greatest metric in parts of the threshold; up to one nothing is moved. As many mean keys as bring it
    under the threshold go to a shard that stays under all thresholds, neighbours of the range first, then the least
    loaded; where none can take all, the number shrinks to what fits for every metric.
    """
    shards = sorted({s for _, s, *_ in loads})
    total = {s: {m: sum(x[4].get(m, 0.0) for x in loads if x[1] == s) for m in thresholds} for s in shards}
    worst = lambda s: max((total[s][m] / thresholds[m], m) for m in thresholds)
    if not shards:
        return None
    source = max(shards, key=lambda s: (worst(s)[0], s))
    criterion, metric = worst(source)
    if criterion <= 1:
        return None
    at = max((i for i, x in enumerate(loads) if x[1] == source and x[3] > 0), key=lambda i: (loads[i][4].get(metric, 0.0), -i), default=None)
    if at is None:
        return None
    name, _, distribution, keys, metrics = loads[at]
    mean = {m: metrics.get(m, 0.0) / keys for m in thresholds}
    if not mean[metric]:
        return None
    want = min(keys, math.ceil((total[source][metric] - thresholds[metric]) / mean[metric]))
    beside = [loads[i][1] for i in (at - 1, at + 1) if 0 <= i < len(loads) and loads[i][2] == distribution and loads[i][1] != source]
    others = [*dict.fromkeys(beside), *sorted((s for s in shards if s != source and s not in beside), key=lambda s: (worst(s)[0], s))]

    def fits(s: str) -> int:
        return min(int((thresholds[m] - total[s][m]) / mean[m]) if mean[m] else keys for m in thresholds)

    target = next((s for s in others if fits(s) >= want), None)
    if target is None:
        target = max(others, key=lambda s: (fits(s), s), default=None)
        if target is None or fits(target) < 1:
            return None
        want = min(want, fits(target))
    before = at > 0 and loads[at - 1][1] == target and loads[at - 1][2] == distribution
    after = at + 1 < len(loads) and loads[at + 1][1] == target and loads[at + 1][2] == distribution
    return Move(name, source, target, want, "left" if before else "right" if after else "none")
