"""Dispatch plans: which shards a statement needs, and how plans of its parts combine."""

from __future__ import annotations

from dataclasses import dataclass, field


class DispatchError(ValueError):
    """A statement may not run on the shards it needs."""


@dataclass(frozen=True)
class Virtual:
    """Rows made on the driver."""


@dataclass(frozen=True)
class AnyShard:
    """Any one of the shards; empty: any at all."""

    shards: frozenset = frozenset()


@dataclass(frozen=True)
class OneShard:
    shard: str


@dataclass(frozen=True)
class Scatter:
    """Some shards; None: all. Overrides: texts for single shards."""

    shards: frozenset | None = None
    overrides: dict = field(default_factory=dict, hash=False)


def _joined(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    return None if a is None or b is None else a | b


def combine(a, b):
    """The plan that serves both parts of a statement."""
    if a is None or b is None:
        return b if a is None else a
    if isinstance(b, Virtual) and not isinstance(a, Virtual):
        a, b = b, a
    if isinstance(a, Virtual):
        return b
    if isinstance(a, AnyShard):
        return b
    if isinstance(b, AnyShard):
        return a
    if isinstance(a, OneShard) and isinstance(b, OneShard):
        return a if a == b else Scatter(frozenset({a.shard, b.shard}))
    if isinstance(a, OneShard) and isinstance(b, Scatter):
        return Scatter(_joined(frozenset({a.shard}), b.shards))
    if isinstance(a, Scatter) and isinstance(b, OneShard):
        return Scatter(_joined(a.shards, frozenset({b.shard})), a.overrides)
    if isinstance(a, Scatter) and isinstance(b, Scatter):
        return Scatter(_joined(a.shards, b.shards), a.overrides | b.overrides)
    return Scatter()


def of_shards(shards: list[str], everything: list[str]):
    """The plan for a list of shards."""
    names = frozenset(shards)
    if len(names) == 1:
        return OneShard(next(iter(names)))
    return Scatter() if names == frozenset(everything) else Scatter(names)


def finalize(plan, everything: list[str], behaviour: str = "ALLOW") -> list[str]:
    """The shards a plan runs on. BLOCK refuses more than one; a shard's name pins statements that need several."""
    if plan is None or isinstance(plan, Virtual):
        return []
    if isinstance(plan, OneShard):
        return [plan.shard]
    if isinstance(plan, AnyShard):
        return sorted(plan.shards or everything)[:1]
    shards = sorted(everything if plan.shards is None else plan.shards)
    if len(shards) > 1:
        if behaviour.upper() == "BLOCK":
            raise DispatchError("the statement needs more than one shard")
        if behaviour.upper() != "ALLOW":
            if behaviour not in everything:
                raise DispatchError(f'shard "{behaviour}" not found')
            return [behaviour]
    return shards
