"""Metadata of sharded tables: distributions, relations, key ranges, reference tables, sequences and their rules."""

from __future__ import annotations

import dataclasses
import json
import math
import re
import uuid
from dataclasses import dataclass, field

from rangeloom.functions.hashing import hash_tuple, hash_value

# Key column types and their spellings in console statements.
TYPES = {"integer": "integer", "int": "integer", "integer hash": "uinteger", "int hash": "uinteger", "varchar": "varchar", "varchar hash": "varchar hashed", "uuid": "uuid", "uuid hash": "uuid hashed"}
METHODS = {"": "identity", "ident": "identity", "identity": "identity", "murmur": "murmur", "city": "city"}
REPLICATED = "REPLICATED"
INT_MIN, INT_MAX, HASH_SPACE = -(1 << 63), (1 << 63) - 1, 1 << 32
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


class MetadataError(ValueError):
    """A rule of the metadata was broken."""


def hashed(kind: str) -> bool:
    return kind in ("uinteger", "varchar hashed", "uuid hashed")


def bound(value, kind: str):
    """A typed bound or identity key; hashed kinds and integers are numbers."""
    if kind == "integer" or hashed(kind):
        try:
            number = int(str(value))
        except ValueError as e:
            raise MetadataError(f"bound {value!r} is not a number") from e
        if kind != "integer" and number < 0:
            raise MetadataError(f"bound {value!r} is negative")
        return number
    text = str(value)
    if kind == "uuid":
        text = text.lower()
        if not _UUID.fullmatch(text):
            raise MetadataError(f"bound {value!r} is not a uuid")
    return text


def least(kind: str):
    """The least value of a key column, where a default range begins."""
    return INT_MIN if kind == "integer" else 0 if hashed(kind) else "00000000-0000-0000-0000-000000000000" if kind == "uuid" else ""


@dataclass
class KeyColumn:
    """A plain key column, or a routing expression over several (column, kind) pairs."""

    name: str
    method: str = "identity"
    parts: tuple[tuple[str, str], ...] = ()


@dataclass
class Relation:
    name: str
    key: list[KeyColumn]
    schema: str = "public"
    sequences: dict[str, str] = field(default_factory=dict)


@dataclass
class Distribution:
    id: str
    kinds: list[str]
    default_shard: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)


@dataclass
class KeyRange:
    id: str
    distribution: str
    shard: str
    lower: tuple
    locked: bool = False


@dataclass
class Reference:
    name: str
    shards: list[str]
    schema: str = "public"
    sequences: dict[str, str] = field(default_factory=dict)
    version: int = 1


@dataclass
class UniqueIndex:
    id: str
    relation: str
    columns: list[str]
    kinds: list[str]


@dataclass
class Task:
    """A movement of a range's keys to another shard, batch by batch."""

    id: str
    source: str
    shard: str
    target: str
    batch: int
    state: str = "PLANNED"
    moves: list[dict] = field(default_factory=list)
    message: str = ""


class Metadata:
    """Driver-side store; every change goes through a method that keeps the rules."""

    def __init__(self, shards=()):
        self.shards: dict[str, dict] = {s: {} for s in shards}
        self.distributions: dict[str, Distribution] = {}
        self.ranges: dict[str, KeyRange] = {}
        self.references: dict[str, Reference] = {}
        self.indexes: dict[str, UniqueIndex] = {}
        self.sequences: dict[str, int] = {}
        self.tasks: dict[str, Task] = {}

    # look-ups

    def distribution(self, name: str | None) -> Distribution:
        if name is None:
            if len(self.distributions) != 1:
                raise MetadataError("distribution is ambiguous, name one with FOR DISTRIBUTION")
            return next(iter(self.distributions.values()))
        if name not in self.distributions:
            raise MetadataError(f'distribution "{name}" not found')
        return self.distributions[name]

    def range(self, name: str) -> KeyRange:
        if name not in self.ranges:
            raise MetadataError(f'key range "{name}" not found')
        return self.ranges[name]

    def shard(self, name: str) -> str:
        if name not in self.shards:
            raise MetadataError(f'shard "{name}" not found')
        return name

    def of(self, relation: str) -> tuple[Distribution, Relation]:
        for d in self.distributions.values():
            if relation in d.relations:
                return d, d.relations[relation]
        raise MetadataError(f'relation "{relation}" is not distributed')

    def sorted_ranges(self, distribution: str) -> list[KeyRange]:
        return sorted((r for r in self.ranges.values() if r.distribution == distribution), key=lambda r: r.lower)

    # distributions and relations

    def create_shard(self, name: str | None = None, **options) -> str:
        name = name or f"sh{uuid.uuid4().hex[:8]}"
        if name in self.shards:
            raise MetadataError(f'shard "{name}" already exists')
        self.shards[name] = options
        return name

    def create_distribution(self, name: str, kinds: list[str], default_shard: str | None = None) -> Distribution:
        if name in self.distributions:
            raise MetadataError(f'distribution "{name}" already exists')
        if not kinds:
            raise MetadataError("a distribution needs column types")
        self.distributions[name] = d = Distribution(name, [TYPES.get(k.lower(), k.lower()) for k in kinds])
        if unknown := [k for k in d.kinds if k not in TYPES.values()]:
            del self.distributions[name]
            raise MetadataError(f"unknown column type {unknown[0]!r}")
        if default_shard:
            self.add_default_shard(name, default_shard)
        return d

    def add_default_shard(self, distribution: str, shard: str) -> KeyRange:
        d = self.distribution(distribution)
        if d.default_shard:
            raise MetadataError(f'distribution "{distribution}" already has a default shard')
        lower = tuple(least(k) for k in d.kinds)
        if any(r.lower == lower for r in self.sorted_ranges(d.id)):
            raise MetadataError("a key range already begins at the least value")
        d.default_shard = self.shard(shard)
        r = self.ranges[f"{d.id}.DEFAULT"] = KeyRange(f"{d.id}.DEFAULT", d.id, shard, lower)
        return r

    def drop_default_shard(self, distribution: str) -> None:
        d = self.distribution(distribution)
        if not d.default_shard:
            raise MetadataError(f'distribution "{distribution}" has no default shard')
        d.default_shard = None
        del self.ranges[f"{d.id}.DEFAULT"]

    def attach(self, distribution: str | None, relation: Relation) -> Relation:
        d = self.distribution(distribution)
        if relation.name in self.references or any(relation.name in x.relations for x in self.distributions.values()):
            raise MetadataError(f'relation "{relation.name}" is already attached')
        self.check_key(d, relation.key)
        d.relations[relation.name] = relation
        return relation

    @staticmethod
    def check_key(d: Distribution, key: list[KeyColumn]) -> None:
        """As many columns as the distribution has types; hashed types need a hash, others must not have one."""
        if len(key) != len(d.kinds):
            raise MetadataError(f'distribution "{d.id}" has {len(d.kinds)} key columns, relation has {len(key)}')
        for column, kind in zip(key, d.kinds, strict=True):
            column.method = METHODS.get(column.method.lower(), column.method.lower())
            if column.method not in METHODS.values():
                raise MetadataError(f"unknown hash function {column.method!r}")
            if hashed(kind) == (column.method == "identity"):
                raise MetadataError(f'type "{kind}" and hash "{column.method}" don\'t agree')

    def detach(self, distribution: str, relation: str) -> None:
        d = self.distribution(distribution)
        if d.relations.pop(relation, None) is None:
            raise MetadataError(f'relation "{relation}" is not attached to "{distribution}"')

    def create_reference(self, name: str, shards=None, sequences: dict[str, int] | None = None) -> Reference:
        if name in self.references or any(name in d.relations for d in self.distributions.values()):
            raise MetadataError(f'relation "{name}" is already attached')
        made = {}
        for column, start in (sequences or {}).items():
            made[column] = f"{name}_{column}"
            self.sequences[made[column]] = start
        self.references[name] = r = Reference(name, [self.shard(s) for s in shards or self.shards], sequences=made)
        return r

    def create_unique_index(self, name: str, relation: str, columns: list[str], kinds: list[str]) -> UniqueIndex:
        if name in self.indexes:
            raise MetadataError(f'unique index "{name}" already exists')
        self.of(relation)
        self.indexes[name] = i = UniqueIndex(name, relation, columns, kinds)
        return i

    def next_range(self, sequence: str, size: int = 1) -> range:
        """The next ``size`` values of a sequence."""
        if size < 1:
            raise MetadataError("a sequence range has at least one value")
        if sequence not in self.sequences:
            raise MetadataError(f'sequence "{sequence}" not found')
        last = self.sequences[sequence]
        self.sequences[sequence] = last + size
        return range(last + 1, last + size + 1)

    # key ranges

    def _new_range(self, r: KeyRange) -> KeyRange:
        if r.id in self.ranges:
            raise MetadataError(f'key range "{r.id}" already exists')
        self.shard(r.shard)
        d = self.distribution(r.distribution)
        if len(r.lower) != len(d.kinds):
            raise MetadataError(f"a bound of {len(d.kinds)} columns is needed")
        r.lower = tuple(bound(v, k) for v, k in zip(r.lower, d.kinds, strict=True))
        below = [x for x in self.sorted_ranges(d.id) if x.lower <= r.lower and x.id != f"{d.id}.DEFAULT"]
        if below and below[-1].lower == r.lower:
            raise MetadataError(f'key range "{below[-1].id}" has the same lower bound')
        if below and below[-1].shard != r.shard:
            raise MetadataError(f'key range "{r.id}" intersects with key range "{below[-1].id}"')
        self.ranges[r.id] = r
        return r

    def create_range(self, name: str | None, lower, shard: str, distribution: str | None = None) -> KeyRange:
        d = self.distribution(distribution)
        return self._new_range(KeyRange(name or f"kr{uuid.uuid4().hex[:8]}", d.id, shard, tuple(lower)))

    def equal_split(self, distribution: str | None, between=None, shards=None) -> list[KeyRange]:
        """One range a shard, equally long; the first shard gets the last part."""
        d = self.distribution(distribution)
        if len(d.kinds) != 1 or d.kinds[0] in ("varchar", "uuid"):
            raise MetadataError("only one numeric key column can be split equally")
        if d.relations and self.sorted_ranges(d.id):
            raise MetadataError("the distribution already has key ranges")
        low, high = between or ((INT_MIN, INT_MAX) if d.kinds[0] == "integer" else (0, HASH_SPACE - 1))
        names = [self.shard(s) for s in shards or self.shards]
        step = (high - low) // len(names)
        if step < 1:
            raise MetadataError("the range is too short for the shards")
        made = []
        for i, s in enumerate(names):
            made.append(self._new_range(KeyRange(f"{d.id}-{i}", d.id, s, (low + step * (len(names) - 1 - i),))))
        return made

    def split(self, new: str, source: str, at) -> KeyRange:
        """The part of ``source`` from ``at`` on becomes a range of its own on the same shard."""
        r = self.range(source)
        d = self.distribution(r.distribution)
        at = tuple(bound(v, k) for v, k in zip(at, d.kinds, strict=True))
        if new in self.ranges:
            if self.ranges[new].lower == at and self.ranges[new].shard == r.shard:
                return self.ranges[new]
            raise MetadataError(f'key range "{new}" already exists')
        if r.locked:
            raise MetadataError(f'key range "{source}" is locked')
        later = [x.lower for x in self.sorted_ranges(d.id) if x.lower > r.lower]
        if at <= r.lower or later and at > later[0]:
            raise MetadataError(f'bound is out of key range "{source}"')
        if later and at == later[0]:
            raise MetadataError(f'key range "{new}" intersects with the next key range')
        self.ranges[new] = made = KeyRange(new, d.id, r.shard, at)
        return made

    def unite(self, base: str, other: str) -> KeyRange:
        """Two neighbours on one shard become one; it keeps the base's name and the smaller bound."""
        a, b = self.range(base), self.range(other)
        if a.distribution != b.distribution:
            raise MetadataError("key ranges belong to different distributions")
        if a.shard != b.shard:
            raise MetadataError("key ranges are on different shards")
        if a.locked or b.locked:
            raise MetadataError("a key range is locked")
        order = [r.id for r in self.sorted_ranges(a.distribution)]
        if abs(order.index(a.id) - order.index(b.id)) != 1:
            raise MetadataError("key ranges are not adjacent")
        a.lower = min(a.lower, b.lower)
        del self.ranges[other]
        return a

    def move(self, name: str, shard: str) -> KeyRange:
        r = self.range(name)
        if r.locked:
            raise MetadataError(f'key range "{name}" is locked')
        r.shard = self.shard(shard)
        return r

    def rename(self, old: str, new: str) -> KeyRange:
        r = self.range(old)
        if new in self.ranges:
            raise MetadataError(f'key range "{new}" already exists')
        r.id = new
        self.ranges[new] = self.ranges.pop(old)
        return r

    def lock(self, name: str, on: bool = True) -> None:
        for r in list(self.ranges.values()) if name.upper() == "ALL" else [self.range(name)]:
            r.locked = on

    # routing of literals

    def key_of(self, distribution: Distribution, relation: Relation | None, values) -> tuple:
        """The routed form of a key's literals: hashed where the relation says so."""
        out, values = [], list(values)
        relations = list(distribution.relations.values())
        if relation is None and len({tuple(c.method for c in r.key) for r in relations}) > 1:
            raise MetadataError("relations of the distribution hash differently, name one")
        key = (relation or (relations[0] if relations else None)).key if relation or relations else [KeyColumn("", "identity" if not hashed(k) else "murmur") for k in distribution.kinds]
        for column, kind in zip(key, distribution.kinds, strict=True):
            if column.parts:
                part, values = values[: len(column.parts)], values[len(column.parts) :]
                out.append(hash_tuple(part, [k for _, k in column.parts], column.method))
            else:
                value = values.pop(0)
                out.append(bound(value, kind) if column.method == "identity" else hash_value(value, "integer" if kind == "uinteger" else kind, column.method))
        return tuple(out)

    def locate(self, distribution: Distribution, key: tuple) -> KeyRange:
        """The range with the greatest lower bound up to the key."""
        found = [r for r in self.sorted_ranges(distribution.id) if r.lower <= key]
        if not found:
            raise MetadataError(f"failed to match key {key} with ranges")
        if found[-1].locked:
            raise MetadataError(f'key range "{found[-1].id}" is locked')
        return found[-1]

    # coverage and dumps

    def coverage(self, r: KeyRange) -> str:
        """Share of the key type's domain, from exact numbers."""
        d = self.distributions[r.distribution]
        if d.kinds[0] in ("varchar", "uuid"):
            return "N/A"
        low, high = (INT_MIN, INT_MAX) if d.kinds[0] == "integer" else (0, HASH_SPACE - 1)
        later = [x.lower[0] for x in self.sorted_ranges(d.id) if x.lower > r.lower]
        share = ((later[0] if later else high) - r.lower[0]) / (high - low) * 100
        return f"{math.floor(share * 100 + 0.5) / 100:.2f}%"

    def dump(self) -> str:
        return json.dumps({k: {n: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else v for n, v in part.items()} for k, part in vars(self).items()}, sort_keys=True)

    @classmethod
    def load(cls, text: str) -> Metadata:
        data, m = json.loads(text), cls()
        column = lambda c: KeyColumn(c["name"], c["method"], tuple(map(tuple, c["parts"])))
        m.shards, m.sequences = data["shards"], data["sequences"]
        for n, d in data["distributions"].items():
            relations = {k: Relation(r["name"], [column(c) for c in r["key"]], r["schema"], r["sequences"]) for k, r in d["relations"].items()}
            m.distributions[n] = Distribution(d["id"], d["kinds"], d["default_shard"], relations)
        m.ranges = {n: KeyRange(r["id"], r["distribution"], r["shard"], tuple(r["lower"]), r["locked"]) for n, r in data["ranges"].items()}
        m.references = {n: Reference(**r) for n, r in data["references"].items()}
        m.indexes = {n: UniqueIndex(**r) for n, r in data["indexes"].items()}
        m.tasks = {n: Task(**r) for n, r in data["tasks"].items()}
        return m
