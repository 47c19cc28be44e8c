"""Which key ranges a predicate can touch, and the predicate on the key that says so to the scan.

A node's value is a set of boxes: for each key column an interval (low, low closed, high, high closed), or None for all
keys. Conjunctions intersect boxes, disjunctions join them, whatever isn't understood is None. Pruning only ever adds a
conjunct to the user's own predicate, so it can't change a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeloom.functions.hashing import hash_value
from rangeloom.plans.model import Distribution, KeyRange, Metadata, MetadataError, Relation, bound

#: An interval without ends.
FULL = (None, True, None, True)
#: More boxes than this count as all keys.
MOST_BOXES = 256


def _meet(a, b):
    low, low_in = max(((x[0], not x[1]) for x in (a, b) if x[0] is not None), default=(None, False), key=lambda t: t)
    high, high_in = min(((x[2], x[3]) for x in (a, b) if x[2] is not None), default=(None, True), key=lambda t: t)
    out = (low, not low_in, high, high_in)
    if low is not None and high is not None and (low > high or low == high and not (out[1] and out[3])):
        return None
    return out


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    out = []
    for x in a:
        for y in b:
            box = tuple(_meet(i, j) for i, j in zip(x, y, strict=True))
            if None not in box:
                out.append(box)
    return out if len(out) <= MOST_BOXES else a


def _literal(value, kind: str):
    """A literal coerced to an identity key; None if it can't be compared as one."""
    try:
        if kind == "integer":
            if isinstance(value, float):
                return None
            return int(value)
        return bound(value, kind) if isinstance(value, str) else None
    except (MetadataError, ValueError):
        return None


def boxes(tree, d: Distribution, relation: Relation):
    """Boxes over the routed key columns, or None for all."""
    names = [c.name.lower() for c in relation.key]
    width = len(names)

    def single(i: int, interval):
        return tuple(interval if j == i else FULL for j in range(width))

    def point(column: str, value):
        i = names.index(column)
        key, kind = relation.key[i], d.kinds[i]
        if key.parts:
            return None
        if key.method == "identity":
            v = _literal(value, kind)
        else:
            try:
                plain = "integer" if kind == "uinteger" else kind
                v = None if isinstance(value, float) or (plain == "integer") != isinstance(value, int) else hash_value(value, plain, key.method)
            except ValueError:
                v = None
        return None if v is None else single(i, (v, True, v, True))

    def walk(node):
        if node[0] == "and":
            return _both(walk(node[1]), walk(node[2]))
        if node[0] == "or":
            a, b = walk(node[1]), walk(node[2])
            return None if a is None or b is None or len(a) + len(b) > MOST_BOXES else a + b
        if node[0] == "in" and node[1].lower() in names:
            found = [point(node[1].lower(), v) for v in node[2]]
            return None if None in found or len(found) > MOST_BOXES else found
        if node[0] == "cmp" and node[1].lower() in names:
            column, sign, value = node[1].lower(), node[2], node[3]
            if sign == "=":
                box = point(column, value)
                return None if box is None else [box]
            i = names.index(column)
            if relation.key[i].method != "identity" or relation.key[i].parts or sign == "<>":
                return None
            v = _literal(value, d.kinds[i])
            if v is None:
                return None
            return [single(i, {"<": (None, True, v, False), "<=": (None, True, v, True), ">": (v, False, None, True), ">=": (v, True, None, True)}[sign])]
        return None

    return walk(tree)


def _touches(box, lower: tuple, upper: tuple | None) -> bool:
    """Whether a box can hold a key from the lower bound up to, but without, the upper one."""
    # greatest tuple of the box against the lower bound, column by column
    for (_, _, high, high_in), low in zip(box, lower, strict=True):
        if high is None or high > low:
            break
        if high < low or not high_in:
            return False
    if upper is None:
        return True
    for (low, _, high, _), up in zip(box, upper, strict=True):
        if low is None or low < up:
            return True
        if low > up:
            return False
    return False  # the box begins at the upper bound


def ranges(meta: Metadata, relation: str, tree) -> list[KeyRange]:
    """The relation's key ranges that a predicate can touch, in order."""
    d, r = meta.of(relation)
    own = meta.sorted_ranges(d.id)
    found = boxes(tree, d, r)
    if found is None:
        return own
    upper = [x.lower for x in own[1:]] + [None]
    return [x for x, up in zip(own, upper, strict=True) if any(_touches(b, x.lower, up) for b in found)]


def condition(meta: Metadata, relation: str, tree) -> Column | None:
    """A condition on the first key column that holds for every row of the pruned ranges; None if it says nothing.

    It consists of plain comparisons, so that the scan can use it; hashed keys have none, as their order is not the column's.
    """
    d, r = meta.of(relation)
    first = r.key[0]
    if first.method != "identity" or first.parts or d.kinds[0] == "uuid":
        return None
    own = meta.sorted_ranges(d.id)
    kept = ranges(meta, relation, tree)
    if len(kept) == len(own) or not own:
        return None
    place = {x.id: i for i, x in enumerate(own)}
    spans: list[list[int]] = []
    for x in kept:
        i = place[x.id]
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    key, out = F.col(first.name), None
    for a, b in spans:
        part = key >= F.lit(own[a].lower[0]) if a else None
        if b < len(own):
            # with more key columns, rows up to the next bound's first value may belong to the range
            end = key < F.lit(own[b].lower[0]) if len(r.key) == 1 else key <= F.lit(own[b].lower[0])
            part = end if part is None else part & end
        out = part if out is None else out | part
    if out is None:
        return F.lit(False) if not _below(boxes(tree, d, r), own) else None
    # keys below the first range belong to none, but the user's predicate may still ask for them
    low = key < F.lit(own[0].lower[0]) if len(r.key) == 1 else key <= F.lit(own[0].lower[0])
    return out | low if _below(boxes(tree, d, r), own) and kept and kept[0] is not own[0] else out


def _below(found, own: list[KeyRange]) -> bool:
    """Whether a box holds keys below the first range."""
    if found is None:
        return True
    return any(b[0][0] is None or (b[0][0],) < own[0].lower[:1] or len(own[0].lower) > 1 and b[0][0] <= own[0].lower[0] for b in found)
