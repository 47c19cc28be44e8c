"""Which shards a whole statement needs, read off Spark's own plans.

The analysed plan names the registered tables that a statement reads, wherever they stand: joins, set operations, common
table expressions, subqueries. The optimised plan has the conditions that reach each of them, also those that follow from
equalities with other tables, so a join is pruned by either side's key. What can't be told apart counts as the whole table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from rangeloom.plans.syntax import OTHER, predicate

_SUFFIX = re.compile(r"(?<![\w'])(-?\d+)[LSY]\b")


@dataclass
class Scan:
    """A table that a statement reads, with the condition on its rows; None where the optimiser has dropped the table."""

    table: str
    columns: dict = field(default_factory=dict)
    tree: object = OTHER


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan):
    yield plan
    for child in _list(plan.children()):
        yield from _walk(child)
    for inner in _list(plan.subqueries()):
        yield from _walk(inner)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _ids(attributes) -> dict[int, str]:
    return {a.exprId().id(): a.name() for a in _list(attributes)}


def _text(condition) -> str:
    return _SUFFIX.sub(r"\1", condition.sql().replace("`", '"'))


def _values(node, column: int) -> list | None:
    """A column of rows that stand in the statement itself."""
    index = next((i for i, a in enumerate(_list(node.output())) if a.exprId().id() == column), None)
    if index is None:
        return None
    kind = _list(node.output())[index].dataType()
    if kind.simpleString() not in ("int", "bigint", "string"):
        return None
    found = [row.get(index, kind) for row in _list(node.data())]
    return [str(v) if kind.simpleString() == "string" else int(v) for v in found if v is not None]


def _joined_values(optimised, tables: dict[int, tuple[Scan, str]]) -> None:
    """key = column of a VALUES list, in a join that keeps no row of the table without a partner: the key is one of the values."""
    lists = [n for n in _walk(optimised) if _kind(n) == "LocalRelation" and n.data().size() <= 256]
    for node in _walk(optimised) if lists else ():
        if _kind(node) != "Join" or node.condition().isEmpty():
            continue
        sides = [{i for leaf in _walk(side) for i in _ids(leaf.output())} for side in (node.left(), node.right())]
        kept = {"Inner": (), "Cross": (), "LeftOuter": (0,), "LeftSemi": (), "RightOuter": (1,)}.get(node.joinType().toString(), (0, 1))
        stack = [node.condition().get()]
        while stack:
            e = stack.pop()
            if _kind(e) == "And":
                stack += [e.left(), e.right()]
            if _kind(e) != "EqualTo":
                continue
            ends = [x.child() if _kind(x) == "Cast" else x for x in (e.left(), e.right())]
            if not all(_kind(x) == "AttributeReference" for x in ends):
                continue
            a, b = (x.exprId().id() for x in ends)
            for key, other in ((a, b), (b, a)):
                found = next((v for n in lists if (v := _values(n, other)) is not None), None)
                if key in tables and found and not any(key in sides[s] for s in kept):
                    scan, column = tables[key]
                    part = ("in", column, found)
                    scan.tree = part if scan.tree == OTHER else ("and", scan.tree, part)


def scans(df, names) -> list[Scan]:
    """The registered tables that a query reads, each with the condition that reaches it."""
    execution = df._jdf.queryExecution()
    out, of = [], {}
    for node in _walk(execution.analyzed()):
        if _kind(node) == "SubqueryAlias" and _kind(node.child()) == "View" and node.identifier().name() in names:
            scan = Scan(node.identifier().name(), _ids(node.child().output()))
            out.append(scan)
            of |= {i: (scan, c) for i, c in scan.columns.items()}
    if not out:
        return out
    optimised = execution.optimizedPlan()
    conditions: dict[int, list] = {}

    def visit(node, above):
        if _kind(node) == "Filter":
            above = [*above, node.condition()]
        elif _kind(node) != "Project":
            found = {id(of[i][0]): of[i][0] for i in _ids(node.output()) if i in of} if node.children().isEmpty() else {}
            for scan in found.values():
                conditions.setdefault(id(scan), []).append((scan, [_text(c) for c in above]))
            above = []
        for child in _list(node.children()):
            visit(child, above)
        for inner in _list(node.subqueries()):
            visit(inner, [])

    visit(optimised, [])
    for scan in out:
        places = conditions.get(id(scan), [])
        if len(places) == 1:  # a table read at several places of the optimised plan counts as whole
            for text in places[0][1]:
                part = predicate(text)
                scan.tree = part if scan.tree == OTHER else ("and", scan.tree, part)
    _joined_values(optimised, of)
    return out
