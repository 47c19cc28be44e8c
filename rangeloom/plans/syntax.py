"""Tokens, predicates and comment hints of SQL texts, as far as pruning and the console need them."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_][\w$.-]*)|(?P<sign><>|!=|<=|>=|[-+*/%(),;=<>\[\]:]))")
_HINT = re.compile(r"/\*(.*?)\*/", re.S)


class SyntaxProblem(ValueError):
    """A statement that can't be read."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def value(self):
        if self.kind == "string":
            return self.text[1:-1].replace("''", "'")
        if self.kind == "quoted":
            return self.text[1:-1].replace('""', '"')
        if self.kind == "number":
            return float(self.text) if "." in self.text else int(self.text)
        return self.text


def tokens(text: str) -> list[Token]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.end() == at:
            raise SyntaxProblem(f"unexpected text at {text[at : at + 20]!r}")
        out.append(Token(m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class Reader:
    """A position in a list of tokens."""

    def __init__(self, items: list[Token]):
        self.items, self.at = items, 0

    def peek(self, *words: str) -> bool:
        part = self.items[self.at : self.at + len(words)]
        return len(part) == len(words) and all(t.kind in ("word", "sign") and t.text.upper() == w for t, w in zip(part, words, strict=True))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxProblem(f"expected {' '.join(words)} at {self.rest()[:40]!r}")

    def next(self) -> Token:
        if self.at >= len(self.items):
            raise SyntaxProblem("unexpected end")
        self.at += 1
        return self.items[self.at - 1]

    def name(self) -> str:
        t = self.next()
        if t.kind not in ("word", "quoted", "string"):
            raise SyntaxProblem(f"expected a name, not {t.text!r}")
        return t.value

    def listed(self, one):
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    @property
    def done(self) -> bool:
        return self.at >= len(self.items)

    def rest(self) -> str:
        return " ".join(t.text for t in self.items[self.at :])


#: Predicates: ("and"|"or", left, right), ("not", x), ("cmp", column, sign, value), ("in", column, values), ("other",).
OTHER = ("other",)


def predicate(text: str):
    """The part of a condition that pruning understands; anything else is OTHER."""
    try:
        r = Reader(tokens(text))
        tree = _or(r)
        return tree if r.done else OTHER
    except SyntaxProblem:
        return OTHER


def _or(r: Reader):
    left = _and(r)
    while r.take("OR"):
        left = ("or", left, _and(r))
    return left


def _and(r: Reader):
    left = _not(r)
    while r.take("AND"):
        left = ("and", left, _not(r))
    return left


def _not(r: Reader):
    if r.take("NOT"):
        return ("not", _not(r))
    return _atom(r)


_ENDS = ("AND", "OR")
_TURNED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<=", "<>": "<>", "!=": "<>"}


def _atom(r: Reader):
    start = r.at
    if r.take("("):
        tree = _or(r)
        if r.take(")") and (r.done or any(r.peek(w) for w in (*_ENDS, ")"))):
            return tree
        r.at = start
        return _skip(r)
    left = r.next()
    if left.kind in ("word", "quoted"):
        column = left.value.rsplit(".", 1)[-1]
        if r.take("IN", "("):
            values = []
            while not r.done and r.items[r.at].kind in ("number", "string"):
                values.append(r.next().value)
                if not r.take(","):
                    break
            if values and r.take(")"):
                return ("in", column, values)
        elif r.take("BETWEEN"):
            low = r.next()
            if low.kind in ("number", "string") and r.take("AND"):
                high = r.next()
                if high.kind in ("number", "string") and (r.done or any(r.peek(w) for w in (*_ENDS, ")"))):
                    return ("and", ("cmp", column, ">=", low.value), ("cmp", column, "<=", high.value))
        elif not r.done and r.items[r.at].text in _TURNED:
            sign, right = r.next().text, r.next()
            if right.kind in ("number", "string") and (r.done or any(r.peek(w) for w in (*_ENDS, ")"))):
                return ("cmp", column, "<>" if sign == "!=" else sign, right.value)
    elif left.kind in ("number", "string") and not r.done and r.items[r.at].text in _TURNED:
        sign, right = r.next().text, r.next()
        if right.kind in ("word", "quoted") and (r.done or any(r.peek(w) for w in (*_ENDS, ")"))):
            return ("cmp", right.value.rsplit(".", 1)[-1], _TURNED[sign], left.value)
    r.at = start
    return _skip(r)


def _skip(r: Reader):
    """Anything up to the next AND or OR of this level."""
    depth, between = 0, False
    while not r.done:
        if depth == 0 and (r.peek("OR") or r.peek(")") or r.peek("AND") and not between):
            break
        if r.peek("AND"):
            between = False
        t = r.next()
        depth += (t.text == "(") - (t.text == ")")
        between = between or t.text.upper() == "BETWEEN"
    return OTHER


def hints(text: str) -> tuple[dict[str, str], str]:
    """(settings, statement) of a text with /* key: value, key: value */ comments."""
    found: dict[str, str] = {}
    for part in _HINT.findall(text):
        for pair in part.split(","):
            key, sign, value = pair.partition(":")
            if sign:
                key = key.strip().lower()
                if key.startswith("__") and "." in key:
                    key = key.split(".", 1)[1]
                found[re.sub(r"^__[a-z]+__", "", key)] = value.strip().strip("'\"")
    return found, _HINT.sub(" ", text).strip()


def truth(value: str) -> bool:
    """Boolean spellings of settings."""
    word = value.strip().lower()
    if word in ("true", "ok", "on"):
        return True
    if word in ("false", "no", "off"):
        return False
    raise SyntaxProblem(f"{value!r} is not a truth value")
