"""Murmur3 and City hashes of key values, for literals in Python and for columns in SQL expressions.

Integers are hashed over their unsigned varint, filled with zero bytes to 8 bytes, or to 10 from 2**56 on; texts over
UTF-8. Column hashes are one arithmetic step a column, so that no expression is repeated and all of it stays in generated
code. The JVM leaves methods of over 8,000 bytes to its interpreter, so the steps are few, and those of a routing expression
are several methods. ``Steps`` are Spark's, on varints packed into one 64-bit number; a ``Program`` has the same hashes byte
by byte as DuckDB SQL.
"""

from __future__ import annotations

import itertools
import struct
import uuid as _uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF
# Fixed values of the two published 32-bit hashes.
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (32 - r)) & MASK


def _fmix(h: int) -> int:
    h = (h ^ h >> 16) * MIX1 & MASK
    h = (h ^ h >> 13) * MIX2 & MASK
    return h ^ h >> 16


def varint(value: int) -> bytes:
    """Unsigned varint of a 64-bit value, filled to 8 bytes, or to 10 from 2**56 on."""
    value &= (1 << 64) - 1
    out, rest = bytearray(), value
    while rest >= 0x80:
        out.append(rest & 0x7F | 0x80)
        rest >>= 7
    out.append(rest)
    return bytes(out).ljust(8 if value < 1 << 56 else 10, b"\0")


def murmur3(data: bytes) -> int:
    h, whole = 0, len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = _rotl(int.from_bytes(data[i : i + 4], "little") * C1 & MASK, 15) * C2 & MASK
        h = (_rotl(h ^ k, 13) * 5 + ADD) & MASK
    if len(data) > whole:
        h ^= _rotl(int.from_bytes(data[whole:], "little") * C1 & MASK, 15) * C2 & MASK
    return _fmix(h ^ len(data))


def city32(data: bytes) -> int:
    n = len(data)

    def word(i: int) -> int:
        return struct.unpack_from("<I", data, i)[0]

    def rotr(x: int, r: int) -> int:
        return _rotl(x, 32 - r)

    def scramble(a: int) -> int:
        return rotr(a * C1 & MASK, 17) * C2 & MASK

    def step(h: int, r: int = 19) -> int:
        return (rotr(h, r) * 5 + ADD) & MASK

    def mur(a: int, h: int) -> int:
        return step(h ^ scramble(a & MASK))

    if n <= 4:
        b, c = 0, 9
        for v in data:
            b = (b * C1 + (v - 256 if v > 127 else v)) & MASK
            c ^= b
        return _fmix(mur(b, mur(n, c)))
    if n <= 12:
        return _fmix(mur(9 + word(n >> 1 & 4), mur(5 * n + word(n - 4), mur(n + word(0), 5 * n))))
    if n <= 24:
        h = n
        for at in ((n >> 1) - 4, 4, n - 8, n >> 1, 0, n - 4):
            h = mur(word(at), h)
        return _fmix(h)
    h, g = n, C1 * n & MASK
    f = g
    h = step(h ^ scramble(word(n - 4)))
    h = step(h ^ scramble(word(n - 16)))
    g = step(g ^ scramble(word(n - 8)))
    g = step(g ^ scramble(word(n - 12)))
    f = step((f + scramble(word(n - 20))) & MASK)
    for at in range(0, (n - 1) // 20 * 20, 20):
        a0, a1, a2, a3, a4 = scramble(word(at)), word(at + 4), scramble(word(at + 8)), scramble(word(at + 12)), word(at + 16)
        h = step(h ^ a0, 18)
        f = rotr((f + a1) & MASK, 19) * C1 & MASK
        g = step((g + a2) & MASK, 18)
        h = step(h ^ (a3 + a1 & MASK))
        g = int.from_bytes((g ^ a4).to_bytes(4, "little"), "big") * 5 & MASK
        h = int.from_bytes((h + a4 * 5 & MASK).to_bytes(4, "little"), "big")
        f = (f + a0) & MASK
        f, h, g = g, f, h
    g = rotr(rotr(g, 11) * C1 & MASK, 17) * C1 & MASK
    f = rotr(rotr(f, 11) * C1 & MASK, 17) * C1 & MASK
    for x in (g, f):
        h = rotr(step((h + x) & MASK), 17) * C1 & MASK
    return h


HASHES = {"murmur": murmur3, "city": city32}


def hash_value(value, kind: str, method: str) -> int:
    """Hash of a typed literal; kind: integer, varchar or uuid (with or without " hashed")."""
    if kind.startswith(("integer", "uinteger")):
        data = varint(int(value))
    elif kind.startswith("uuid"):
        data = str(_uuid.UUID(str(value))).encode()
    else:
        data = str(value).encode()
    return HASHES[method](data)


def hash_tuple(values, kinds, method: str) -> int:
    """Hash of a routing expression: each value hashed, its hash as a varint, the varints hashed together."""
    return HASHES[method](b"".join(varint(hash_value(v, k, method)) for v, k in zip(values, kinds, strict=True)))


def _mul_sql(x: str, c: int) -> str:
    """x * c, 32 bits; the factor is taken as signed, so that the 64-bit product cannot overflow."""
    return f"(({x} * {c - (c >> 31 << 32)}L) & {MASK}L)"


def _rotl_sql(x: str, r: int) -> str:
    return f"((shiftleft({x}, {r}) | shiftrightunsigned({x}, {32 - r})) & {MASK}L)"


class Steps:
    """Spark arithmetic on 32-bit numbers held in 64-bit columns that are not null; what is used twice is a column."""

    _count = itertools.count()

    def __init__(self):
        self.steps: list[tuple[str, str]] = []
        self.tag = next(self._count)

    def put(self, sql: str) -> str:
        name = f"__s{self.tag}_{len(self.steps)}"
        self.steps.append((name, sql))
        return name

    def packed(self, key: str, groups: int = 8) -> str:
        """The first 8 bytes of the key's varint as one number; groups: as many of 7 bits as a key below 2**56 can have."""
        bits = " | ".join(f"shiftleft({key} & {127 << 7 * i}L, {i})" for i in range(groups))
        more = "".join(f" WHEN {key} < {1 << 7 * i + 7}L THEN {int.from_bytes(bytes([128] * i), 'little')}L" for i in range(groups))
        every = int.from_bytes(bytes([128] * 8), "little", signed=True)
        return self.put(f"({bits}) | CASE WHEN {key} < 0L THEN {every}L{more} ELSE {every}L END")

    def words(self, packed: str) -> tuple[str, str]:
        return f"({packed} & {MASK}L)", f"shiftrightunsigned({packed}, 32)"

    def scrambled(self, word: str) -> str:
        return _mul_sql(_rotl_sql(self.put(_mul_sql(word, C1)), 15), C2)

    def fold(self, h: str, word: str) -> str:
        return self.put(f"({_rotl_sql(self.put(f'{h} ^ {self.scrambled(word)}'), 13)} * 5L + {ADD}L) & {MASK}L")

    def fmix(self, h: str) -> str:
        h = self.put(h)
        h = self.put(_mul_sql(f"({h} ^ shiftrightunsigned({h}, 16))", MIX1))
        h = self.put(_mul_sql(f"({h} ^ shiftrightunsigned({h}, 13))", MIX2))
        return self.put(f"{h} ^ shiftrightunsigned({h}, 16)")

    def integer(self, key: str, method: str) -> str:
        packed = self.packed(key)
        w0, w1 = self.words(packed)
        tail = self.put(f"(shiftrightunsigned({key}, 56) & 127L) | (shiftrightunsigned({key}, 63) * 384L)")  # bytes 9 and 10
        size = f"CASE WHEN {tail} = 0L THEN 8L ELSE 10L END"
        if method == "murmur":
            h = self.fold(self.fold("0L", w0), w1)
            return self.fmix(f"{h} ^ {self.scrambled(tail)} ^ {size}")
        size = self.put(size)
        end = f"CASE WHEN {tail} = 0L THEN {w1} ELSE shiftrightunsigned({packed}, 48) | shiftleft({tail}, 16) END"
        h = self.fold(f"({size} * 5L)", f"(({w0} + {size}) & {MASK}L)")
        h = self.fold(h, f"(({end} + {size} * 5L) & {MASK}L)")
        return self.fmix(self.fold(h, f"(({w1} + 9L) & {MASK}L)"))

    def apart(self, x: str) -> str:
        """The same number; array functions end a compiled method, the steps after it are another one."""
        return self.put(f"get(transform(array({x}), x -> x), 0)")

    def combined(self, hashes: list[str]) -> str:
        """Murmur of the varints of 32-bit hashes."""
        h = "0L"
        for i, x in enumerate(hashes):
            h = self.apart(h) if i and i % 2 == 0 else h
            for word in self.words(self.packed(x, 5)):
                h = self.fold(h, word)
        return self.apart(self.fmix(f"{h} ^ {8 * len(hashes)}L"))

    def apply(self, df: DataFrame, result: str, name: str) -> DataFrame:
        """Adds the result as a column; the steps' columns go."""
        keep = df.columns
        for step, sql in self.steps:
            df = df.withColumn(step, F.expr(sql))
        return df.select(*(F.col(f"`{c}`") for c in keep), F.col(result).alias(name))


class Program:
    """DuckDB arithmetic on 32-bit numbers held in 64-bit columns, one step a column."""

    _count = itertools.count()

    def __init__(self):
        self.steps: list[tuple[str, tuple]] = []
        self.tag = next(self._count)

    def put(self, *op) -> str:
        name = f"__h{self.tag}_{len(self.steps)}"
        self.steps.append((name, op))
        return name

    def mul(self, x, c):
        return self.put("mul", x, c)

    def rotl(self, x, r):
        return self.put("rotl", x, r)

    def xor(self, x, y):
        return self.put("xor", x, y)

    def fmix(self, h):
        h = self.mul(self.put("xorshift", h, 16), MIX1)
        h = self.mul(self.put("xorshift", h, 13), MIX2)
        return self.put("xorshift", h, 16)

    def murmur(self, words, length, tail=None):
        h = "0"
        for w in words:
            k = self.mul(self.rotl(self.mul(w, C1), 15), C2)
            h = self.put("times5", self.rotl(self.xor(h, k), 13), ADD)
        if tail is not None:
            h = self.xor(h, self.mul(self.rotl(self.mul(tail, C1), 15), C2))
        return self.fmix(self.xor(h, length))

    def mur(self, a, h):
        k = self.mul(self.rotl(self.mul(a, C1), 15), C2)
        return self.put("times5", self.rotl(self.xor(h, k), 13), ADD)

    def bytes_of(self, key: str, count: int) -> list[str]:
        return [self.put("byte", key, i) for i in range(count)]

    def word(self, parts) -> str:
        return self.put("word", *parts)

    def choose(self, key, wide, narrow):
        return self.put("wide", key, wide, narrow)

    def integer(self, key: str, method: str) -> str:
        b = self.bytes_of(key, 10)
        w0, w1 = self.word(b[0:4]), self.word(b[4:8])
        if method == "murmur":
            narrow, wide = self.murmur((w0, w1), 8), self.murmur((w0, w1), 10, self.put("word", b[8], b[9]))
        else:
            add = lambda x, n: self.put("add", x, n)
            end = self.word(b[6:10])
            narrow = self.fmix(self.mur(add(w1, 9), self.mur(add(w1, 40), self.mur(add(w0, 8), "40"))))
            wide = self.fmix(self.mur(add(w1, 9), self.mur(add(end, 50), self.mur(add(w0, 10), "50"))))
        return self.choose(key, wide, narrow)

    def combined(self, hashes, method: str = "murmur") -> str:
        """Murmur of the varints of 32-bit hashes."""
        words = []
        for h in hashes:
            b = self.bytes_of(h, 8)
            words += [self.word(b[:4]), self.word(b[4:])]
        return self.murmur(words, 8 * len(hashes))

    def render(self) -> list[tuple[str, str]]:
        def expr(op):
            kind, *a = op
            if kind == "mul":
                x, c = a
                return f"((({x} * {c & 0xFFFF}) + ((({x} * {c >> 16}) & 65535) * 65536)) & {MASK})"
            if kind == "rotl":
                return f"((({a[0]} << {a[1]}) | ({a[0]} >> {32 - a[1]})) & {MASK})"
            if kind == "xor":
                return f"xor(CAST({a[0]} AS BIGINT), CAST({a[1]} AS BIGINT))"
            if kind == "xorshift":
                return f"xor({a[0]}, ({a[0]} >> {a[1]}))"
            if kind == "times5":
                return f"(({a[0]} * 5 + {a[1]}) & {MASK})"
            if kind == "add":
                return f"(({a[0]} + {a[1]}) & {MASK})"
            if kind == "byte":  # keys of oracles are not negative
                key, i = a
                return f"((({key} >> {7 * i}) & 127) | (CASE WHEN ({key} >> {min(7 * (i + 1), 63)}) <> 0 THEN 128 ELSE 0 END))"
            if kind == "word":
                return "(" + " | ".join(f"(CAST({x} AS BIGINT) << {8 * i})" for i, x in enumerate(a)) + ")"
            key, wide, narrow = a
            return f"CASE WHEN {key} < 0 OR {key} >= {1 << 56} THEN {wide} ELSE {narrow} END"

        return [(n, expr(op)) for n, op in self.steps]

    def duckdb(self, source: str, result: str, name: str) -> str:
        """A SELECT of the source's columns and the result."""
        sql = source
        for step, expr in self.render():
            sql = f"SELECT *, {expr} AS {step} FROM ({sql})"
        return f"SELECT *, {result} AS {name} FROM ({sql})"


def _text_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Murmur of a text column: words, their scrambling and the fold as array functions, the rest as steps."""
    p = Steps()
    hexed, size, ks, fold, tail = (f"__t{p.tag}_{i}" for i in range(5))

    def word(at: str, count: str) -> str:
        turned = f"concat(substr({hexed}, {at} + 6, 2), substr({hexed}, {at} + 4, 2), substr({hexed}, {at} + 2, 2), substr({hexed}, {at}, 2))"
        return f"CAST(conv({turned}, 16, 10) AS BIGINT)"

    keep = df.columns
    df = df.withColumn(hexed, F.expr(f"hex(encode({text}, 'utf-8'))")).withColumn(size, F.expr(f"length({hexed}) div 2"))
    words = f"CASE WHEN {size} >= 4 THEN transform(sequence(0, CAST({size} div 4 - 1 AS INT)), i -> {word('8 * i + 1', '4')}) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    df = df.withColumn(ks, F.expr(f"transform(transform(transform({words}, w -> {_mul_sql('w', C1)}), w -> {_rotl_sql('w', 15)}), w -> {_mul_sql('w', C2)})"))
    df = df.withColumn(fold, F.expr(f"aggregate({ks}, 0L, (h, k) -> ({_rotl_sql('(h ^ k)', 13)} * 5 + {ADD}L) & {MASK}L)"))
    rest = f"substr({hexed}, CAST({size} div 4 * 8 + 1 AS INT))"
    df = df.withColumn(tail, F.expr(f"CASE WHEN {size} % 4 = 0 THEN 0L ELSE CAST(conv(concat(substr({rest}, 5, 2), substr({rest}, 3, 2), substr({rest}, 1, 2)), 16, 10) AS BIGINT) END"))
    result = p.fmix(f"{fold} ^ {p.scrambled(tail)} ^ {size}")  # without a tail its part changes nothing
    return p.apply(df, result, name).select(*(F.col(f"`{c}`") for c in keep), name)


def _city_text(data: pd.Series) -> pd.Series:
    return data.map(lambda s: None if s is None else city32(s.encode())).astype("Int64")


def with_hash(df: DataFrame, column: str, kind: str, method: str, name: str) -> DataFrame:
    """Adds the hash of a key column. Null keys hash to null."""
    source = f"__k_{name}"
    if kind.startswith(("integer", "uinteger")):
        whole = f"{source}_0"
        df = df.withColumn(source, F.col(column).cast("long")).withColumn(whole, F.coalesce(source, F.lit(0).cast("long")))
        p = Steps()
        out = p.apply(df, p.integer(whole, method), name).drop(whole)
    else:
        text = F.col(column).cast("string")
        df = df.withColumn(source, F.lower(text) if kind.startswith("uuid") else text)
        if method == "murmur":
            out = _text_words(df, source, name)
        else:
            out = df.withColumn(name, F.pandas_udf(_city_text, T.LongType())(source))
    return out.withColumn(name, F.when(F.col(source).isNotNull(), F.col(name))).drop(source)


def with_expression_hash(df: DataFrame, columns: list[tuple[str, str]], name: str) -> DataFrame:
    """Adds the Murmur routing expression over (column, kind) pairs. A null among them gives null."""
    parts, whole = [], []
    for i, (column, kind) in enumerate(columns):
        part, p = f"__e{i}_{name}", Steps()
        df = with_hash(df, column, kind, "murmur", part).withColumn(f"{part}_0", F.coalesce(part, F.lit(0).cast("long")))
        df = p.apply(df, p.apart(f"{part}_0"), f"{part}_1").withColumn(f"{part}_1", F.coalesce(f"{part}_1", F.lit(0).cast("long"))).drop(f"{part}_0")
        parts.append(part)
        whole.append(f"{part}_1")
    p = Steps()
    out = p.apply(df, p.combined(whole), name)
    known = reduce(lambda a, b: a & b, (F.col(part).isNotNull() for part in parts))
    return out.withColumn(name, F.when(known, F.col(name))).drop(*parts, *whole)
