"""Information-theoretic sanitisation of personal data.

Base entities are e-mail addresses, IP addresses, card and phone numbers. The words around each entity are its
context. Over the whole corpus, a term t within ``WINDOW`` words of an entity e in a share P(e|t) of its occurrences
reveals it by log2 P(e|t)/P(e) bits. Terms with at least ``SUPPORT`` different contexts, ``GENERALISE`` of their
occurrences and ``BITS`` bits disclose the entity: they are generalised to the entity's kind, from ``REMOVE`` on removed,
wherever they stand. Contexts that are copies of each other count once as support.

Three passes read the documents: contexts; counts of the context terms; spans. Terms travel to the tasks as a bitmap of
``FILTER_BITS`` bits, whose size does not grow with the data; its false hits are taken out by an exact join on the term.

Defined cases. Null text counts as empty and has no spans. Offsets are code points, ends exclusive. Overlapping spans of
different kinds are all reported; the sanitised text replaces their union once, under the first kind. Repeated
rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import materialize, record_batch, sliced, strings, table
from rangeloom.llm.rows import rewritten

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, GENERALISE, REMOVE, BITS = 6, 3, 0.5, 0.9, 6.0
FILTER_BITS = 1 << 23

# The forms of base entities.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        nxt = at + 1
        if (m := _DOMAIN.match(text, at + 1)) is not None:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = nxt = m.end()
        at = text.find("@", nxt)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _contexts(text: str, spans):
    """(kind:value, its context's words, those of them that no other mention of it has counted, hash of the context) of each base span."""
    places = [m.span() for m in _WORD.finditer(text)] if spans else []
    begins, ends = [s for s, _ in places], [e for _, e in places]
    counted = set()
    for start, kind, end in spans:
        before, behind = bisect_right(ends, start), bisect_left(begins, end)
        around = [*range(max(0, before - WINDOW), before), *range(behind, min(len(places), behind + WINDOW))]
        entity, words = f"{KINDS[kind]}:{text[start:end]}", [text[begins[i] : ends[i]].lower() for i in around]
        fresh = [w for i, w in zip(around, words, strict=True) if (entity, i) not in counted]
        counted.update((entity, i) for i in around)
        yield entity, words, fresh, zlib.crc32(" ".join(words).encode()) if words else 0


def contexts(docs: DataFrame) -> DataFrame:
    """entity, term, context, n: occurrences of terms beside all base entities of (doc_id, text), each once for an entity."""
    fields = [("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("n", pa.int64())]

    def run(batches):
        for b in sliced(batches):
            seen = Counter()
            for t in strings(b.column(1)):
                for entity, words, fresh, context in _contexts(t, base_spans(t)):
                    seen.update(dict.fromkeys(((entity, w, context) for w in words), 0))  # also a word that counts elsewhere has this context
                    seen.update((entity, w, context) for w in fresh)
            if seen:
                yield record_batch(fields, [*zip(*seen, strict=True), list(seen.values())])

    return docs.mapInArrow(run, "entity string, term string, context long, n long")


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (FILTER_BITS - 1)


def bitmap(terms: DataFrame) -> bytes:
    """FILTER_BITS bits, set at each term's slot; the driver gets at most one number for each 32 bits."""
    slot = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = terms.select(F.shiftright(slot, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 32, "<u4")
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.tobytes()


def _member(data: bytes):
    def has(term: str) -> bool:
        k = _slot(term)
        return bool(data[k >> 3] >> (k & 7) & 1)

    return has


def term_counts(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, n over all texts) of the given terms, and a row count of all words under the term ''."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms))
    fields = [("term", pa.string()), ("n", pa.int64())]

    def run(batches):
        has = _member(shared.value)
        for b in sliced(batches):
            seen = Counter()
            for t in strings(b.column(1)):
                seen.update(_WORD.findall(t.lower()))
            total = sum(seen.values())
            kept = {w: n for w, n in seen.items() if has(w)}
            kept[""] = total
            yield record_batch(fields, [list(kept), list(kept.values())])

    return docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame) -> DataFrame:
    """term, entity_kind, p, bits: the terms over the thresholds, one row each (their most revealed entity)."""
    pairs = materialize(contexts(docs), "contexts")
    joint = pairs.groupBy("entity", "term", "context").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("support"))
    joint = materialize(joint.where(F.col("support") >= SUPPORT), "joint")
    counted = materialize(term_counts(docs, joint.select("term").distinct()), "terms")
    total = counted.where("term = ''").agg(F.sum("n")).first()[0] or 1
    entities = pairs.groupBy("entity").agg(F.sum("n").alias("positions"))
    p, prior = F.col("joint") / F.col("n"), F.col("positions") / F.lit(float(total))
    scored = joint.join(counted.where("term <> ''"), "term").where(p >= GENERALISE).join(entities, "entity")
    scored = scored.select("term", F.split("entity", ":").getItem(0).alias("entity_kind"), p.alias("p"), F.log2(p / prior).alias("bits"))
    best = scored.where(F.col("bits") >= BITS).groupBy("term").agg(F.max(F.struct("p", "bits", "entity_kind")).alias("b"))
    return materialize(best.select("term", "b.entity_kind", "b.p", "b.bits"), "disclosing")


_ROWS = [("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("base", pa.string()), ("term", pa.string()), ("spots", pa.string())]


def spans(docs: DataFrame, flagged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """part, row, doc_id, base and terms (kind:start:end, comma-joined) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(flagged.select("term")))

    def run(batches):
        has = _member(shared.value)
        part, row = TaskContext.get().partitionId(), 0
        for b in sliced(batches):
            texts = strings(b.column(1))
            words = [set(_WORD.findall(t.lower())) for t in texts]
            local = {w for w in set().union(*words) if has(w)}
            out = []
            for key, t, seen in zip(b.column(0).to_pylist(), texts, words, strict=True):
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(t))
                spots: dict[str, list[str]] = {}
                if not local.isdisjoint(seen):
                    for m in _WORD.finditer(t):
                        if (w := m.group().lower()) in local:
                            spots.setdefault(w, []).append(f"{m.start()}:{m.end()}")
                out.append((part, row, key, base, None, None))
                out += [(part, row, key, None, w, ",".join(x)) for w, x in spots.items()]
                row += 1
            yield record_batch(_ROWS, list(zip(*out, strict=True)))

    rows = materialize(docs.mapInArrow(run, "part int, row long, doc_id long, base string, term string, spots string"), "spans")
    found = rows.where("term is not null").join(flagged, "term").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("term", "entity_kind", "p", "spots"))).alias("terms"))
    return rows.where("term is null").select("part", "row", "doc_id", "base").join(found, ["part", "row"], "left")


_RESULT = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_term", pa.int64())]


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of the rows of ``spans``."""

    def run(batches):
        for b in batches:
            out = []
            for key, base, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = base.split(",") if base else []
                n = Counter(p.split(":", 1)[0] for p in parts)
                extra = [f"term:{s}" for t in terms or () for s in t["spots"].split(",")]
                if extra:
                    order = {k: i for i, k in enumerate((*KINDS, "term"))}
                    everything = sorted(parts + extra, key=lambda p: (int(p.split(":")[1]), order[p.split(":")[0]], int(p.split(":")[2])))
                else:
                    everything = parts
                out.append((key, *(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(everything), len(extra)))
            if out:
                yield record_batch(_RESULT, list(zip(*out, strict=True)))

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    return found.select("doc_id", "base", "terms").mapInArrow(run, schema)


def sanitised_text(text: str, terms: dict[str, tuple[str, float]]) -> str:
    """Base entities become their kind; disclosing terms become their entity's kind, or nothing if they give it away."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base_spans(text)]
    if terms:
        for m in _WORD.finditer(text):
            if (hit := terms.get(m.group().lower())) is not None:
                marks.append((m.start(), m.end(), "" if hit[1] >= REMOVE else f"[{hit[0]}]"))
    out, at = [], 0
    for s, e, mark in sorted(marks, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame) -> DataFrame:
    """The table with sanitised texts; n_chars, where there is one, follows. Null texts stay null.

    Texts without a disclosing term are rewritten in place; the few others meet their terms in a join by term.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flagged = disclosing(rows)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(flagged.select("term")))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hits(texts):
        has = _member(shared.value)
        words = [set(_WORD.findall(t.lower())) for t in texts]
        local = {w for w in set().union(*words) if has(w)}
        return [sorted(local & w) for w in words]

    def changed(batch, terms):
        texts = [None if t is None else sanitised_text(t, x) for t, x in zip(batch.column(at).to_pylist(), terms, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        if size is not None:
            columns[size] = pa.array([None if t is None else len(t) for t in texts], columns[size].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    def plain(batch, extras):
        for b in sliced([batch]):
            b = b.filter(pa.array([not h for h in hits(strings(b.column(at)))], pa.bool_()))
            yield changed(b, [{}] * b.num_rows)

    easy = rewritten(docs, {}, lambda: plain)
    if flagged.isEmpty():
        return easy
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))

    def find(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in sliced([batch]):
                found = hits(strings(b.column(1)))
                for i, terms in enumerate(found):
                    if terms:
                        one = b.slice(i, 1).column(0)
                        yield pa.RecordBatch.from_arrays([one.take(pa.array([0] + [None] * (len(terms) - 1), pa.int64())), pa.array([part] * len(terms), pa.int32()), pa.array([n] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["row", "part", "n", "term"])
                        n += 1

    schema = f"row {keyed.schema['row'].dataType.simpleString()}, part int, n long, term string"
    pending = materialize(keyed.mapInArrow(find, schema), "pending")
    known = pending.select("part", "n", "term").join(flagged.select("term", "entity_kind", "p"), "term").groupBy("part", "n").agg(F.collect_list(F.struct("term", "entity_kind", "p")).alias("terms"))
    hard = pending.groupBy("part", "n").agg(F.first("row", ignorenulls=True).alias("row")).join(known, ["part", "n"], "left").select("row.*", F.col("terms").alias("__terms"))

    def rest(batch, extras):
        yield changed(batch, [{t["term"]: (t["entity_kind"], t["p"]) for t in x or ()} for x in extras[0].to_pylist()])

    return easy.union(_with_terms(hard, docs.columns, rest))


def _with_terms(hard: DataFrame, names: list[str], rest) -> DataFrame:
    """Rewrites rows that carry their terms as a last column."""
    schema = hard.drop("__terms").schema

    def run(batches):
        for b in batches:
            yield from rest(pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]), b.columns[-1:])

    return hard.mapInArrow(run, schema).select(*names)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return report(spans(docs, disclosing(docs)))


QUERIES = {"op1_pii": op1_pii}
