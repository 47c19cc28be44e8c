"""Near copies of documents, the corpus pipeline's form of the SimHash search.

Equal word sequences are one text. Texts are candidates if their fingerprints (``VIEWS`` SimHashes of the set of words) lie
within the search's radius, or if they share one of ``BANDS`` minhash keys of their five-word shingles, which finds copies with
words appended or cut, whose fingerprints move too far. Within a key only pairs with the key's first text are listed, so a
large group costs a few pairs a text. Each pair is verified on whole texts: ``SIMILAR`` of the shingles in common.

What such a list of pairs leaves open is settled by the keys: where the texts of one key belong to several groups after the
verification, those outside the key's largest group are compared with a text of that group and then, in blocks, with all texts of
the key. No switch depends on sizes; a similar pair is missed only if it shares no key (0.0004 of pairs at ``SIMILAR``).

Defined cases. Null texts count as empty; texts without words are copies of each other; a text of fewer than five words is one
shingle. Rows with a null id are neither dropped nor linked. Rows that share an id but not the text are texts of their own;
rows that share both are copies. The document kept of a group is the first by id, then by content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import complete_groups, discard, materialize, record_batch, sliced, utf8
from rangeloom.llm.graph import components
from rangeloom.llm.passages import _mixed, word_hashes
from rangeloom.llm.rows import FILTER_BITS, bitmap_of, member, without
from rangeloom.llm.simhash import SEED, links

#: Fingerprints of the search by word sets, and the share of common five-word shingles that makes texts near copies.
VIEWS, FIVE, SIMILAR = 3, 5, 0.8
#: Minhash bands of the search by shingles, and the hashes of one: a pair of similarity s shares one with 1 - (1 - s ** DEPTH) ** BANDS.
BANDS, DEPTH = 20, 5
#: Rows of a block in which texts are compared that the listed pairs didn't settle.
BLOCK = 256
_KEYS = [f"k{i}" for i in range(VIEWS + BANDS)]


def word_views(texts: list[bytes]) -> np.ndarray:
    """VIEWS fingerprints of each text's set of words; an edited word changes one feature, not a run of shingles."""
    value, owner, _ = word_hashes(texts)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(value.size, bool)
    first[1:] = (np.diff(owner) != 0) | (value[1:] != value[:-1])
    value, owner = value[first], owner[first]
    out = np.zeros((len(texts), VIEWS), np.int64)
    if not value.size:
        return out
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(begins, owner.size))
    for v in range(VIEWS):
        h = (value ^ np.uint64(v * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((h ^ (h >> np.uint64(29))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[owner[begins], v] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def shingles(data: bytes) -> np.ndarray:
    """Sorted hashes of the five-word shingles of a sequence of word hashes; a shorter text is one shingle."""
    w = np.frombuffer(data, "<u4").astype(np.uint64)
    n = max(1, w.size - FIVE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(FIVE, w.size)):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : n + j] + np.uint64(1)
    return np.unique(h)


def bands(texts: list[bytes]) -> np.ndarray:
    """BANDS keys of each text's set of five-word shingles; similar sets share some, wherever words were added or cut."""
    value, owner, _ = word_hashes(texts)
    value, cuts = value.astype("<u4"), np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [shingles(value[a:e].tobytes()) for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    out = np.zeros((len(texts), BANDS), np.uint64)
    if not sets:
        return out.view(np.int64)
    begins = np.concatenate([[0], np.cumsum([x.size for x in sets])[:-1]])
    h = _mixed(np.concatenate(sets))
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, DEPTH), np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(BANDS):
        for a in odd[b]:
            out[:, b] = _mixed(out[:, b] + np.minimum.reduceat(h * a, begins))
    return out.view(np.int64)


def contents(texts: list[bytes]) -> np.ndarray:
    """128 bits of each text's lower-cased words, as two longs."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts), "<i8").reshape(-1, 2)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if min(x.size, y.size) < SIMILAR * max(x.size, y.size):
        return 0.0  # it can't reach SIMILAR
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / max(x.size + y.size - both, 1)


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of the row), content (c0, c1) and the keys of every row of (doc_id, text)."""
    fields = [(f, pa.int64()) for f in ("doc_id", "row", "c0", "c1", *_KEYS)]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            texts = utf8(b.column(1))
            yield record_batch(fields, [b.column(0), np.arange(row, row + b.num_rows), *contents(texts).T, *word_views(texts).T, *bands(texts).T])
            row += b.num_rows

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n, _ in fields))


def _words(docs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, words (32 bits of each word's hash) of the given nodes."""
    wanted = texts.join(nodes, "node").select("c0", "c1", "node")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.pmod("c0", F.lit(FILTER_BITS)).alias("slot"))))

    def run(batches):
        for b in sliced(batches):
            data = utf8(b.column(1))
            content = contents(data)
            keep = np.flatnonzero(member(shared.value, content[:, 0] & (FILTER_BITS - 1)))
            keep = keep[np.unique(content[keep], axis=0, return_index=True)[1]] if keep.size else keep  # copies of a batch once
            if not keep.size:
                continue
            value, owner, _ = word_hashes([data[i] for i in keep.tolist()])
            value = value.astype("<u4")
            cuts = np.searchsorted(owner, np.arange(keep.size + 1))
            out = [value[a:e].tobytes() for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield record_batch([("c0", pa.int64()), ("c1", pa.int64()), ("words", pa.binary())], [*content[keep].T, out])

    found = docs.mapInArrow(run, "c0 long, c1 long, words binary").dropDuplicates(["c0", "c1"])
    return found.join(wanted, ["c0", "c1"]).select("node", "words")


_PAIR = [("src", pa.int64()), ("dst", pa.int64())]


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose texts are similar enough; known: node, words."""
    both = pairs.join(known.toDF("src", "a"), "src").join(known.toDF("dst", "b"), "dst")

    def verify(batches):
        for b in sliced(batches):
            good = [jaccard(shingles(x), shingles(y)) >= SIMILAR for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield record_batch(_PAIR, [c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]])

    return both.select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long")


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """The groups (node, component) after further links, by the components of the groups that the links connect."""
    left, right = found.toDF("src", "x"), found.toDF("dst", "y")
    edges = more.join(left, "src", "left").join(right, "dst", "left").select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))
    over = materialize(components(edges), "merged")
    kept = found.join(over.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return kept.union(over.join(found, "node", "left_anti"))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members (band, key, node) of keys whose texts belong to several groups (node, component).

    part: the node's group; rest: it isn't the key's largest; n, most: texts of the key and of its largest group; hub: one of that.
    """
    named = members.join(found, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("part"))
    parts = named.groupBy("band", "key", "part").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("one"))
    keys = parts.groupBy("band", "key").agg(F.max(F.struct("n", "part", "one")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    keys = keys.select("band", "key", "n", F.col("top.n").alias("most"), F.col("top.part").alias("largest"), F.col("top.one.node").alias("hub"))
    return named.join(keys, ["band", "key"]).select("band", "key", "node", "part", (F.col("part") != F.col("largest")).alias("rest"), "n", "most", "hub")


def _across(open_: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst) of all similar texts of different groups that share a key, one of them outside the key's largest group.

    The rest of a key, in blocks, meets all of the key's texts, in blocks; only verified pairs leave them. A pair is compared
    under the first key that it shares.
    """
    keyed = _KEYS[VIEWS:]
    rows = open_.join(texts.select("node", *keyed), "node").join(known, "node")
    few, all_ = F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    columns = ["band", "key", "i", "j", "asks", "node", "part", F.col("rest").cast("int").alias("rest"), *keyed, "words"]
    asks = rows.where("rest").withColumn("i", place(few)).withColumn("j", spread(all_)).withColumn("asks", F.lit(1)).select(*columns)
    told = rows.withColumn("j", place(all_)).withColumn("i", spread(few)).withColumn("asks", F.lit(0)).select(*columns)

    def near(batches):
        for t, cuts in complete_groups(batches, 4):
            band, asks, node, part, rest = (t.column(c).to_numpy() for c in (0, 4, 5, 6, 7))
            keys, data, out = np.stack([t.column(8 + b).to_numpy() for b in range(BANDS)], axis=1), t.column(8 + BANDS), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets: dict[int, np.ndarray] = {}

                def of(k, sets=sets, data=data):
                    if k not in sets:
                        sets[k] = shingles(data[k].as_py())
                    return sets[k]

                left, right, first = np.flatnonzero(asks[a:b] == 1) + a, np.flatnonzero(asks[a:b] == 0) + a, int(band[a]) - VIEWS
                for q in left.tolist():
                    hit = (part[right] != part[q]) & ((rest[right] == 0) | (node[right] > node[q]))
                    if first:
                        hit &= ~(keys[right, :first] == keys[q, :first]).any(axis=1)
                    out += [(int(node[q]), int(node[k])) for k in right[hit].tolist() if jaccard(of(q), of(k)) >= SIMILAR]
            if out:
                yield record_batch(_PAIR, list(zip(*out, strict=True)))

    keys = ["band", "key", "i", "j"]
    return asks.union(told).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(near, "src long, dst long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, c0, c1 (the content), n (rows that share both), component_id and kept of every document with an id."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    rows = materialize(_features(docs), "features")
    texts = materialize(rows.groupBy("c0", "c1", *_KEYS).agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "texts")
    each = texts.select("node", F.posexplode(F.array(*_KEYS)).alias("band", "key"))
    heads = each.groupBy("band", "key").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    heads = materialize(heads.where((F.col("n") > 1) | (F.col("band") < VIEWS)), "heads")
    members = materialize(each.join(heads.where("n > 1"), ["band", "key"]).select("band", "key", "node", "head", "n"), "members")
    near = links(heads.where(F.col("band") < VIEWS).select(F.col("band").alias("view"), F.col("head").alias("node"), F.col("key").alias("fp")))
    same = members.where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst"))
    pairs = same.union(near).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    pairs = materialize(pairs, "pairs")
    known = materialize(_words(docs, texts, pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()), "words")
    verified = materialize(_verified(pairs, known), "verified")
    found = materialize(components(verified), "near-groups")
    discard(pairs, verified, heads)
    several = members.where((F.col("band") >= VIEWS) & (F.col("n") > 2)).select("band", "key", "node")  # a pair was compared
    open_ = materialize(_open(several, found), "open")
    if not open_.isEmpty():
        again = materialize(_verified(open_.where("rest").select(F.col("node").alias("src"), F.col("hub").alias("dst")).distinct(), known), "verified")
        found = materialize(_merged(found, again), "near-groups")
        discard(open_, again)
        open_ = materialize(_open(several, found), "open")
        if not open_.isEmpty():
            more = materialize(_across(open_, texts, known), "verified")
            found = materialize(_merged(found, more), "near-groups")
            discard(more)
    discard(open_, members, known)
    of = texts.join(found, "node", "left").select("c0", "c1", F.coalesce("component", "node").alias("component"), F.struct("least", "c0", "c1").alias("one"))
    first = of.groupBy("component").agg(F.min("one").alias("first"))
    named = of.join(first, "component").select("c0", "c1", "first")
    out = rows.groupBy("doc_id", "c0", "c1").agg(F.count("*").alias("n")).join(named, ["c0", "c1"])
    kept = F.struct("doc_id", "c0", "c1") == F.col("first")
    return out.select("doc_id", "c0", "c1", "n", F.col("first.least").alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The table's rows without all but the first document of each group; rows with a null id stay."""
    found = materialize(near_copies(docs), "groups")
    at = docs.columns.index("doc_id"), docs.columns.index("text")

    def content(batch):
        """doc_id and content of a batch of the table's rows."""
        return [batch.column(at[0]).cast(pa.int64()), *contents(utf8(batch.column(at[1]))).T]

    doubtful = found.where("not kept or n > 1").select("doc_id", "c0", "c1", "kept")
    return without(docs, doubtful, ("doc_id", "c0", "c1"), content)


def recall(docs: DataFrame, found: DataFrame, sample: int = 64) -> tuple[float, int]:
    """(share found, links) of the similar pairs of a bounded hash sample of texts with all texts, by brute force."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    total = docs.count()
    few = docs.where(F.pmod(F.xxhash64(F.lit("audit"), "doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(total, 1)))))

    def sets(texts):
        value, owner, _ = word_hashes(texts)
        value, cuts = value.astype("<u4"), np.searchsorted(owner, np.arange(len(texts) + 1))
        return [shingles(value[a:e].tobytes()) for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    rows = few.collect()
    mine = list(zip([r["doc_id"] for r in rows], sets([(r["text"] or "").encode() for r in rows]), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(mine)

    def run(batches):
        for b in sliced(batches):
            out = []
            for i, s in zip(b.column(0).to_pylist(), sets(utf8(b.column(1))), strict=True):
                out += [(i, j) for j, q in shared.value if j != i and jaccard(s, q) >= SIMILAR]
            if out:
                yield record_batch(_PAIR, list(zip(*out, strict=True)))

    true = materialize(docs.mapInArrow(run, "src long, dst long").distinct(), "audit")
    named = found.select("doc_id", "component_id").distinct()
    got = true.join(named.toDF("src", "x"), "src").join(named.toDF("dst", "y"), "dst").where("x = y").select("src", "dst").distinct().count()
    n = true.count()
    return (got / n if n else 1.0), n
