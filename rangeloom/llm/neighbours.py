"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one node with a weight. A first neighbour graph comes from leaves of random hyperplanes,
whose number grows with the label's size and which are salted beyond ``LEAF`` rows. NN-descent then joins each node's
neighbours and reverse neighbours with each other (salted beyond ``JOIN`` rows) and keeps the best ``NEAREST`` of each node;
a list full of links is saturated and grows to ``SATURATED``. Rounds end when they change little. Candidates travel as
half-precision vectors; the edges over the threshold are decided in double precision. Links between two groups that both
fill their lists are evicted by closer ones, so components of more than ``NEAREST`` nodes are searched again for neighbours
outside their own component, until no search joins two of them. The links of a component are then counted in blocks of ``BLOCK`` rows, so that links beyond a full list count too and no pair is ever a row. An audit
compares up to ``AUDIT`` nodes with all vectors; below ``RECALL`` the search is repeated with longer lists and more leaves, and after ``ATTEMPTS`` by all pairs of blocks.

Defined cases. Vectors that are null, empty, zero or have null or non-finite parts, and rows without a label, link with
nothing. Vectors of different lengths don't link. Repeated rows are vectors of their own and link with each other. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import complete_groups, discard, materialize, record_batch, table
from rangeloom.llm.graph import components

THRESHOLD, SLACK = 0.93, 0.01
LEAF, TABLES, BITS = 256, 4, 32
NEAREST, SATURATED, JOIN, ROUNDS, CHANGED = 8, 32, 64, 4, 0.02
BLOCK, AUDIT, RECALL, ATTEMPTS = 512, 256, 0.95, 3


def nodes(vectors: DataFrame) -> DataFrame:
    """node (least vec_id), label, size, weight, unit (doubles): the different vectors that can link."""
    clean = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    clean = clean.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0))
    one = clean.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))

    def run(batches):
        for b in batches:
            units = []
            for v in b.column(4).to_pylist():
                x = np.array(v, np.float64)
                x /= np.abs(x).max()
                units.append((x / np.linalg.norm(x)).tobytes())
            yield record_batch([("node", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("weight", pa.int64()), ("unit", pa.binary())], [*b.columns[:4], units])

    return one.select("node", F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"), "weight", "embedding").where("node is not null").mapInArrow(run, "node long, label long, size int, weight long, unit binary")


def _halves(units: list[bytes]) -> list[bytes]:
    return [np.frombuffer(u, np.float64).astype(np.float16).tobytes() for u in units]


def _leaves(space: DataFrame, tables: int, seed: int) -> DataFrame:
    """label, size, leaf (table, signature), node, component, half: a row for each node and table."""
    fields = [("label", pa.int64()), ("size", pa.int32()), ("t", pa.int32()), ("signature", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("half", pa.binary())]

    def run(batches):
        for b in batches:
            units = b.column(4).to_pylist()
            sizes = np.fromiter(map(len, units), np.int64, len(units)) // 8
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                part = b.take(pa.array(rows))
                x = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(rows.size, size)
                half = _halves(part.column(4).to_pylist())
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, size]).standard_normal((size, BITS))
                    signature = ((x @ planes) > 0) @ (1 << np.arange(BITS - 1, -1, -1))
                    yield record_batch(fields, [part.column(1), part.column(2), np.full(rows.size, t), signature, part.column(0), part.column(3), half])

    found = space.select("node", "label", "size", "component", "unit").mapInArrow(run, "label long, size int, t int, signature long, node long, component long, half binary")
    sizes = space.groupBy("label", "size").agg(F.count("*").alias("n"))
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("n") / LEAF)), F.lit(0)), F.lit(BITS)).cast("int")
    return found.join(sizes, ["label", "size"]).select("label", "size", "t", F.call_function("shiftright", F.col("signature"), F.lit(BITS) - depth).alias("leaf"), "node", "component", "half")


_EDGE = [("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())]
_EDGES = "u long, v long, sim float"


def _best(x: np.ndarray, ids: np.ndarray, component: np.ndarray, floor: np.ndarray, most: int):
    """Edges from each row to its ``most`` nearest rows of other components whose cosine exceeds the row's floor."""
    sim = x @ x.T
    sim[component[:, None] == component[None, :]] = -2
    n = min(most, len(ids) - 1)
    if n < 1:
        return None
    near = np.argpartition(-sim, n - 1, axis=1)[:, :n]
    value = np.take_along_axis(sim, near, axis=1)
    good = value > floor[:, None]
    return np.repeat(ids, good.sum(axis=1)), ids[near[good]], value[good]


def _blocks(keyed: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Nearest edges within each group of (keys, node, component, floor, half); groups have a bounded size."""
    k = len(keys)

    def run(batches):
        for t, cuts in complete_groups(batches, k):
            ids, component, floor = (t.column(k + c).to_numpy() for c in range(3))
            halves = t.column(k + 3).to_pylist()
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    x = np.frombuffer(b"".join(halves[a:b]), np.float16).reshape(b - a, -1).astype(np.float32)
                    if (e := _best(x, ids[a:b], component[a:b], floor[a:b], most)) is not None:
                        out.append(e)
            if out:
                yield record_batch(_EDGE, [np.concatenate(c) for c in zip(*out, strict=True)])

    return keyed.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "component", F.col("floor").cast("float"), "half").mapInArrow(run, _EDGES)


def _salted(rows: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """Adds salt, so that groups by keys and salt have about ``bound`` rows at most."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("node", *keys), F.ceil(F.col("n") / bound))
    return rows.join(counts, keys).withColumn("salt", salt).drop("n")


def _kept(edges: DataFrame, nearest: int, saturated: int) -> DataFrame:
    """The best ``nearest`` edges of each node; up to ``saturated`` while they are links."""
    w = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    ranked = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(w))
    return ranked.where((F.col("r") <= nearest) | ((F.col("sim") >= THRESHOLD - SLACK) & (F.col("r") <= saturated))).drop("r")


def search(space: DataFrame, attempt: int) -> DataFrame:
    """u, v, sim: a refined neighbour graph; its edges lead out of a node's ``component``."""
    nearest, saturated, tables = NEAREST << attempt, SATURATED << attempt, TABLES + 2 * attempt
    leaves = _salted(_leaves(space, tables, 11 + attempt), ["label", "size", "t", "leaf"], LEAF)
    graph = materialize(_kept(_blocks(leaves.withColumn("floor", F.lit(-1.5)), ["label", "size", "t", "leaf", "salt"], nearest), nearest, saturated), "graph")

    def run(batches):
        for b in batches:
            yield record_batch([("node", pa.int64()), ("component", pa.int64()), ("half", pa.binary())], [*b.columns[:2], _halves(b.column(2).to_pylist())])

    halves = materialize(space.select("node", "component", "unit").mapInArrow(run, "node long, component long, half binary"), "halves")
    total = halves.count()
    for _ in range(ROUNDS):
        n, least = F.count("*"), F.min("sim")
        open_ = F.when(n >= nearest, F.least(least, F.lit(THRESHOLD - SLACK))).otherwise(F.lit(-1.5))
        floor = graph.groupBy("u").agg(F.when(n >= saturated, least).otherwise(open_).alias("floor"))
        both = graph.select(F.col("u").alias("m"), F.col("v").alias("node")).union(graph.select(F.col("v").alias("m"), F.col("u").alias("node"))).distinct()
        both = both.union(graph.select(F.col("u").alias("m"), F.col("u").alias("node")).distinct())
        members = _salted(both, ["m"], JOIN).join(halves.join(floor.withColumnRenamed("u", "node"), "node", "left").select("node", "component", "half", F.coalesce("floor", F.lit(-1.5)).alias("floor")), "node")
        found = _blocks(members, ["m", "salt"], nearest)
        new = materialize(_kept(graph.union(found), nearest, saturated), "graph")
        changed = new.join(graph, ["u", "v"], "left_anti").count()
        discard(graph)
        graph = new
        if changed <= CHANGED * total:
            break
    discard(halves)
    return graph


def joined(space: DataFrame, attempt: int) -> DataFrame:
    """node, component of all nodes with links: the groups of a first search, joined by searches between them.

    A link that no list keeps has ``NEAREST`` closer ones at both of its ends, so only larger groups are searched again.
    Each such search lets a node see the nearest of other groups only; the last one joins nothing.
    """
    nearest = NEAREST << attempt
    alone = space.withColumn("component", F.col("node"))
    found = materialize(components(links(space, search(alone, attempt))), "components")
    while True:
        kept = found.join(space.select("node", "label", "size"), "node")
        large = kept.groupBy("label", "size", "component").agg(F.count("*").alias("n")).where(F.col("n") > nearest)
        rivals = large.groupBy("label", "size").agg(F.count("*").alias("groups")).where("groups > 1")
        within = large.join(rivals, ["label", "size"], "left_semi").select("component")
        part = materialize(space.join(found.join(within, "component", "left_semi"), "node"), "groups")
        if part.isEmpty():
            return found
        new = materialize(links(space, search(part, attempt)), "between")
        if new.isEmpty():
            return found
        forest = found.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
        found, old = materialize(components(forest.union(new)), "components"), found
        for used in (old, part, new):
            discard(used)


def links(space: DataFrame, graph: DataFrame) -> DataFrame:
    """src, dst of the graph's edges whose cosine in double precision reaches the threshold."""
    close = graph.where(F.col("sim") >= THRESHOLD - SLACK).select(F.greatest("u", "v").alias("src"), F.least("u", "v").alias("dst")).distinct()
    unit = space.select("node", "unit")
    pairs = close.join(unit.withColumnsRenamed({"node": "src", "unit": "a"}), "src").join(unit.withColumnsRenamed({"node": "dst", "unit": "b"}), "dst")

    def run(batches):
        for b in batches:
            if b.num_rows:
                sims = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield record_batch([("src", pa.int64()), ("dst", pa.int64())], [c.filter(pa.array([s >= THRESHOLD for s in sims])) for c in b.columns[:2]])

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def counted(space: DataFrame, found: DataFrame) -> DataFrame:
    """node, n: the weight of all nodes of the same component that link with the node, itself left out."""
    rows = space.join(found, "node").select("component", "node", "weight", "unit")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.join(found.groupBy("component").agg(F.count("*").alias("n")), "component").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "weight", "unit")

    def run(batches):
        for t, cuts in complete_groups(batches, 3):
            i, own, ids, weight = (t.column(c).to_numpy() for c in (1, 3, 4, 5))
            j, units, out = t.column(2).to_numpy(), t.column(6).to_pylist(), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x = np.frombuffer(b"".join(units[a:b]), np.float64).reshape(b - a, -1)
                left, right = np.flatnonzero(own[a:b] == i[a]), np.flatnonzero(own[a:b] == j[a])
                near = x[left] @ x[right].T >= THRESHOLD
                near[ids[a:b][left][:, None] == ids[a:b][right][None, :]] = False
                out.append((ids[a:b][left], near @ weight[a:b][right]))
                if i[a] != j[a]:
                    out.append((ids[a:b][right], weight[a:b][left] @ near))
            if out:
                yield record_batch([("node", pa.int64()), ("n", pa.int64())], [np.concatenate(c) for c in zip(*out, strict=True)])

    keys = ["component", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def exact(space: DataFrame) -> DataFrame:
    """src, dst: links that connect all that can be reached, from every pair of blocks of a label; each gives a forest, never its pairs."""
    sizes = space.groupBy("label", "size").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = space.join(sizes, ["label", "size"]).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["label", "size", "i", "j"]
    rows = rows.select("label", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "unit")

    def run(batches):
        for t, cuts in complete_groups(batches, 4):
            ids, units, out = t.column(4).to_numpy(), t.column(5).to_pylist(), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x, rest = np.frombuffer(b"".join(units[a:b]), np.float64).reshape(b - a, -1), np.arange(b - a)
                while rest.size:
                    queue, rest = [int(rest[0])], rest[1:]
                    while queue and rest.size:
                        at = queue.pop()
                        hit = x[rest] @ x[at] >= THRESHOLD
                        out += [(int(ids[a + at]), int(ids[a + k])) for k in rest[hit].tolist()]
                        queue += rest[hit].tolist()
                        rest = rest[~hit]
            if out:
                yield record_batch([("src", pa.int64()), ("dst", pa.int64())], list(zip(*out, strict=True)))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src long, dst long")


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, by a hash of the node."""
    return rows.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / max(rows.count(), 1)))))


def audit(space: DataFrame, found: DataFrame, degrees: DataFrame, full: int) -> float:
    """Share of the links of a bounded hash sample of nodes, compared with all nodes, that was found.

    Half of the sample is drawn from all nodes, half from components of more than ``full`` nodes, whose lists may have been full.
    """
    large = found.join(found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > full), "component").select("node")
    few = _drawn(space.select("node"), AUDIT // 2).union(_drawn(large, AUDIT // 2)).distinct()
    picked = space.join(few, "node").select("node", "label", "size", "unit").collect()
    if not picked:
        return 1.0
    shared = space.sparkSession.sparkContext.broadcast([tuple(r) for r in picked])

    def run(batches):
        sample: dict = {}
        for node, label, size, unit in shared.value:
            sample.setdefault((label, size), []).append((node, np.frombuffer(unit, np.float64)))
        for b in batches:
            got: dict[int, int] = {}
            label, size, ids, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3))
            units = b.column(4).to_pylist()
            for key, queries in sample.items():
                rows = np.flatnonzero((label == key[0]) & (size == key[1]))
                if rows.size:
                    x = np.frombuffer(b"".join(units[r] for r in rows.tolist()), np.float64).reshape(rows.size, -1)
                    near = np.stack([q for _, q in queries]) @ x.T >= THRESHOLD
                    near &= np.array([n for n, _ in queries])[:, None] != ids[rows][None, :]
                    for (n, _), c in zip(queries, (near @ weight[rows]).tolist(), strict=True):
                        got[n] = got.get(n, 0) + c
            yield record_batch([("node", pa.int64()), ("true", pa.int64())], [list(got), list(got.values())])

    exact = space.select("label", "size", "node", "weight", "unit").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    row = exact.join(degrees, "node", "left").agg(F.sum("true").alias("t"), F.sum(F.least(F.coalesce("n", F.lit(0)), "true")).alias("f")).first()
    return 1.0 if not row["t"] else row["f"] / row["t"]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    space = materialize(nodes(vectors), "nodes")
    for attempt in range(ATTEMPTS + 1):
        found = joined(space, attempt) if attempt < ATTEMPTS else materialize(components(exact(space)), "components")
        degrees = materialize(counted(space, found), "degrees")
        if attempt == ATTEMPTS or audit(space, found, degrees, SATURATED << attempt) >= RECALL:
            break
    result = space.join(found, "node", "left").join(degrees, "node", "left")
    result = result.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    group = vectors.where("label is not null and embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("node")).join(result, "node")
    out = vectors.join(group.select("label", "embedding", "n_links", "component_id"), ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_neighbours": op3_neighbours}
#: All pairs of a label, and all that each vector reaches.
ORACLES = {
    "op3_neighbours": """WITH RECURSIVE clean AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), unit AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM clean),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.c)
SELECT r.vec_id, coalesce(any_value(d.n), 0) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = r.vec_id GROUP BY r.vec_id"""
}
