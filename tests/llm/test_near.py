"""Near-duplicate operators, passages and components against brute force."""

import random

import numpy as np
import xxhash

from rangeloom.llm import graph, near, neighbours, passages, simhash
from rangeloom.llm.catalogue import queries

from .conftest import prose


def _components(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (41, 40), (41, 40)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = _components(300, edges)
    assert found == {i: want[i] for a, b in edges if a != b for i in (a, b)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fingerprint_by_definition():
    for text in ("a", "A b\tC\x0bd e", "one two three", prose(5, 60), "é É ß\x1cx y z w", ""):
        words = [w for w in text.translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(text.encode()) & 0xFFFFFFFFFFFFFFFF == want


def test_links_are_complete(spark):
    """Random fingerprints and clusters around some of them, at every distance, against all pairs."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for _ in range(12):
            values.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 8))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(0, *x) for x in enumerate(signed)], "view int, node long, fp long")).collect()}
    want = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4}
    assert found == {tuple(sorted(p)) for p in want}


def test_dense_cells_stay_connected(spark):
    """Hundreds of fingerprints around a few centres: components against all pairs, links not more than rows in cells."""
    rng = random.Random(8)
    values = set()
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(350):
            values.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5))))
    values = np.array(sorted(values), np.uint64)
    signed = values.view(np.int64).tolist()
    pairs = [tuple(p) for p in zip(*np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4, 1)), strict=True)]
    found = [(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(0, *x) for x in enumerate(signed)], "view int, node long, fp long")).collect()]
    assert {tuple(sorted(p)) for p in found} <= set(pairs)
    assert _components(len(values), found) == _components(len(values), pairs)
    assert len(found) <= 38 * len(values)


def test_groups_of_odd_rows(odd, none):
    found = simhash.groups(odd).collect()
    assert len(found) == 11
    empty = {r.component_id for r in found if r.fp == 0 and r.doc_id in (2, 3, 7)}
    assert empty == {2}
    same = {r.component_id for r in found if r.doc_id in (None, 5)}
    assert same == {5}
    assert simhash.groups(none).count() == 0


def _jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_one_of_each(spark, odd, none):
    rng = random.Random(3)
    texts = [prose(i, 150) for i in range(40)]
    for i in range(30):
        w = texts[i % 10].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = _components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if _jaccard(texts[i], texts[j]) >= 0.8])
    found = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
    assert found == dict(enumerate(want))
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    rest = near.one_of_each(odd)
    assert rest.dtypes == odd.dtypes and sorted(str(r.doc_id) for r in rest.collect()) == sorted(["1", "2", "4", "None", "5", "6", "8", "9"])
    assert near.one_of_each(none).count() == 0


def test_appended_and_cut_copies(spark):
    """Copies with words appended, put before or cut, against brute-force similarity."""
    rng, texts = random.Random(12), []
    for k in range(160):
        n = (60, 150, 400, 1000)[k % 4]
        word = lambda: f"{rng.getrandbits(30):x}"
        whole = [word() for _ in range(n)]
        more, share = [word() for _ in range(n)], (0.05, 0.1, 0.15, 0.2)[k // 4 % 4]
        copy = (whole + more[: int(n * share)], more[: int(n * share)] + whole, whole[: n - int(n * share)], whole[int(n * share) :])[k // 16 % 4]
        texts += [" ".join(whole), " ".join(copy)]
    want = {2 * k + 1 for k in range(160) if _jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8}
    found = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    got = {d for d, c in found.items() if c != d}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 120, (len(got), len(want))


def test_equal_word_sets(spark):
    """Near copies whose first candidate has the same words in another order, few or many."""
    texts, want = [], []
    for k, many in enumerate((2, 14)):
        w = [f"w{k}x{i}" for i in range(150)]
        texts.append(" ".join(random.Random(20 + k).sample(w, 150)))
        first = len(texts)
        want.append(first - 1)
        for i in range(many):
            x = list(w)
            x[10 + 3 * i], x[12 + 3 * i] = x[12 + 3 * i], x[10 + 3 * i]
            texts.append(" ".join(x))
            want.append(first)
    assert want == _components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if _jaccard(texts[i], texts[j]) >= 0.8])
    found = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(want))


def test_a_new_row_removes_no_link(spark):
    """Near copies stay one group when the same words in another order come first."""
    w = [f"w{i}" for i in range(150)]
    near_one = list(w)
    near_one[40], near_one[42] = near_one[42], near_one[40]
    rows = [(1, " ".join(w)), (2, " ".join(near_one))]
    for more in ([], [(0, " ".join(random.Random(5).sample(w, 150)))]):
        found = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
        assert found[1] == found[2] == 1 and found.get(0, 0) == 0


def test_clashing_ids_and_null_ids_stay(spark):
    """Texts that share an id are told apart; null ids are never dropped, whatever slot a dropped text has."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(3, b), (3, c), (3, c), (1, a), (7, a), (None, a), (None, a), (None, a), (9, b), (2, None), (4, "")]
    kept = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept)
    assert got == sorted([("3", b[:9]), ("3", c[:9]), ("1", a[:9]), ("None", a[:9]), ("None", a[:9]), ("None", a[:9]), ("2", "")])


def test_blocks_of_a_key_that_fell_apart(spark):
    """Every pair of a key is settled: texts around several centres under one key, by brute force."""
    rng, rows = random.Random(15), []
    for k in range(5):
        w = [f"c{k}x{i}" for i in range(60)]
        for _ in range(1 + 7 * k):
            x = list(w)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(60)] = f"e{rng.getrandbits(30)}"
            rows.append(" ".join(x))
    rng.shuffle(rows)
    want = [(i, j) for i in range(len(rows)) for j in range(i) if _jaccard(rows[i], rows[j]) >= 0.8]
    texts = spark.createDataFrame([(i, *range(near.VIEWS), *[7] * near.BANDS) for i in range(len(rows))], ["node", *near._KEYS])
    value = [near.word_hashes([t.encode()])[0].astype("<u4").tobytes() for t in rows]
    known = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(value)], "node long, words binary")
    members = spark.createDataFrame([(near.VIEWS, 7, i) for i in range(len(rows))], "band int, key long, node long")
    nothing = spark.createDataFrame([], "node long, component long")
    found = {tuple(sorted(r, reverse=True)) for r in near._across(near._open(members, nothing), texts, known).collect()}
    # the group that counts as the largest is not compared with itself; here each text is a group
    assert _components(len(rows), found) == _components(len(rows), want)


def test_recall_audit(spark):
    """The audit's figure on copies with edits, additions and cuts."""
    rng, rows = random.Random(16), []
    for k in range(60):
        w = prose(700 + k, 120).split()
        x = list(w)
        for _ in range(k % 4):
            x[rng.randrange(len(x))] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x + prose(900 + k, 1 + k % 12).split()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    share, links = near.recall(docs, near.near_copies(docs), sample=200)
    assert links > 80 and share >= 0.97


def test_seeds_do_not_depend_on_their_surroundings():
    rng, alone = random.Random(4), 0
    for n in (passages.LEAST,) * 200:
        shared = [f"{rng.getrandbits(30):x}" for _ in range(n)]
        a = " ".join([*prose(rng.random(), 60).split(), *shared, *prose(rng.random(), 50).split()])
        b = " ".join([*prose(rng.random(), 7).split(), *shared])
        x, y = passages.seeds([a.encode()]), passages.seeds([b.encode(), a.encode()])
        alone += not set(x[0].tolist()) & set(y[0][y[1] == 0].tolist())
        assert x[0].tolist() == y[0][y[1] == 1].tolist()  # neighbours in a batch don't matter
        whole = passages.seeds([" ".join(shared).encode()])[0].tolist()
        assert [h for h in x[0].tolist() if h in set(whole)] == whole
    assert alone == 0
    assert len(passages.seeds([b"echo " * 400])[0]) > 40  # repeats of one word are runs of their own


def test_chains_are_optimal():
    """The Fenwick tree's best score against the quadratic recurrence."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        pairs = np.unique(rng.integers(0, 60, (n, 2)), axis=0)
        pos, ref = pairs[:, 0], pairs[:, 1]
        score = []
        for i in range(len(pos)):
            gains = [score[j] - passages.GAP * (pos[i] - pos[j] + ref[i] - ref[j] - 2) for j in range(i) if pos[j] < pos[i] and ref[j] < ref[i]]
            score.append(passages.WEIGHT + max([0, *gains]))
        first = passages.chains(pos.astype(np.int64), ref.astype(np.int64))[0]
        total = passages.WEIGHT + sum(passages.WEIGHT - passages.GAP * (pos[b] - pos[a] + ref[b] - ref[a] - 2) for a, b in zip(first, first[1:], strict=False))
        assert abs(total - max(score)) < 1e-6 and (np.diff(pos[first]) > 0).all() and (np.diff(ref[first]) > 0).all()


def test_passages(spark, odd, none):
    shared = prose(1, 60).split()
    fuzzy = list(shared)
    fuzzy[20:22] = ["edited"]
    fuzzy.insert(45, "inserted")
    rows = [(i, " ".join([*prose(100 + i, 70 + i).split(), *part, *prose(300 + i, 40).split()])) for i, part in enumerate([shared, shared, fuzzy, prose(9, 60).split(), shared[:40]])]
    rows += [(20, " ".join(shared)), (21, " ".join(["echo"] * 80)), (22, " ".join(["echo"] * 70)), (21, " ".join(["echo"] * 80))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
        assert r.ref_doc_id != r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
    assert set(by) == {1, 2, 20, 22}
    assert any((r.ref_doc_id, r.start_word, r.end_word, r.ref_start, r.similarity) == (0, 71, 131, 70, 1.0) for r in by[1])
    assert any(r.start_word <= 72 + 5 and r.end_word >= 72 + 55 and r.similarity < 1 for r in by[2])
    assert passages.passages(odd).count() == 0 and passages.passages(none).count() == 0


def test_two_passages_a_pair(spark):
    """Unlike text between two shared passages, or a weak stretch beside one, loses neither."""
    rows, want = [], {}
    for k, (size, gap) in enumerate([(60, 60), (60, 100), (60, 150), (300, 200), (300, 600)]):
        one, two = prose(1000 + k, size).split(), prose(2000 + k, size).split()
        for side in (0, 1):
            rows.append((2 * k + side, " ".join([*prose(3000 + 2 * k + side, 30).split(), *one, *prose(4000 + 2 * k + side, gap).split(), *two, *prose(5000 + 2 * k + side, 30).split()])))
        want[2 * k + 1] = [(30, 30 + size), (30 + size + gap, 30 + 2 * size + gap)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, places in want.items():
        for start, end in places:
            assert any(r.doc_id == doc and r.ref_doc_id == doc - 1 and abs(r.start_word - start) <= 2 and abs(r.end_word - end) <= 2 and r.similarity >= 0.9 for r in found), (doc, start, end)


def test_parts_with_earlier_owners(spark):
    """Earlier documents that hold a part of a passage, or a first quote of it in its own document, don't hide the whole."""
    rows, want, n = [], [], 0

    def add(seed, *parts):
        nonlocal n
        rows.append((n, " ".join([*prose(7000 + seed, 30).split(), *(w for i, p in enumerate(parts) for w in [*p, *prose(9000 + 10 * seed + i, 30).split()])])))
        n += 1
        return n - 1

    for k, (size, part) in enumerate([(60, 40), (60, 40), (70, 45), (60, 25), (300, 150)]):
        whole = prose(6000 + k, size).split()
        add(10 * k, whole[:part])
        b = add(10 * k + 1, whole)
        add(10 * k + 2, whole[:part])
        want.append((add(10 * k + 3, whole), b, size))
    whole = prose(6100, 60).split()
    b = add(100, whole[:35], whole)
    want.append((add(101, whole), b, 60))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, ref, size in want:
        assert any(r.doc_id == doc and r.ref_doc_id == ref and abs(r.end_word - r.start_word - size) <= 4 and r.similarity >= 0.9 for r in found), (doc, ref, size)


def test_words_of_later_rounds(spark):
    """Words that are dealt out again belong to the documents asked for, whole; with none, nothing is left."""
    docs = spark.createDataFrame([(i, prose(8000 + i, 20 + i)) for i in range(60)], "doc_id long, text string")
    every = spark.range(60).selectExpr("id")
    kept = passages.words(docs, every)
    want = {r.doc: bytes(r.words) for r in kept.collect()}
    assert {d: len(w) // 4 for d, w in want.items()} == {i: 20 + i for i in range(60)}
    some = passages._still(kept, every.where("id % 7 = 3"))
    assert {r.doc: bytes(r.words) for r in some.collect()} == {d: w for d, w in want.items() if d % 7 == 3}
    assert passages._still(kept, every.where("id < 0")).count() == 0


def test_recall_of_edited_passages(spark):
    """Passages with a word replaced, inserted or dropped at every n-th place, down to 0.8 equal words."""
    rng, rows, kinds = random.Random(11), [], [(60, 12), (60, 10), (60, 8), (100, 8), (60, 6), (100, 6)]
    for k in range(240):
        size, every = kinds[k % len(kinds)]
        word = lambda: f"{rng.getrandbits(30):x}"
        whole, edited = [word() for _ in range(size)], []
        for i, w in enumerate(whole):
            kind = "s" if i % every < every - 1 or k % 12 < 6 else rng.choice("sid")
            change = i % every == every - 1
            edited += [w] if not change else [word()] if kind == "s" else [w, word()] if kind == "i" else []
        rows += [(2 * k + side, " ".join([*(word() for _ in range(80)), *part, *(word() for _ in range(80))])) for side, part in enumerate((whole, edited))]
    found = {(r.doc_id, r.ref_doc_id) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(240)} and len(found) >= 0.95 * 240
    for j in range(len(kinds)):
        assert sum((2 * k + 1, 2 * k) in found for k in range(j, 240, len(kinds))) >= (36 if kinds[j][1] > 6 else 32)


def _embedding_rows(seed=6):
    rng = np.random.default_rng(seed)
    rows, dense = [], rng.standard_normal(24)
    for i in range(500):
        x = rng.standard_normal(24) if i % 5 else dense + rng.standard_normal(24) * 0.12
        rows.append((i, x.astype(np.float32).astype(float).tolist(), int(i % 3)))
    for i in range(500, 620):
        rows.append((i, rows[i - 500][1] if i % 2 else (np.array(rows[i - 500][1]) * 2).tolist(), rows[i - 500][2]))
    return rows


def test_neighbours(spark):
    rows = _embedding_rows()
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [float("inf")] + [1.0] * 23, 1), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(i, e, y, "x") for i, e, y in rows + odd], "vec_id long, embedding array<float>, label int, node string")
    found = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    assert len(found) == len(rows) + len(odd)
    x = np.array([np.float32(e) for _, e, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([v for *_, v in rows])
    near = (x @ x.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(near, False)
    degree = near.sum(axis=1)
    degree = degree + np.array([rows[i][2] == rows[3][2] and (i == 3 or bool(near[i, 3])) for i in range(len(rows))])
    got = np.array([found[i].n_links for i, *_ in rows])
    assert got.sum() >= 0.99 * degree.sum() and (got <= degree).all()
    want = _components(len(rows), list(zip(*np.nonzero(np.triu(near)), strict=True)))
    assert np.mean([found[i].component_id == want[i] for i in range(len(rows))]) >= 0.99
    for i in (900, 901, 902, 903, 904, 905, 908):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[906].n_links, found[907].component_id, found[907].kept) == (1, 906, False)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_exact_search(spark):
    """The search by all pairs of blocks connects what brute force connects, with fewer links than pairs."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3, 16))
    x = np.concatenate([centres[i % 3] + 0.12 * rng.standard_normal((1, 16)) for i in range(700)] + [rng.standard_normal((60, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = [i % 2 for i in range(len(x))]
    space = spark.createDataFrame([(i, y[i], 16, 1, bytearray(v.astype(float).tobytes())) for i, v in enumerate(x)], "node long, label long, size int, weight long, unit binary")
    found = [(r.src, r.dst) for r in neighbours.exact(space).collect()]
    near = (x @ x.T >= 0.93) & (np.array(y)[:, None] == np.array(y)[None, :])
    pairs = list(zip(*np.nonzero(np.triu(near, 1)), strict=True))
    assert _components(len(x), found) == _components(len(x), pairs) and len(found) < len(pairs) / 10


def test_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}


def test_links_between_saturated_groups(spark):
    """Groups whose lists are full of closer vectors of their own are still joined by the links between them."""
    rng = np.random.default_rng(7)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    near = np.arccos(0.945)
    centres = [axes[0], np.cos(near) * axes[0] + np.sin(near) * axes[1], np.cos(near) * axes[0] - np.sin(near) * axes[1], axes[5]]
    rows = [c + 0.004 * rng.standard_normal(64) for c in centres for _ in range(90)] + list(rng.standard_normal((300, 64)))
    df = spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(rows), dtype=bool)
    assert links[:90, 90:270].mean() > 0.5 and not links[90:180, 180:270].any()
    space = neighbours.nodes(df)
    found = {r.node: r.component for r in neighbours.joined(space, 0).collect()}  # without the audit and what follows it
    assert {found[i] for i in range(270)} == {0} and {found[i] for i in range(270, 360)} == {270}
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(rows))] == links.sum(axis=1).tolist()
