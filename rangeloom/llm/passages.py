"""Fuzzy passages shared by documents, by collinear chaining of k-mer seeds.

Seeds are runs of ``K`` words, one in ``SPAN``, chosen by their hash alone: texts that share n runs of ``K`` words share a seed
but for a share of (1 - 1 / SPAN) ** n, 0.0002 for an exact passage of ``LEAST`` words, however its surroundings differ. Within a task's batch the occurrences of a seed are linked to the batch's first
one, to the first of all, which the batches' first ones settle among themselves, and to the one in the document before. A seed
of a hot passage thus costs three links an occurrence, never all pairs; a pair of documents with one link is compared by its
words around the link, as far as they agree. The seeds that two documents share are chained in order of both positions,
with costs for gaps, through a Fenwick tree of prefix maxima. Chains are aligned word by word between and beyond their
seeds, and split at gaps that pull them below ``SIMILAR`` equal words; aligned passages of at least ``LEAST`` words and ``SIMILAR``
equal words are reported on the later document.

Words are the ASCII-lower-cased text's runs of other bytes than ASCII blanks; positions count words.

Defined cases. Null and short texts have no passages. Rows that repeat an id are the same document and are never linked to
it; repeats within one document are not reported. Rows with a null id take no part. An empty table gives no rows.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import complete_groups, discard, materialize, record_batch, sliced, table, utf8
from rangeloom.llm.rows import bitmap, member, slots

K, SPAN, LEAST, SIMILAR = 4, 6, 50, 0.8
#: Bytes of text that a task takes at once; numpy needs some eighty times as much for a moment.
SLICE = 1 << 19
#: A seed's weight, the cost of a skipped word on either side, and the words looked at beyond a chain's ends.
WEIGHT, GAP, MARGIN = 5.0, 0.08, 16
#: Words of one side that an end skips at most where it grows, the words that must nearly agree behind them, and the fall of the
#: gain that ends growth.
SHIFT, RESUME, DROP = 3, 4, 16
_SHIFTS = [s for d in range(1, SHIFT + 1) for s in ((d, 0), (0, d))]
#: What remains of a passage of LEAST words between its first and last seed.
CORE = LEAST - 2 * (SPAN - 1)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes], spacers: int = 0):
    """(hash, text index, position or -1 for a spacer) of all words; ``spacers`` empty words stand behind each text."""
    gap = b"\n" + b"\0\n" * spacers
    data = np.frombuffer(gap.join([*(t.lower() for t in texts), b""]), np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_MULTIPLIER, data.size), out=sums[1:])
    # a word's polynomial, divided by the power at its begin, doesn't depend on where it stands
    value = _mixed((sums[end] - sums[begin]) * _powers(_INVERSE, data.size)[begin])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + len(gap))[:-1]]) if len(texts) else np.zeros(0, np.int64)
    owner = np.searchsorted(starts, begin, side="right") - 1
    inside = begin < starts[owner] + sizes[owner]
    first = np.searchsorted(begin, starts)
    return value, owner, np.where(inside, np.arange(begin.size) - first[owner], -1)


def seeds(texts: list[bytes]):
    """(hash, text index, position) of the seeds of each text: the runs of K words whose hash is a multiple of SPAN.

    A run is a seed wherever it stands, so two texts that share it share the seed, whatever stands around it.
    """
    value, owner, place = word_hashes(texts, K)
    n = value.size - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * np.uint64(_MULTIPLIER) + value[j : n + j]
    h = _mixed(h)
    spacer = np.concatenate([[0], np.cumsum(place < 0)])
    inside = spacer[K : K + n] == spacer[:n]
    # in a run that repeats a few words, the n-th overlapping occurrence of a run of K is a run of its own
    again = np.zeros(n, bool)
    for step in range(1, K + 1):
        same = np.flatnonzero((h[step:] == h[:-step]) & inside[step:] & inside[:-step])
        again[same] = again[same + step] = True
    if again.any():
        at = np.flatnonzero(again)
        order = at[np.lexsort((place[at], h[at], owner[at]))]
        goes_on = np.zeros(order.size, bool)
        goes_on[1:] = (np.diff(owner[order]) == 0) & (h[order][1:] == h[order][:-1]) & (np.diff(place[order]) <= K)
        number = np.arange(order.size)
        rank = number - np.maximum.accumulate(np.where(goes_on, 0, number))
        later = np.flatnonzero(rank)
        h[order[later]] = _mixed(h[order[later]] + rank[later].astype(np.uint64) * np.uint64(_MULTIPLIER))
    at = np.flatnonzero(inside & (h % np.uint64(SPAN) == 0))
    return h[at], owner[at], place[at]


def occurrences(docs: DataFrame) -> DataFrame:
    """hash, doc, pos of all occurrences of seeds, with ref, ref_pos: the batch's first occurrence, if it is another document's.

    prev, prev_pos: the last occurrence in the batch's document before this one by id, if that isn't the first occurrence.
    edge: the document's seed before or behind this one doesn't lie just as far from the same reference.
    """
    fields = [("hash", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("ref", pa.int64()), ("ref_pos", pa.int32()), ("prev", pa.int64()), ("prev_pos", pa.int32()), ("edge", pa.bool_())]

    def run(batches):
        for b in sliced(batches, SLICE):
            h, owner, place = seeds(utf8(b.column(1)))
            if not h.size:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            order = np.lexsort((place, ids, h))
            h, ids, place = h[order], ids[order], place[order]
            number = np.arange(h.size)
            fresh = np.diff(h, prepend=~h[0]) != 0
            lead = np.maximum.accumulate(np.where(fresh, number, 0))
            prev = np.maximum.accumulate(np.where(fresh | (np.diff(ids, prepend=ids[0]) != 0), number, 0)) - 1
            own, alone = ids[lead] == ids, np.maximum(prev, 0)
            no_prev = own | (alone == lead)
            line = np.lexsort((place, ids))
            turn = np.diff(ids[line]) != 0
            turn |= np.diff(ids[lead][line]) != 0
            turn |= np.diff((place[lead] - place)[line]) != 0
            edge = np.empty(h.size, bool)
            edge[line] = np.concatenate([[True], turn]) | np.concatenate([turn, [True]])
            yield record_batch(
                fields,
                [
                    h.view(np.int64),
                    ids,
                    place.astype(np.int32),
                    pa.array(ids[lead], mask=own),
                    pa.array(place[lead].astype(np.int32), mask=own),
                    pa.array(ids[alone], mask=no_prev),
                    pa.array(place[alone].astype(np.int32), mask=no_prev),
                    edge,
                ],
            )

    return docs.mapInArrow(run, "hash long, doc long, pos int, ref long, ref_pos int, prev long, prev_pos int, edge boolean")


def anchors(found: DataFrame) -> DataFrame:
    """doc, ref, pos, ref_pos: each occurrence of a shared seed with the first of its batch, the first of all and the one before.

    Only batches' first documents meet in a window. The others look the first of all up by a join on the hash, and are linked to
    the one before in their batch, at the edges of the runs that they share with the batch's first: within a run of LEAST words
    that reference reports the passage, and a longer passage with another document goes over an edge of each shorter run.
    """
    first, near = found.where("ref is null").select("hash", "doc", "pos"), found.where("ref is not null")
    w = Window.partitionBy("hash").orderBy("doc", "pos")
    before = Window.partitionBy("hash").orderBy("doc").rangeBetween(Window.unboundedPreceding, -1)
    ranked = first.withColumn("lead", F.first(F.struct("doc", "pos")).over(w)).withColumn("prev", F.last(F.struct("doc", "pos")).over(before)).where("lead.doc <> doc")
    ranked = materialize(ranked, "leads")
    pick = lambda d, c="lead": d.select("doc", F.col(f"{c}.doc").alias("ref"), "pos", F.col(f"{c}.pos").alias("ref_pos"))
    leads = ranked.groupBy("hash").agg(F.first("lead").alias("lead"))
    through = near.where("edge").select("hash", "doc", "pos").join(leads, "hash").where("lead.doc <> doc")
    inside = near.where("edge and prev is not null").select("doc", F.col("prev").alias("ref"), "pos", F.col("prev_pos").alias("ref_pos"))
    return near.select("doc", "ref", "pos", "ref_pos").union(inside).union(pick(ranked)).union(pick(ranked, "prev")).union(pick(through))


def chains(pos: np.ndarray, ref: np.ndarray) -> list[np.ndarray]:
    """Best collinear chains of anchors (sorted by pos, then ref), as index arrays, by descending score.

    score(i) = WEIGHT + max(0, max over j with smaller pos and ref of score(j) - GAP x words skipped on both sides); as the cost is
    a difference of sums, the inner maximum is a prefix maximum over the ranks of ref.
    """
    n = pos.size
    rank = (np.searchsorted(np.unique(ref), ref) + 1).tolist()
    top = max(rank) + 1
    tree, who = [-1e18] * (top + 1), [-1] * (top + 1)
    lift = (GAP * (pos + ref)).tolist()
    score, back = [0.0] * n, [-1] * n
    places = pos.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and places[j] == places[i]:  # anchors of one place don't follow each other
            best, arg, k = -1e18, -1, rank[j] - 1
            while k > 0:
                if tree[k] > best:
                    best, arg = tree[k], who[k]
                k -= k & -k
            gain = best - lift[j] + 2 * GAP
            if arg >= 0 and gain > 0:
                score[j], back[j] = WEIGHT + gain, arg
            else:
                score[j] = WEIGHT
            j += 1
        for a in range(i, j):
            value, k = score[a] + lift[a], rank[a]
            while k <= top:
                if value > tree[k]:
                    tree[k], who[k] = value, a
                k += k & -k
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda a: -score[a]):
        if used[end]:
            continue
        path, a = [], end
        while a >= 0 and not used[a]:
            used[a] = True
            path.append(a)
            a = back[a]
        out.append(np.array(path[::-1]))
    return out


_CHAIN = [("doc", pa.int64()), ("ref", pa.int64()), ("weak", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()), ("ref_first", pa.int32()), ("ref_last", pa.int32()), ("steps", pa.binary())]
_CHAINS = "doc long, ref long, weak boolean, first int, last int, ref_first int, ref_last int, steps binary"


def chained(links: DataFrame) -> DataFrame:
    """All chains: first and last word (exclusive) on both sides, steps: (pos, ref_pos) as int32; weak: short of CORE words.

    Of a weak chain's passage the other seeds may have other references; what it shares is found by its words.
    """

    def rows(doc, ref, pos, rpos):
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(ref) != 0)) + 1
        bounds = np.concatenate([[0], cuts, [doc.size]])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            p, r = pos[a:b], rpos[a:b]
            step = r - p
            straight = b - a == 1 or step.min() == step.max() and (np.diff(p) > 0).all() and np.diff(p).max() * 2 * GAP < WEIGHT
            for chain in [np.arange(b - a)] if straight else chains(p, r):
                weak = bool(min(p[chain[-1]] - p[chain[0]], r[chain[-1]] - r[chain[0]]) + K < CORE)
                both = np.stack([p[chain], r[chain]], axis=1).astype("<i4")
                yield int(doc[a]), int(ref[a]), weak, int(p[chain[0]]), int(p[chain[-1]]) + K, int(r[chain[0]]), int(r[chain[-1]]) + K, both.tobytes()

    def run(batches):
        held = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not now[0].size:
                continue
            start = int(np.searchsorted(now[0], now[0][-1]))  # the last document may go on
            held = [x[start:] for x in now]
            if start and (out := list(rows(*(x[:start] for x in now)))):
                yield record_batch(_CHAIN, list(zip(*out, strict=True)))
        if held is not None and (out := list(rows(*held))):
            yield record_batch(_CHAIN, list(zip(*out, strict=True)))

    # dealt out first: the distinct links need no exchange of their own
    ordered = links.select("doc", "ref", "pos", "ref_pos").repartition("doc").distinct().sortWithinPartitions("doc", "ref", "pos", "ref_pos")
    return ordered.mapInArrow(run, _CHAINS)


def words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, words (32 bits of each word's hash) of at least the documents with the given ids."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches):
        for b in sliced(batches):
            keep = np.flatnonzero(member(shared.value, b.column(2).to_numpy(zero_copy_only=False)))
            if not keep.size:
                continue
            part = b.take(pa.array(keep))
            value, owner, _ = word_hashes(utf8(part.column(1)))
            value = value.astype("<u4")
            cuts = np.searchsorted(owner, np.arange(keep.size + 1))
            out = [value[a:e].tobytes() for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield record_batch([("doc", pa.int64()), ("words", pa.binary())], [part.column(0), out])

    return docs.select("doc_id", "text", slots(F.col("doc_id")).alias("slot")).mapInArrow(run, "doc long, words binary")


def _documents(chain: DataFrame) -> DataFrame:
    """id of the documents of chains, on either side."""
    return chain.select(F.col("doc").alias("id")).union(chain.select(F.col("ref").alias("id"))).distinct()


def _still(kept: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``words`` of at least the documents with the given ids."""
    shared = kept.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches):
        for b in sliced(batches):
            part = b.filter(pa.array(member(shared.value, b.column(2).to_numpy(zero_copy_only=False))))
            if part.num_rows:
                yield part.select(["doc", "words"])

    return kept.select("doc", "words", slots(F.col("doc")).alias("slot")).mapInArrow(run, "doc long, words binary")


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(equal words, columns) of the best alignment of two short runs."""
    if a.size == b.size and a.size:
        same = int((a == b).sum())
        if same * 2 >= a.size or a.size > 200:
            return same, a.size
    if not a.size or not b.size or a.size * b.size > 40_000:
        return 0, max(a.size, b.size)
    row = np.zeros(b.size + 1, np.int64)  # longest common subsequence
    for x in a:
        up = row[:-1] + (b == x)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], up))
    return int(row[-1]), max(a.size, b.size)


def _beyond(a: np.ndarray, b: np.ndarray, cut=(False, False)) -> tuple[int, int, int, int, bool]:
    """(words, words of b, equal words, columns, open) by which an end grows while at least two thirds of the words agree.

    A diagonal's growth is over where its gain (1 a word, -2 an unlike one) falls by DROP. There, up to SHIFT words of one side
    may be skipped if nearly all of the RESUME words behind them agree. open: the side that is cut ends before that is known.
    """
    x = y = same = size = 0
    while True:
        n, over = min(a.size - x, b.size - y), False
        if n:
            equal = a[x : x + n] == b[y : y + n]
            gain = np.cumsum(np.where(equal, 1, -2))
            fell = np.flatnonzero(np.maximum(np.maximum.accumulate(gain), 0) - gain >= DROP)
            over = fell.size > 0
            gain = gain[: fell[0]] if over else gain
            best = int(np.argmax(gain)) if gain.size else 0
            if gain.size and gain[best] > 0:
                x, y, same, size = x + best + 1, y + best + 1, same + int(equal[: best + 1].sum()), size + best + 1
        for i, j in _SHIFTS:
            p, q = a[x + i : x + i + RESUME], b[y + j : y + j + RESUME]
            if p.size == q.size == RESUME and p[0] == q[0] and int((p == q).sum()) >= RESUME - 1:
                x, y, size = x + i, y + j, size + max(i, j)
                break
        else:
            more, rest = a.size - x, b.size - y
            return x, y, same, size, not over and ((cut[0] and more <= rest + SHIFT + RESUME) or (cut[1] and rest <= more + SHIFT + RESUME))


def _hopeless(a: np.ndarray, b: np.ndarray, margin: int) -> np.ndarray:
    """Rows of words around a single seed, ``margin`` on each side, in which nothing grows up to an edge; may miss some."""
    out = np.ones(len(a), bool)
    for x, y in ((a[:, :margin][:, ::-1], b[:, :margin][:, ::-1]), (a[:, margin + K :], b[:, margin + K :])):
        gain = np.cumsum(np.where(x == y, 1, -2), axis=1)
        out &= (np.maximum(np.maximum.accumulate(gain, axis=1), 0) - gain >= DROP).any(axis=1)
        for i, j in _SHIFTS:
            n = margin - max(i, j)
            equal = np.cumsum(np.pad(x[:, i : i + n] == y[:, j : j + n], ((0, 0), (1, 0))), axis=1)
            out &= (equal[:, RESUME:] - equal[:, :-RESUME] < RESUME - 1).all(axis=1)
    return out


def _path(left: np.ndarray, right: np.ndarray, p: list[int], r: list[int]) -> list[tuple[int, ...]]:
    """Blocks (begin, end, ref begin, ref end, equal words, columns) along a chain: runs of seeds, and the gaps between them."""
    out, x, y = [(p[0], p[0], r[0], r[0], 0, 0)], p[0], r[0]
    for i, j in zip(p, r, strict=True):
        if i > x or j > y:
            if i >= x and j >= y:
                out.append((x, i, y, j, *_gap(left[x:i], right[y:j])))
                out.append((i, i, j, j, 0, 0))
                x, y = i, j
            else:  # overlaps the last seed on one side only
                continue
        grow = min(i + K - x, j + K - y)
        if grow > 0:
            a, _, b, _, same, size = out[-1]
            same += int((left[x : x + grow] == right[y : y + grow]).sum())
            x, y = x + grow, y + grow
            out[-1] = (a, x, b, y, same, size + grow)
    return out


def _narrowed(left: np.ndarray, right: np.ndarray, path: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The path with gaps cut down to what the runs beside them don't grow over."""
    out = path[:1]
    for (x, i, y, j, same, size), (_, end, _, rend, run, cols) in zip(path[1::2], path[2::2], strict=True):
        n, rn, s, grown, _ = _beyond(left[x:i], right[y:j])
        a, _, b, _, e, c = out[-1]
        out[-1] = (a, x + n, b, y + rn, e + s, c + grown)
        x, y = x + n, y + rn
        m, rm, t, back, _ = _beyond(left[x:i][::-1], right[y:j][::-1])
        i, j = i - m, j - rm
        inner = _gap(left[x:i], right[y:j]) if grown or back else (same, size)
        out += [(x, i, y, j, *inner), (i, end, j, rend, run + t, cols + back)]
    return out


def _longest(path: list[tuple[int, ...]]) -> tuple[int, int]:
    """(first, last) of the longest stretch from run to run that is similar enough."""
    gain = np.concatenate([[0.0], np.cumsum([same - SIMILAR * size for *_, same, size in path])])
    before, after = gain[:-1:2], gain[1::2]  # a run, which stands at an even place, begins and ends a stretch
    reach = np.maximum.accumulate(after[::-1])[::-1]
    last = np.searchsorted(-reach, -before + 1e-9, side="right") - 1
    sizes = [path[2 * int(j)][1] - path[2 * i][0] if j >= i else -1 for i, j in enumerate(last)]
    i = int(np.argmax(sizes))
    return 2 * i, 2 * int(last[i])


def align(left: np.ndarray, right: np.ndarray, steps: np.ndarray, at: int, ref_at: int, cut=(False, False)) -> list[tuple[int, ...]] | None:
    """(start, end, ref start, ref end, equal words, columns) of the passages of a chain; left and right begin at words at and ref_at.

    cut: whether left and right are cut off behind their last words. None if more words are needed.

    A chain that is similar enough is one passage. Another is split at the gaps that make it unlike: its longest similar
    stretch is taken, then that of what lies before it and behind it.
    """

    undecided = False

    def grown(path, low, high):
        """The stretch with its ends grown between the words (both sides) low and high."""
        (start, _, rstart, *_), (_, x, _, y, *_) = path[0], path[-1]
        same, size = (sum(b[c] for b in path) for c in (4, 5))
        nonlocal undecided
        n, rn, s, back, one = _beyond(left[low[0] : start][::-1], right[low[1] : rstart][::-1], (low == ends[0] and at > 0, low == ends[0] and ref_at > 0))
        m, rm, t, ahead, two = _beyond(left[x : high[0]], right[y : high[1]], (high == ends[1] and cut[0], high == ends[1] and cut[1]))
        undecided |= one or two
        return start - n, x + m, rstart - rn, y + rm, same + s + t, size + back + ahead

    def good(found):
        return found[1] - found[0] >= LEAST and found[4] >= SIMILAR * found[5]

    ends = (0, 0), (left.size, right.size)
    path = _path(left, right, (steps[:, 0] - at).tolist(), (steps[:, 1] - ref_at).tolist())
    found = [grown(path, *ends)]
    if not good(found[0]):
        found, rest = [], [(_narrowed(left, right, path), *ends)]
        while rest:
            part, low, high = rest.pop()
            i, j = _longest(part)
            if j < i:
                continue
            core = part[i : j + 1]
            edges = (core[0][0], core[0][2]), (core[-1][1], core[-1][3])
            found += [one for one in (grown(core, low, high), grown(core, *edges)) if good(one)][:1]
            if i:
                rest.append((part[: i - 1], low, (part[i][0], part[i][2])))
            if j + 1 < len(part):
                rest.append((part[j + 2 :], (part[j][1], part[j][3]), high))
    if undecided:
        return None
    return [(s + at, e + at, rs + ref_at, re_ + ref_at, same, size) for s, e, rs, re_, same, size in sorted(found)]


_PASSAGE = [("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32()), ("ref_end", pa.int32()), ("equal_words", pa.int32()), ("similarity", pa.float64())]
_PASSAGES = "doc_id long, start_word int, end_word int, ref_doc_id long, ref_start int, ref_end int, equal_words int, similarity double"


def _aligned(chain: DataFrame, kept: DataFrame, margin: int) -> DataFrame:
    """The chains' passages, with weak; or, where one grows over the words looked at, more: the chain itself, as doc and so on."""

    def cut(first: str, last: str):
        begin = F.greatest(F.col(first) - margin, F.lit(0))
        return F.substring(F.col("words"), begin * 4 + 1, (F.col(last) + margin - begin) * 4)

    one = chain.join(kept, "doc").withColumn("a", cut("first", "last")).drop("words")
    two = one.join(kept.withColumnRenamed("doc", "ref"), "ref").withColumn("b", cut("ref_first", "ref_last"))
    fields = [*_PASSAGE, *_CHAIN]

    def run(batches):
        for b in sliced(batches):
            out, weak, wide = [], b.column(2).to_numpy(zero_copy_only=False), 2 * margin + K
            length = [pc.binary_length(b.column(c)).to_numpy() for c in (8, 9)]
            first, last = (b.column(c).to_numpy() for c in (3, 4))
            alone = np.flatnonzero(weak & (last - first == K) & (length[0] == 4 * wide) & (length[1] == 4 * wide)) if margin == MARGIN else np.zeros(0, int)
            if alone.size:
                x, y = (np.frombuffer(b"".join(b.column(c).take(pa.array(alone)).to_pylist()), "<u4").reshape(-1, wide) for c in (8, 9))
                b = b.filter(pa.array(~np.isin(np.arange(b.num_rows), alone[_hopeless(x, y, margin)])))
            for row in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                doc, ref, weak, first, last, ref_first, ref_last, steps, x, y = row
                at, ref_at = max(0, first - margin), max(0, ref_first - margin)
                # a side that is cut off ends just where it was asked to
                cuts = len(x) // 4 == last + margin - at, len(y) // 4 == ref_last + margin - ref_at
                found = align(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), np.frombuffer(steps, "<i4").reshape(-1, 2).astype(np.int64), at, ref_at, cuts)
                if found is None:
                    out.append((*[None] * 8, *row[:8]))
                    continue
                out += [(doc, s, e, ref, rs, re_, same, same / size, None, None, weak, *[None] * 5) for s, e, rs, re_, same, size in found]
            if out:
                yield record_batch(fields, list(zip(*out, strict=True)))

    return two.select(*(n for n, _ in _CHAIN), "a", "b").mapInArrow(run, f"{_PASSAGES}, {_CHAINS}")


def _without_parts(found: DataFrame) -> DataFrame:
    """Weak chains' passages go if another passage of the two documents holds them on both sides."""

    def run(batches):
        for t, cuts in complete_groups(batches, 2):
            cols = [t.column(c).to_numpy() for c in range(2, 6)]
            weak, keep = t.column(8).to_numpy(), np.ones(t.num_rows, bool)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s, e, rs, re_ = (c[a:b] for c in cols)
                for k in np.flatnonzero(weak[a:b]).tolist() if b - a > 1 else []:
                    holds = (s <= s[k]) & (e >= e[k]) & (rs <= rs[k]) & (re_ >= re_[k]) & keep[a:b]
                    holds[k] = False
                    keep[a + k] = not holds.any()
            yield from t.filter(pa.array(keep)).select([n for n, _ in _PASSAGE]).to_batches()

    keys = ["doc_id", "ref_doc_id"]
    rows = found.select(*keys, "start_word", "end_word", "ref_start", "ref_end", "equal_words", "similarity", F.col("weak").cast("int").alias("weak"))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _PASSAGES)


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per passage of a document and an earlier place of it in another document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    found = materialize(occurrences(docs), "seeds")
    chain = materialize(chained(anchors(found)), "chains")
    discard(found)
    del found
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()  # the links' shuffle files go before texts are dealt out
    kept = materialize(words(docs, _documents(chain)), "words")
    margin, done = MARGIN, None
    while True:
        found = materialize(_aligned(chain, kept.dropDuplicates(["doc"]), margin), "passages")
        ready = found.where("doc is null")
        done = ready if done is None else done.union(ready)
        chain = found.where("doc is not null").select(*(n for n, _ in _CHAIN))
        if chain.isEmpty():
            return _without_parts(done)
        margin *= 8  # passages that go on
        whole, kept = kept, materialize(_still(kept, _documents(chain)), "words")  # only their documents are dealt out again
        discard(whole)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


QUERIES = {"op6_passages": op6_passages}
