"""Toxicity by a gapped-subsequence string kernel, Nyström landmarks and a linear support vector machine.

Kernel: the subsequences of three symbols of a word (with its borders), spans of up to five, weighted ``DECAY`` for each
gap, divided by the words' norms; inserted or missing letters keep most of the common subsequences. A sentence scores as
its most insulting word, a text as its worst sentence. Labels belong to texts, so the machine is trained in turns:
each toxic text offers the word that scores highest as an example, clean texts offer their highest words and others;
landmarks are drawn from both. As the feature space is finite, the weights of the landmarks are folded into one weight for
each subsequence, so scoring a word takes one look-up for each of its subsequences. The best scores of the texts left out
of this training are turned into probabilities by a logistic fit.

Bounds: at most about ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled texts are fetched, by a hash of the id.

Defined cases. Null, empty and blank texts score as a text without any sign of toxicity. Without both labels to learn from
every text scores 0. Longer words than ``WORD`` are read in overlapping pieces; single letters with blanks between them
also as one word. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import crc_mod, record_batch, sliced, strings, table

SAMPLE_TOXIC, SAMPLE_CLEAN = 1600, 2400
WORD, OVERLAP, DECAY, GAPS = 32, 12, 0.6, ((1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1))
LANDMARKS, ROUNDS, COST, WITNESSES = 240, 4, 200.0, 3
THRESHOLD, CACHE = 0.3, 500_000
BASE = 64
_SPACED = re.compile(r"(?:(?<!\S)\S\s){3,}")
_EDGES = ".,;:!?\"'()[]{}|*#%&$"


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation at their edges; see the module for long and spaced ones."""
    text = text.lower()
    found = [w.strip(_EDGES) for w in text.split()]
    if m := _SPACED.search(text):
        found += [re.sub(r"\s", "", m.group()) for m in _SPACED.finditer(text, m.start())]
    if any(len(w) > WORD for w in found):
        step = WORD - OVERLAP
        found = [p for w in found for p in ([w] if len(w) <= WORD else [w[i : i + WORD] for i in range(0, len(w) - OVERLAP, step)])]
    return found


_class = np.array([37 + c % 26 for c in range(0x110000)], np.uint8)
_class[ord("a") : ord("z") + 1] = np.arange(1, 27)
_class[ord("0") : ord("9") + 1] = np.arange(27, 37)
_class[0] = 0


def features(words: list[str], gaps=GAPS):
    """(word index, code, weight) of all subsequences, and each word's norm."""
    flat = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    symbol, owner = _class[flat].astype(np.int32), np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)
    symbol[ends - 1] = 63
    rows, codes, weights = [], [], []
    for a, b in gaps:
        n = flat.size - a - b
        if n <= 0:
            continue
        same = np.flatnonzero(owner[:n] == owner[a + b :])
        rows.append(owner[same])
        codes.append((symbol[same] * BASE + symbol[same + a]) * BASE + symbol[same + a + b])
        weights.append(np.full(same.size, DECAY ** (a + b - 2), np.float32))
    if not rows:
        rows, codes, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    row, code, weight = map(np.concatenate, (rows, codes, weights))
    norm = np.sqrt(np.maximum(np.bincount(row, weights=weight * weight, minlength=len(words)), 1e-12))
    return row, code, weight, norm


def word_scores(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    row, code, weight, norm = features(words)
    return np.bincount(row, weights=weight * weights[code], minlength=len(words)) / norm + bias


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    row, code, weight, norm = features(landmarks)
    used = np.unique(code)
    place = np.full(BASE**3, -1, np.int32)
    place[used] = np.arange(used.size)
    dense = np.zeros((used.size, len(landmarks)), np.float32)
    np.add.at(dense, (place[code], row), weight / norm[row])
    out = np.zeros((len(words), len(landmarks)), np.float32)
    row, code, weight, norm = features(words)
    at = place[code]
    shared = np.flatnonzero(at >= 0)
    shared = shared[np.argsort(row[shared], kind="stable")]
    for i in range(0, shared.size, 50_000):
        part = shared[i : i + 50_000]
        r = row[part]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[first]] += np.add.reduceat(dense[at[part]] * (weight[part] / norm[r])[:, None], first, axis=0)
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, steps: int = 400):
    """Squared-hinge linear machine of weighted examples with balanced classes, by accelerated gradient descent."""
    n, d = x.shape
    share = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y < 0].sum()) * n
    x1 = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1)
    rate = 1.0 / (1.0 / cost / 10 + 2 * np.linalg.norm(x1 * np.sqrt(share / n)[:, None], 2) ** 2)
    theta = np.zeros(d + 1)
    look, t = theta, 1.0
    keep = np.append(np.full(d, 0.1 / cost), 0.0)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ look))
        grad = keep * look - 2 / n * (x1.T @ (share * slack * y))
        new = look - rate * grad
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, theta, t = new + (t - 1) / s * (new - theta), new, s
    return theta[:-1], theta[-1]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60):
    """Ridge logistic regression by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(w.size) * 0.01
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (p - y) + ridge @ w)
    return w


def _substrings(words: list[str], lengths=(3, 5, 7), slots: int = 1 << 21):
    """(word index, slot) of the contiguous runs of symbols, borders included, sorted by word."""
    flat = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    rows, codes = [], []
    for k in lengths:
        n = flat.size - k + 1
        if n <= 0:
            continue
        code = np.full(n, k, np.int64)
        for j in range(k):
            code = (code * 1_000_003 + flat[j : j + n]) & 0x7FFFFFFFFFF
        same = np.flatnonzero(owner[:n] == owner[k - 1 :])
        rows.append(owner[same])
        codes.append((code[same] ^ code[same] >> 19) % slots)
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.argsort(row, kind="stable")
    return row[order], code[order], slots


def _first_scores(bags, labels, vocabulary):
    """Starting point: a word scores the best log odds, toxic against clean texts, of the substrings in it."""
    row, code, slots = _substrings(vocabulary)
    starts = np.searchsorted(row, np.arange(len(vocabulary) + 1))
    seen = np.zeros((2, slots), np.float32)
    for bag, label in zip(bags, labels, strict=True):
        if len(bag):
            seen[label, np.unique(np.concatenate([code[starts[i] : starts[i + 1]] for i in bag.tolist()]))] += 1
    n = np.bincount(labels, minlength=2)
    gain = seen[1] * np.log((seen[1] + 0.5) / (n[1] + 1) / ((seen[0] + 0.5) / (n[0] + 1)))
    odds = np.log((seen[1] + 0.5) / (n[1] + 1) / ((seen[0] + 0.5) / (n[0] + 1))) * np.minimum(1, np.sqrt(np.maximum(gain, 0) / (0.05 * max(n[1], 1))))
    best = np.full(len(vocabulary), -9.0)
    np.maximum.at(best, row, odds[code])
    return best


def _summary(scores: np.ndarray) -> tuple[float, float, float]:
    """What the calibration sees of a text: best score, third best, number of words over the border."""
    if not scores.size:
        return (-1.5, -1.5, 0.0)
    top = np.sort(scores)[-3:]
    third = max(-1.5, float(top[0])) if scores.size > 2 else -1.5
    return (max(-1.5, float(top[-1])), third, float(np.log1p((scores > 0).sum())))


def fit(texts: list[str], labels: list[int], share: float | None = None, seed: int = 7):
    """(weights of subsequences, bias, calibration), or None without both labels; share: of toxic texts among all labelled."""
    labels = np.array(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    bags = [np.unique([number.setdefault(w, len(number)) for w in words_of(t) if len(w) > 1]).astype(np.int64) for t in texts]
    vocabulary = list(number)
    if not vocabulary:
        return None
    learn = np.ones(len(bags), bool)
    for label in (0, 1):  # every third text calibrates
        own = np.flatnonzero(labels == label)
        if own.size >= 6:
            learn[rng.permutation(own)[: own.size // 3]] = False
    toxic = [b for b, y, k in zip(bags, labels, learn, strict=True) if y and k and b.size]
    clean = [b for b, y, k in zip(bags, labels, learn, strict=True) if not y and k and b.size]
    score = _first_scores([*toxic, *clean], np.array([1] * len(toxic) + [0] * len(clean)), vocabulary)
    weights, bias = np.zeros(BASE**3, np.float32), -1.0
    for _ in range(ROUNDS):
        # beyond its best word a toxic text witnesses with words that hardly any clean text has the like of
        border = np.quantile([score[b].max() for b in clean], 0.95) if clean else np.inf
        picked = [b[np.argsort(-score[b])[:WITNESSES]] for b in toxic]
        picked = [np.concatenate([w[:1], w[1:][score[w[1:]] > border]]) for w in picked]
        votes = np.bincount(np.concatenate(picked), minlength=len(vocabulary)) if toxic else np.zeros(len(vocabulary), np.int64)
        hard = np.unique(np.concatenate([b[np.argsort(-score[b])[:WITNESSES]] for b in clean])) if clean else np.zeros(0, np.int64)
        seen_clean = np.unique(np.concatenate(clean)) if clean else np.zeros(0, np.int64)
        other = rng.choice(seen_clean, min(2500, seen_clean.size), replace=False) if seen_clean.size else seen_clean
        dirty = np.bincount(np.concatenate(clean), minlength=len(vocabulary)) if clean else np.zeros(len(vocabulary), np.int64)
        good = np.flatnonzero(votes > 3 * dirty * len(toxic) / max(len(clean), 1))
        hard = np.setdiff1d(hard, good)
        bad = np.setdiff1d(np.union1d(hard, other), good)
        if not good.size or not bad.size:
            break
        common = good[np.argsort(-votes[good], kind="stable")][: LANDMARKS // 3]
        marks = np.concatenate([common, rng.permutation(np.setdiff1d(good, common))[: LANDMARKS // 3], rng.permutation(hard)[: LANDMARKS // 3]])
        landmarks = [vocabulary[i] for i in marks.tolist()]
        words = [vocabulary[i] for i in [*good.tolist(), *bad.tolist()]]
        y = np.array([1.0] * good.size + [-1.0] * bad.size)
        values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(float))
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))
        theta, bias = _machine(_kernel(words, landmarks) @ root, y, np.concatenate([votes[good], np.ones(bad.size)]))
        beta = root @ theta
        row, code, weight, norm = features(landmarks)
        weights = np.bincount(code, weights=weight * (beta / norm)[row], minlength=BASE**3).astype(np.float32)
        score = word_scores(vocabulary, weights, bias)
    x = np.array([_summary(score[b]) for b, k in zip(bags, learn, strict=True) if not k])
    held = labels[~learn]
    if len(set(held.tolist())) < 2:
        x, held = np.array([_summary(score[b]) for b in bags]), labels
    calibration = _logistic(x, held)
    if share is not None and 0 < share < 1:
        calibration[-1] += np.log(share / (1 - share)) - np.log(held.sum() / (len(held) - held.sum()))
    return weights, float(bias), calibration


def _scorer(model):
    weights, bias, calibration = model
    known: dict[str, float] = {}

    def scores(texts: list[str]) -> list[float]:
        if len(known) > CACHE:
            known.clear()
        bags = [set(words_of(t)) for t in texts]
        new = [w for w in set().union(*bags).difference(known) if len(w) > 1]
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            known.update(zip(part, word_scores(part, weights, bias).tolist(), strict=True))
        get = known.get
        x = np.array([_summary(np.array([s for w in bag if (s := get(w)) is not None])) for bag in bags])
        return (1 / (1 + np.exp(-np.clip(x @ calibration[:-1] + calibration[-1], -30, 30)))).tolist()

    return scores


FIELDS = [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())]


def classify(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _scorer(shared.value) if shared.value is not None else lambda texts: [0.0] * len(texts)
        for b in sliced(batches, 2 << 20):
            s = scores(strings(b.column(1)))
            yield record_batch(FIELDS, [b.column(0), s, [int(x >= THRESHOLD) for x in s]])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, where, label: str = "toxic") -> tuple[list[str], list[int], float]:
    """A bounded hash sample of labelled texts, in the order of their ids, and the share of toxic ones among all."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(where(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    n = defaultdict(int, {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()})
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, SAMPLE_TOXIC / max(n[1], 1)))).otherwise(F.lit(min(1.0, SAMPLE_CLEAN / max(n[0], 1))))
    spread = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.where(spread < rate)
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), "text").join(F.broadcast(few), "i").where(F.col("text").isNotNull()).collect()
    rows.sort(key=lambda r: (r["i"], r["text"]))
    return [r["text"] for r in rows], [r["y"] for r in rows], n[1] / max(n[0] + n[1], 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels"), lambda i: crc_mod(i, 4) != 2))
    out = classify(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
