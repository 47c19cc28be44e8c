"""Language identification by compression: the raw-content zstandard dictionary that encodes a text smallest wins.

Defined cases. Null text, or text without a letter: ``und``, score 0. Every other text gets a learned language;
ties go to the language with more training rows, then to the smaller name. Texts are scored whole, in blocks of
``BLOCK`` folded bytes that are each encoded from the dictionary alone, so that long texts keep their evidence. A narrow margin
of a few bytes is measured more finely: the text's different words are encoded from ``PARTS`` parts of each dictionary at each of
the ``LEVELS``, and the mean sizes decide. Texts without words that the dictionaries tell apart stay narrow. An empty training set yields ``und`` for all. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import crc_mod, record_batch, sliced, strings, table
from rangeloom.llm.rows import rewritten

#: Bounds of the fitted model: expected documents and dictionary bytes, per language. Only whole texts go into a dictionary.
SAMPLE_DOCS, DICT_BYTES = 400, 96 << 10
BLOCK, LEVEL = 1024, 6
#: The finer measure: levels, parts of a dictionary, and words encoded at once.
LEVELS, PARTS, WORDS = (3, 6, 9), 4, 200
#: Stands before the words: a block that wouldn't shrink is stored as it is, so few words alone would have the same size everywhere.
CARRIER = bytes(64)
#: Least share of bytes by which the best language has to beat the second for ``accepted``.
MARGIN = 0.001
#: Bytes of difference that are measured more finely.
NARROW = 3

_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)  # also finds numbers that aren't decimal digits
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text)))


def folded(text: str) -> bytes:
    """What is encoded: lower case, each run of other characters than letters as one blank."""
    return _REST.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", where=None) -> list[tuple[str, bytes]]:
    """Per-language dictionaries, most frequent language first, from a hash sample of bounded expected size."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(label).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.length("t") > 0))
    if where is not None:
        rows = rows.where(where(F.col("i")))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rate = F.lit(None)
    for name, n in counts.items():
        rate = F.when(F.col("l") == name, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(rate)
    spread = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where((spread < rate) & (F.length("t") < DICT_BYTES)).select("l", "i", "t").collect()
    model = []
    for name in sorted(counts, key=lambda k: (-counts[k], k)):
        parts, size = [], 0
        for r in sorted((r for r in picked if r["l"] == name), key=lambda r: (str(r["i"]), r["t"])):
            part = folded(r["t"])
            if size + len(part) < DICT_BYTES:  # what doesn't fit whole is left out, so that all dictionaries fill up
                parts.append(part)
                size += len(part) + 1
        data = b"\n".join(parts)
        if len(data) >= 8:
            model.append((name, data))
    return model


def _coder(data: bytes, level: int, most: int):
    """Compresses short texts, of up to ``most`` bytes, from a raw-content dictionary."""
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=most, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress


def _scorer(model):
    coders = [_coder(data, LEVEL, BLOCK) for _, data in model]

    @functools.cache
    def fine():
        """For each language the coders of its dictionary's parts; made when a text first needs them."""
        return [[_coder(data[i * len(data) // PARTS : (i + 1) * len(data) // PARTS], level, 4 * BLOCK) for i in range(PARTS) for level in LEVELS] for _, data in model]

    names = [n for n, _ in model]

    def score(text: str):
        """(language, score, relative margin) of one text."""
        if not names or not has_letter(text):
            return "und", 0.0, 0.0
        data = folded(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in coders]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(sizes) == 1:
            return names[0], 1.0, 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        gain = second - sizes[best]
        size = len(data)
        if gain < max(MARGIN * size, NARROW):
            words = list(dict.fromkeys(data.split()))
            pieces = [CARRIER + b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)]
            size = sum(map(len, words)) + len(words) + 1
            sizes = [sum(len(c(x)) for c in own for x in pieces) / len(own) for own in fine()]
            best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
            gain = min(s for k, s in enumerate(sizes) if k != best) - sizes[best]
        return names[best], 1.0 / (1.0 + math.exp(-min(gain, 60) / 4.0)), gain / max(size, 1)

    return score


FIELDS = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())]


def identify(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, margin, accepted (the margin is not narrow)."""

    def run(batches):
        score = _scorer(model)
        for b in sliced(batches):
            found = [score(t) for t in strings(b.column(1))]
            yield record_batch(FIELDS, [b.column(0), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [x[0] != "und" and x[2] >= MARGIN for x in found]])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, margin double, accepted boolean"
    )


def accepted(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The table's rows whose language is told with enough margin."""

    def begin():
        score = _scorer(model)

        def change(batch, extras):
            found = [score(t) for t in strings(extras[0])]
            yield batch.filter(pa.array([x[0] != "und" and x[2] >= MARGIN for x in found], pa.bool_()))

        return change

    return rewritten(docs, {"text": F.col(text)}, begin)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, where=lambda i: crc_mod(i, 5) != 0)
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "accepted")


QUERIES = {"op10_language": op10_language}
