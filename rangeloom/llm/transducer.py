"""Token counts by finite-state tokenizer compilation.

The word-level BPE vocabulary (lower case, blanks dropped, words end in a marked symbol) is turned into a
deterministic transducer over code points whose transitions carry the number of tokens they add. A state is what the
rest of a word can still depend on: the longest suffix that begins some token, the last token and relative token
count of the best encoding up to each place in that suffix, and what ending the word here would add; around it stands
the splitter's state (between words, in letters, in other signs, after an apostrophe). An encoding is the library's
if and only if each two neighbouring tokens encode to themselves, so the states are finite for words of any length.
States and transitions are compiled when a text first needs them and kept by the worker, within ``MOST_STATES``; beyond
that, also in the middle of a word, all but the states in use are forgotten.

Texts are cut into chunks that run side by side, each from the state that the ``LEAD`` symbols before it lead to: what a
word's encoding depends on seldom reaches further back. So each chunk has a map from this start state to its end state; from
its first blank on the map is constant. A prefix scan (``composed``) joins neighbouring maps by doubling spans as long as
the left one's end state is the right one's start. Where it is not, the chunk is run again from the left one's end
state and the maps are composed anew, until every chunk starts where the one before it ends.

Defined cases. Null text counts as empty: no bytes, no tokens. Special strings inside a text count as one token each.
Repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import record_batch, sliced, table

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
CHUNK, LEAD, MOST_STATES, COLUMNS = 512, 48, 300_000, 112
#: Start states of a map that is constant, and of one that no state is known for; the end state of the latter.
ANY, NEVER, NONE = -1, -2, -3
#: Symbols that end a word are moved here, one character each.
_END = 0xE000
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_CLASSES = regex.compile(r"(\p{L})|(\p{N})|(\s)")


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def char_class(char: str) -> str:
    m = _CLASSES.match(char)
    return "other" if m is None else ("letter", "number", "blank")[m.lastindex - 1]


class WordMachine:
    """States of words under a BPE vocabulary; ``step`` reads one symbol."""

    def __init__(self, model: dict):
        signs = {}
        self.rank = {}
        for sign in _byte_signs():
            signs[sign], signs[sign + "</w>"] = sign, chr(_END + ord(sign))
        self.tokens = set(signs.values())
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = signs[a], signs[b]
            self.rank.setdefault((x, y), i)
            signs.setdefault(a + b, x + y)
            self.tokens.add(x + y)
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.longest = max(map(len, self.tokens))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.start = ("", (None,), (0,), 0)

    def encode(self, symbols: str) -> list[str]:
        parts = list(symbols)
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            a, b = parts[at], parts[at + 1]
            new, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    new.append(a + b)
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            parts = new
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        if left is None:
            return self.encode(right) == [right] if len(right) > 1 else True
        key = (left, right)
        if (got := self.pairs.get(key)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.encode(left + right) == [left, right]
        return got

    def last(self, suffix: str, lasts, counts, symbol: str):
        """(last token, count) of the encoding that the symbol ends."""
        for i in range(len(suffix) + 1):
            token = suffix[i:] + symbol
            if token in self.tokens and self.fits(lasts[i], token):
                return token, counts[i] + 1
        raise AssertionError("each symbol is a token")

    def step(self, state, symbol: str):
        """(state, tokens added) after a symbol inside a word."""
        suffix, lasts, counts, _ = state
        token, count = self.last(suffix, lasts, counts, symbol)
        ended = self.last(suffix, lasts, counts, chr(_END + ord(symbol)))[1]
        text, lasts, counts = suffix + symbol, (*lasts, token), (*counts, count)
        drop = 0
        while text[drop:] not in self.prefixes:
            drop += 1
        return (text[drop:], lasts[drop:], tuple(c - count for c in counts[drop:]), ended - count), count

    def word(self, state, char: str, signs):
        """(state, tokens added) after a character's bytes."""
        added = 0
        for b in char.encode("utf-8"):
            state, n = self.step(state, signs[b])
            added += n
        return state, added


def composed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """State behind each chunk of a text by a prefix scan over the chunks' maps, ``NONE`` where they don't meet.

    A map leads from the state ``first`` to ``last``, or from ``ANY`` state; of other start states it knows nothing yet.
    """
    span = 1
    while span < first.size:
        constant, meets = first[span:] == ANY, first[span:] == last[:-span]
        lead = np.where(constant, ANY, np.where(meets, first[:-span], NEVER))
        first, last = np.append(first[:span], lead), np.append(last[:span], np.where(constant | meets, last[span:], NONE))
        span *= 2
    return last


class Transducer:
    """Lazily compiled transitions between numbered states. State 0 stands between words."""

    def __init__(self, machine: WordMachine):
        self.machine, self.signs = machine, _byte_signs()
        self.clear()

    def clear(self) -> None:
        self.names: dict = {("S",): 0}
        self.states = [("S",)]
        self.table = np.full(4096 * COLUMNS, -1, np.int32)
        self.column = np.full(0x110000, COLUMNS - 1, np.uint8)
        self.chars: list[str] = []
        self.rare: dict[tuple[int, int], tuple[int, int]] = {}
        self.kinds: dict[str, str] = {}
        self.held = np.zeros(0, np.int64)

    def renewed(self, numbers: np.ndarray) -> np.ndarray:
        """Forgets all compiled states but the given ones and those met before a run; returns their new numbers."""
        kept = {n: self.states[n] for n in {*numbers.tolist(), *self.held.tolist()}}
        columns, held = (self.column, self.chars), self.held
        self.clear()
        (self.column, self.chars), self.held = columns, held
        fresh = {n: self.number(state) for n, state in kept.items()}
        self.held[:] = [fresh[n] for n in self.held.tolist()]
        return np.array([fresh[n] for n in numbers.tolist()], np.int64)

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """Column of each code point; the last one stands for all beyond the first ``COLUMNS - 1``."""
        out = self.column[codes]
        if len(self.chars) < COLUMNS - 1 and (out == COLUMNS - 1).any():
            for c in np.unique(codes[out == COLUMNS - 1]).tolist():
                if len(self.chars) < COLUMNS - 1:
                    self.column[c] = len(self.chars)
                    self.chars.append(chr(c))
            out = self.column[codes]
        return out

    def number(self, state) -> int:
        n = self.names.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
            if n * COLUMNS >= self.table.size:
                self.table = np.concatenate([self.table, np.full(self.table.size, -1, np.int32)])
        return n

    def begin(self, char: str):
        """(state, tokens added) of a character between words."""
        kind = self.kinds.get(char) or self.kinds.setdefault(char, char_class(char))
        if kind == "blank":
            return ("S",), 0
        if char == "'":
            return ("A", ""), 0
        state, added = self.machine.word(self.machine.start, char, self.signs)
        if kind == "number":
            return ("S",), added + state[3]
        return (kind, state), added

    def finish(self, state) -> int:
        """Tokens that the end of the text adds."""
        if state[0] == "S":
            return 0
        if state[0] == "A":  # the apostrophe is a word of signs, what follows one of letters
            added = self.word("'")
            return added + (self.word(state[1]) if state[1] else 0)
        return state[1][3]

    @functools.lru_cache(maxsize=64)  # noqa: B019
    def word(self, text: str) -> int:
        state, total = self.machine.start, 0
        for c in text:
            state, n = self.machine.word(state, c, self.signs)
            total += n
        return total + state[3]

    def move(self, state, char: str):
        """(state, tokens added) of a transition."""
        kind = self.kinds.get(char) or self.kinds.setdefault(char, char_class(char))
        mode = state[0]
        if mode == "S":
            return self.begin(char)
        if mode == "A":
            seen = state[1] + char
            if seen in _CONTRACTIONS:
                return ("S",), self.word("'" + seen)
            if any(c.startswith(seen) for c in _CONTRACTIONS):
                return ("A", seen), 0
            if not state[1] and kind == "other":
                inner, a = self.machine.word(self.machine.start, "'", self.signs)
                inner, b = self.machine.word(inner, char, self.signs)
                return ("other", inner), a + b
            if state[1] and kind == "letter":
                added, inner = self.word("'"), self.machine.start
                for c in seen:
                    inner, n = self.machine.word(inner, c, self.signs)
                    added += n
                return ("letter", inner), added
            new, added = self.begin(char)
            return new, added + self.finish(state)
        if kind == mode:
            inner, added = self.machine.word(state[1], char, self.signs)
            return (mode, inner), added
        new, added = self.begin(char)
        return new, added + state[1][3]

    def compile(self, state: int, char: str) -> int:
        new, added = self.move(self.states[state], char)
        if not -64 <= added < 192:
            raise OverflowError(added)
        return self.number(new) << 8 | added + 64

    def advance(self, states: np.ndarray, columns: np.ndarray, codes) -> np.ndarray:
        """Packed (state, tokens + 64) after one symbol of each lane; ``codes()`` gives the lanes' code points."""
        at = states * COLUMNS + columns
        got = self.table[at]
        if got.min(initial=0) < 0:
            open_ = np.flatnonzero(got < 0)
            points, done = codes()[open_].tolist(), {}
            for lane, s, c, k in zip(open_.tolist(), states[open_].tolist(), columns[open_].tolist(), points, strict=True):
                key = (s, k)
                v = done.get(key)
                if v is None and c == COLUMNS - 1:
                    v = self.rare.get(key)
                if v is None:
                    v = self.compile(s, chr(k))
                    if c == COLUMNS - 1:
                        self.rare[key] = v
                    else:
                        self.table[s * COLUMNS + c] = v
                done[key] = v
                got[lane] = v
        return got

    def run(self, codes: np.ndarray, columns: np.ndarray, added: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Run lanes over [begin, end) side by side, write tokens added at each place; returns the end states."""
        order = np.argsort(begin - end, kind="stable")
        begin, size, states = begin[order], (end - begin)[order], states[order].astype(np.int64)
        live = size.size
        for k in range(int(size[0]) if size.size else 0):
            while size[live - 1] <= k:
                live -= 1
            at = begin[:live] + k
            got = self.advance(states[:live], columns[at], lambda at=at: codes[at])
            added[at] = (got & 255) - 64
            states[:live] = got >> 8
            if len(self.states) > MOST_STATES:  # also within one long word: forget all but where the lanes stand
                states = self.renewed(states)
        out = np.empty_like(states)
        out[order] = states
        return out

    def scan(self, codes: np.ndarray) -> np.ndarray:
        """Tokens added at each code point of a text that begins between words."""
        added = np.zeros(codes.size, np.int16)
        columns = self.columns(codes).astype(np.int64)
        begins = np.arange(0, codes.size, CHUNK)
        ends = np.minimum(begins + CHUNK, codes.size)
        blank = np.flatnonzero((codes == 32) | (codes == 10))
        first = np.searchsorted(blank, begins)
        cut = np.where(first < blank.size, blank[np.minimum(first, max(blank.size - 1, 0))] if blank.size else ends, ends)
        whole = cut >= ends  # no blank: the map isn't constant
        heads = np.minimum(cut + 1, ends)
        both = np.zeros(2 * begins.size, np.int64)  # states behind and before each chunk, in one array that outlives renewals
        after, start = both[: begins.size], both[begins.size :]
        self.held = both
        live = np.flatnonzero(~whole)
        after[live] = self.run(codes, columns, added, heads[live], ends[live], np.zeros(live.size, np.int64))
        lead = 1 + np.flatnonzero(whole[:-1])  # what stands before is open: start from where a short lead ends
        start[1:] = after[:-1]
        if lead.size:
            spare = np.zeros_like(added)
            start[lead] = self.run(codes, columns, spare, begins[lead] - LEAD, begins[lead], np.zeros(lead.size, np.int64))
        todo = np.arange(begins.size)
        while todo.size:
            got = self.run(codes, columns, added, begins[todo], heads[todo], start[todo])
            after[todo[whole[todo]]] = got[whole[todo]]
            behind = composed(np.where(whole, start, ANY), after)
            before = np.where(behind[:-1] == NONE, after[:-1], behind[:-1])
            todo = 1 + np.flatnonzero(start[1:] != before)
            start[todo] = before[todo - 1]
        self.held = np.zeros(0, np.int64)
        return added


@functools.lru_cache(maxsize=2)
def compiled(vocabulary: str | None = None):
    """(transducer, pattern of special strings) of a vocabulary file."""
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        data = json.load(f)
    special = [t["content"] for t in data["added_tokens"]]
    return Transducer(WordMachine(data["model"])), re.compile("|".join(map(re.escape, special)) or r"(?!)")


def lowered(text: str) -> str:
    """NFC, then lower case character by character."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def counts(texts: list[str], vocabulary: str | None = None) -> list[int]:
    """Tokens of each whole text."""
    machine, special = compiled(vocabulary)
    if len(machine.states) > MOST_STATES:
        machine.clear()
    extra, parts = [], []
    for t in texts:
        n = 0
        if "<|" in t:
            n = len(special.findall(t))
            t = "\n".join(map(lowered, special.split(t)))
        else:
            t = lowered(t)
        extra.append(n)
        parts.append(t)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1  # a line end stands behind each text
    codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    added = machine.scan(codes).astype(np.int64)
    return (np.add.reduceat(added, np.cumsum(sizes) - sizes) + np.array(extra)).tolist() if parts else []


FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def count_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""

    def run(batches):
        for b in sliced(batches, 4 << 20):
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = counts(texts, vocabulary)
            yield record_batch(FIELDS, [b.column(0), [len(t.encode()) for t in texts], n, [x > limit for x in n]])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op8_tokens": op8_tokens}
