"""Tokenizers: the compiled transducer and the fast ranks against the library, packing as an exact cover."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rangeloom.llm import packing, tokens, transducer

HARD = [
    "", "it's'so ''s !'re 'rx 'r 'v' I'LL we'd'", "<|endoftext|>a<|startoftext|> b", "x" * 3000, "abc" * 900 + " q", "a1b22c³ ½", "Ça É é ΑΣ ΣΑΣ İ",
    "​\u0085 x y\x1cz\x1f", "日本語テスト 한국어 😀😀🏳️‍🌈", "'s", "'", "''", "'re", "'r e", "!!!???...", "#" * 700, "O'Neil's a'", "l'l'll", "\n\n", "</w> <w>", "'ve'v'l'x1'2",
]


def _random(n, alphabet, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_transducer_counts_as_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = HARD + _random(1500, "abcdeths'  rvlm.1é\n") + _random(300, ["the ", "tion", "ing", "'s", "ß", "!", "日", " "])
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert transducer.counts(texts) == want
    assert [transducer.counts([t])[0] for t in texts[:200]] == want[:200]


@pytest.mark.parametrize("block", range(0, 0x3000, 0x800))
def test_character_classes(block):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a{chr(c)}b'{chr(c)} 1{chr(c)}" for c in range(max(block, 1), block + 0x800)]
    assert transducer.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rare_symbols_and_full_tables(monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = transducer.compiled(None)[0].machine
    monkeypatch.setattr(transducer, "COLUMNS", 8)
    machine = transducer.Transducer(words)
    for t in _random(60, "abcdefghijklmnop é日'1!"):
        codes = np.frombuffer((transducer.lowered(t) + "\n").encode("utf-32-le"), np.uint32)
        assert int(machine.scan(codes).sum()) == len(library.encode(t, add_special_tokens=False).ids)


def test_long_words_forget_states(monkeypatch):
    """Words of many thousand letters count as in the library while the table of states is renewed again and again."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(transducer, "MOST_STATES", 300)
    machine = transducer.Transducer(transducer.compiled(None)[0].machine)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (700, 3000)] + [" ".join("".join(rng.choice("etaoin") for _ in range(900)) for _ in range(4))]
    codes = [np.frombuffer((t + "\n").encode("utf-32-le"), np.uint32) for t in texts]
    got = [int(machine.scan(c).sum()) for c in codes]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    added = machine.scan(np.concatenate(codes))
    assert np.add.reduceat(added.astype(int), np.cumsum([0] + [c.size for c in codes[:-1]])).tolist() == got
    assert len(machine.states) < 2000


def test_prefix_scan_composes_chunk_maps(monkeypatch):
    """Start states by the scan are those of running the chunks one after the other, also where no short lead finds them."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 201):
        for known in (0.0, 0.7, 0.97, 1.0):
            after, start = rng.integers(0, 3, n), np.zeros(n, np.int64)
            start[1:] = np.where(rng.random(n - 1) < known, after[:-1], 3)
            first = np.where(rng.random(n) < 0.1, transducer.ANY, start)
            state, want = int(start[0]), []
            for f, e in zip(first.tolist(), after.tolist(), strict=True):
                state = e if f in (transducer.ANY, state) else transducer.NONE
                want.append(state)
            assert transducer.composed(first, after).tolist() == want
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(random.Random(k).choice(alphabet) for _ in range(n)) for k, (n, alphabet) in enumerate([(4000, "etaoinshr"), (3000, "a"), (2500, "'sv1!"), (2000, "日本a")])]
    for lead in (0, 1, 48):
        monkeypatch.setattr(transducer, "LEAD", lead)
        for chunk in (64, 512):
            monkeypatch.setattr(transducer, "CHUNK", chunk)
            assert transducer.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_fast_ids_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    encode = tokens.encoder()
    texts = HARD + [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x250)] + _random(800, " \n\tabcS'tréß.1!<|endoftext|>")
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_counts_of_odd_rows(odd, none):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text or "" for r in odd.collect()]
    found = transducer.count_tokens(odd).collect()
    assert sorted(r.n_tokens for r in found) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(r.n_bytes for r in found) == sorted(len(t.encode()) for t in texts)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    assert transducer.count_tokens(none).count() == 0


def _layout(pieces, sizes):
    """Checks an exact cover; returns the tokens of each sequence."""
    cover, sequences = defaultdict(list), defaultdict(list)
    for d, start, length, q, offset in pieces:
        cover[d].append((start, length))
        sequences[q].append((offset, length))
    for parts, whole in [(cover[d], n) for d, n in sizes.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
        assert at == whole if whole is not None else at <= 2048
    return {q: sum(n for _, n in s) for q, s in sequences.items()}


@pytest.mark.parametrize(("n", "blocks"), [(1, 2), (20, 1), (300, 3), (3000, 1)])
def test_packer_covers_exactly(n, blocks):
    rng = np.random.default_rng(n)
    packer, pieces, sizes = packing.Packer(5), [], {}
    for b in range(blocks):
        size = rng.integers(1, 6000, n)
        size[: n // 3] = 1500  # a hot length
        pieces += [((b, d), *rest) for d, *rest in zip(*(x.tolist() for x in packer.block(size)), strict=True)]
        sizes |= {(b, i): int(s) for i, s in enumerate(size)}
    filled = _layout(pieces, sizes)
    assert sum(v < 2048 for v in filled.values()) <= 1
    if n >= 300:
        assert len(pieces) < 2.2 * n * blocks


def test_repeat_counts_fit_the_histogram():
    lengths = np.array([100, 200, 1848, 1948, 1000, 948])
    combos = packing.combinations(np.sort(lengths))
    assert {tuple(sorted(c[c > 0].tolist())) for c in combos} >= {(100, 1948), (200, 1848), (100, 948, 1000)}
    histogram = np.zeros(2049)
    histogram[[100, 1948, 200, 1848]] = (30, 30, 10, 12)
    present = packing.combinations(np.flatnonzero(histogram))
    used = packing.rounded(present, packing.repeat_counts(present, histogram), histogram.astype(np.int64))
    assert used.sum() == 40


def test_pieces_of_odd_rows(odd, none):
    encode = tokens.encoder()
    rows = packing.pack(odd.coalesce(1), with_ids=True).collect()
    whole = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
    for r in odd.where("doc_id > 1").collect():
        ids = np.append(encode(r.text or ""), np.uint32(1)).astype("<u4")
        assert b"".join(x for _, x in sorted(whole[(r.doc_id, len(ids))])) == ids.tobytes()
    filled = defaultdict(int)
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sum(v < 2048 for v in filled.values()) <= 1 and packing.pack(none).count() == 0
