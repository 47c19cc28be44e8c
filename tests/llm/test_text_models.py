"""Personal data, toxicity and languages: brute force, fuzzing, held-out accuracy and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import language, pii, toxicity

from .conftest import prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@pytest.mark.parametrize("alphabet", ["a1.@ +-()0%_Z25", "0123456789 -.", "a@.b", "é@a.b+1 ("])
def test_base_spans_against_the_stated_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(70)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_of_long_runs_are_fast():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 60_000, "@a" * 50_000):
        pii.base_spans(text)


def test_disclosing_terms(spark):
    """A rare word that stands beside one address is flagged wherever it stands; common words and copies are not."""
    rows = [(i, f"{prose(i, 20)} zorblatt wrote from secret@corp.example.com and {prose(100 + i, 20)}", None) for i in range(5)]
    rows += [(10 + i, f"{prose(200 + i, 40)} and so on", None) for i in range(30)]
    rows += [(1000 + i, prose(5000 + i, 60), None) for i in range(200)]
    rows += [(50, f"{prose(900, 30)} zorblatt {prose(901, 30)}", None)]
    copied = f"{prose(77, 10)} onlyhere wrote to other@corp.example.com and left"
    rows += [(60 + i, copied, None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    flagged = {r.term for r in pii.disclosing(docs.select("doc_id", "text")).collect()}
    assert "zorblatt" in flagged and "onlyhere" not in flagged and "and" not in flagged
    found = {r.doc_id: r for r in pii.report(pii.spans(docs.select("doc_id", "text"), pii.disclosing(docs.select("doc_id", "text")))).collect()}
    assert found[50].n_term == 1 and found[50].n_email == 0 and re.fullmatch(r"term:\d+:\d+", found[50].spans)
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert len(clean) == len(rows) and "zorblatt" not in clean[50].text and "[EMAIL]" in clean[0].text and "secret" not in clean[0].text
    assert clean[10].text == rows[5][1] and clean[0].n_chars == len(clean[0].text)


def test_shares_by_brute_force(spark):
    """Every occurrence of a term within WINDOW words of an entity's mentions counts once for the entity, however long the words."""
    rng, rows = random.Random(21), []
    long_ = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(4)]
    words = ["zorblatt", "and", "the", "quux", *long_]
    for i in range(60):
        mentions = ["secret@corp.example.com", "other@corp.example.com", "1.2.3.4"]
        rows.append((i, " ".join(rng.choice(mentions) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(40)))))
    want, contexts = Counter(), {}
    for _, text in rows:
        near = set()
        for start, kind, end in plain_spans(text):
            entity = f"{pii.KINDS[kind]}:{text[start:end]}"
            left = [m for m in re.finditer(r"\w{3,}", text) if m.end() <= start][-pii.WINDOW :]
            right = [m for m in re.finditer(r"\w{3,}", text) if m.start() >= end][: pii.WINDOW]
            near |= {(entity, m.group().lower(), m.start()) for m in left + right}
            for m in left + right:
                contexts.setdefault((entity, m.group().lower()), set()).add(tuple(x.group().lower() for x in left + right))
        want.update((e, w) for e, w, _ in near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.contexts(docs).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.collect_set("context").alias("contexts")).collect()
    assert {(r.entity, r.term): r.n for r in found} == want
    assert {(r.entity, r.term): len(r.contexts) for r in found} == {k: len(v) for k, v in contexts.items()}
    every = Counter(w for _, t in rows for w in re.findall(r"\w{3,}", t))
    assert all(n <= every[w] for (_, w), n in want.items())
    for r in pii.disclosing(docs).collect():
        assert abs(r.p - max(n / every[w] for (_, w), n in want.items() if w == r.term)) < 1e-12


def test_many_hits_in_one_row(spark):
    """A row with many disclosing terms is rewritten whole; the row itself travels once."""
    terms = [f"zorb{i:02d}x" for i in range(40)]
    rows = [(i, " ".join(f"{prose(50 * i + j, 7)} {t} secret{j}@corp.example.com" for j, t in enumerate(terms))) for i in range(4)]
    rows += [(100 + i, prose(7000 + i, 400)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert len(clean) == 64 and not any(t in clean[0] for t in terms) and clean[100] == rows[4][1]


def test_pii_of_odd_rows(odd, none):
    docs = odd.select("doc_id", "text")
    found = pii.report(pii.spans(docs, pii.disclosing(docs))).collect()
    assert len(found) == 11
    for r in found:
        if r.doc_id == 1:
            assert (r.n_email, r.n_phone, r.spans) == (1, 1, "email:6:13,phone:26:43")
        elif r.doc_id is not None:
            assert r.spans == "" and r.n_email + r.n_ip + r.n_card + r.n_phone == 0
    clean = pii.sanitised(odd)
    assert clean.columns == odd.columns and clean.dtypes == odd.dtypes
    assert sorted(str(r.text) for r in clean.where("doc_id > 1").collect()) == sorted(str(r.text) for r in odd.where("doc_id > 1").collect())
    assert {r.text for r in clean.where("doc_id = 1").collect()} == {"Hello [EMAIL] the call is [PHONE]."}
    assert pii.report(pii.spans(none.select("doc_id", "text"), pii.disclosing(none.select("doc_id", "text")))).count() == 0


INSULTS = ("grumbal", "snorkfit", "plodwit")


def _toxic_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(seed * 10_000 + i, 80).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_kernel_tolerates_gaps():
    k = toxicity._kernel(["grumbal", "grum-bal", "grrumbal", "vitolemba"], ["grumbal"])[:, 0]
    assert abs(k[0] - 1) < 1e-5 and k[1] > 0.5 and k[2] > 0.6 and k[3] < 0.2


def test_kernel_by_brute_force():
    """The kernel is the normed sum over common subsequences of three symbols in spans of five, weighted by their gaps."""

    def subsequences(word):
        symbols, out = "^" + word + "$", Counter()
        for i in range(len(symbols)):
            for j in range(i + 1, len(symbols)):
                for k in range(j + 1, len(symbols)):
                    if k - i <= 4:
                        out[symbols[i] + symbols[j] + symbols[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    got = toxicity._kernel(words, words)
    norm = lambda w: toxicity.features([w])[3][0]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = subsequences(a), subsequences(b)
            assert abs(got[i, j] - sum(x[s] * y[s] for s in x) / norm(a) / norm(b)) < 1e-4, (a, b)


def test_toxicity_held_out():
    train, test = _toxic_rows(300, 1), _toxic_rows(200, 2)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    scores = toxicity._scorer(model)([t for t, _ in test])
    hits = [s >= toxicity.THRESHOLD for s in scores]
    assert sum(h == bool(y) for h, (_, y) in zip(hits, test, strict=True)) >= 0.97 * len(test)
    gapped = [t.replace("snorkfit", "snork-fit").replace("grumbal", "g r u m b a l") for t, y in test if y]
    assert sum(s >= toxicity.THRESHOLD for s in toxicity._scorer(model)(gapped)) >= 0.7 * len(gapped)
    assert all(0 <= s <= 1 for s in scores)


def test_toxicity_of_odd_rows(spark, odd, none):
    train = _toxic_rows(120, 3)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(train)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    texts, y, share = toxicity.training_rows(docs, labels, lambda i: i >= 0)
    assert len(texts) == 120 and abs(share - 0.2) < 0.01
    model = toxicity.fit(texts, y, share)
    found = toxicity.classify(odd, model).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert toxicity.classify(none, model).count() == 0
    assert toxicity.fit(["a b"], [1]) is None and {r.score for r in toxicity.classify(odd, None).collect()} == {0.0}


LANGUAGES = {"en": "the of and that with from this have", "de": "der die und nicht mit auf eine sich", "fr": "les des que pour dans avec une sur"}


def _language_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        base = LANGUAGES[lang].split()
        out.append((i, " ".join(rng.choice(base) + rng.choice(("", "", "en", "s")) for _ in range(rng.randrange(5, 60))), lang))
    return out


def test_language_held_out(spark):
    docs = spark.createDataFrame(_language_rows(400, 1), "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = language.fit(docs, where=lambda i: language.crc_mod(i, 5) != 0)
    assert [n for n, _ in model] == sorted(LANGUAGES, key=lambda k: (-sum(1 for i, _, x in _language_rows(400, 1) if x == k and not held(i)), k))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    truth = {i: x for i, _, x in _language_rows(400, 1) if held(i)}
    assert sum(found[i].lang_pred == x for i, x in truth.items()) >= 0.97 * len(truth)


def test_sizes_decide():
    """Clear margins are the plain sizes of zstandard; a text of a few known words is told by the finer measure."""
    import zstandard

    model = [(k, " ".join(random.Random(k).choices(v.split(), k=4000)).encode()) for k, v in LANGUAGES.items()]
    score = language._scorer(model)
    text = "the that with have of and from this " * 9
    blocks = [language.folded(text)[i : i + language.BLOCK] for i in range(0, len(text), language.BLOCK)]
    sizes = {}
    for name, data in model:
        params = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, source_size=language.BLOCK, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[name] = sum(len(coder.compress(b)) for b in blocks)
    assert min(sizes, key=sizes.get) == "en" == score(text)[0]
    assert [score(w)[0] for w in ("nicht auf eine sich", "que pour dans avec", "that with from this")] == ["de", "fr", "en"]
    assert score("zzzz qqqq xxxx")[2] < 0.2 and language.folded("A1b_C") == b"a b c"


def test_letters():
    assert [language.has_letter(t) for t in ("", "²½ Ⅷ 12_", "²a", "日", "_", "é")] == [False, False, True, True, False, True]


def test_language_of_odd_rows(spark, odd, none):
    model = language.fit(spark.createDataFrame(_language_rows(60, 2), "doc_id long, text string, lang string"))
    found = language.identify(odd, model).collect()
    for r in found:
        if r.doc_id in (2, 3, 6, 7):
            assert r.lang_pred == "und" and r.score == 0 and not r.accepted
        else:
            assert r.lang_pred in LANGUAGES and 0 <= r.score <= 1
    kept = language.accepted(odd, model)
    assert kept.dtypes == odd.dtypes and not {2, 3, 6, 7} & {r.doc_id for r in kept.collect()}
    assert language.fit(none) == [] and {r.lang_pred for r in language.identify(odd, []).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
