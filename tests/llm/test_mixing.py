"""Mixing and the pipeline's stages."""

import numpy as np
import pytest

from rangeloom.llm import mixing

from .conftest import prose


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, prose(i, 60 + i % 40) if i % 6 else " ".join(["%%% ###"] * 40) + prose(i, 20), "en", f"src{i % 3}", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 240, 2)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_rates_meet_the_targets(corpus):
    docs, labels = corpus
    found = mixing.mix(docs, labels).toPandas()
    total = found.n_tokens.sum()
    shares = [(found[f"p_{d}"] * found.n_tokens * found.rate).sum() / total for d in mixing.DOMAINS]
    assert np.allclose(shares, mixing.TARGETS, atol=1e-4) and (found.rate >= 0).all()
    assert np.allclose(found[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1), 1)
    held = found[found.doc_id % 2 == 1]
    assert (held.p_good > 0.5).all() and (found[found.doc_id % 12 == 6].p_low > 0.5).mean() > 0.9
    assert (found.copies - found.rate).abs().max() < 1


def test_projection_against_brute_force(spark):
    """With a binding bound the steps reach the least-squares residual that a plain projected gradient finds."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet((0.3, 0.3), 200)
    t = rng.integers(1, 500, 200)
    rows = [(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(t, p, strict=True))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_good double, p_low double")
    target = (0.999, 0.001)
    r = mixing._rates(p, mixing.solve(members, target))
    got = (t * r) @ p / t.sum()
    plain = np.ones(200)
    for _ in range(20_000):
        gap = (t * plain) @ p / t.sum() - np.array(target)
        plain = np.maximum(0, plain - 0.5 * p @ gap)
    assert np.abs(got - target).max() <= np.abs((t * plain) @ p / t.sum() - target).max() + 1e-3


def test_stage_repeats_rows_as_rated(corpus):
    docs, labels = corpus
    want = {r.doc_id: r.copies for r in mixing.mix(docs, labels).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed(docs, labels).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v} and mixing.mixed(docs, labels).columns == docs.columns


def test_odd_rows(spark, odd, none, corpus):
    labels = corpus[1]
    assert mixing.mix(odd, labels).count() == 11 and mixing.mix(none, labels).count() == 0
    unlabelled = mixing.mix(odd, labels.limit(0)).collect()
    assert {r.rate for r in unlabelled} == {1.0} and {r.p_good for r in unlabelled} == {0.5}
    assert mixing.mixed(odd, labels.limit(0)).count() == 11 and mixing.mixed(odd, labels).dtypes == odd.dtypes


def test_pipeline(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(i, 80), "en", "s", 1) for i in range(60)] + [(100 + i, prose(i, 80), "en", "s", 1) for i in range(10)] + [(200, "123", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "personal_data", "mixing", "packing"]
    now = docs
    sizes = []
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[:3] == [70, 60, 60]
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(range(60)) and out.count() > 0
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
