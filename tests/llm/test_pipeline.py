"""Each stage of the pipeline on its predecessor's output, against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from triplane.llm import qda, queries
from triplane.llm.common import cut

from .test_operators import brute_components, brute_dedup, shingle_set


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = queries.table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(spark, sf_dir, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    scored = {r.doc_id: r.predicted for r in qda.classify(before, queries.table(spark, sf_dir, "labels")).collect()}
    kept = {k for k, _ in pairs(after)}
    assert kept == {k for k, p in scored.items() if p}
    assert np.mean([(k in kept) == bool(q) for k, q in labels.items()]) > 0.95


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    assert sorted(k for k, _ in pairs(after)) == sorted(k for k, _, c in brute_components(pairs(before), 80, 100, 5) if k == c)


def test_passages_cut(stages):
    _, before, after = stages[2]
    want = brute_dedup(pairs(before), 100)
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        assert r.n_chars == len(r.text)
        if "�" not in r.text and want[r.doc_id][0] - want[r.doc_id][1] == len(r.text.encode()):
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]


def test_leaks_dropped(spark, sf_dir, stages):
    _, before, after = stages[3]
    items = [shingle_set(r.text, 5) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    clean = [k for k, t in pairs(before) if not any(a and len(a & shingle_set(t, 5)) >= 0.8 * len(a) for a in items)]
    assert sorted(k for k, _ in pairs(after)) == sorted(clean)


def test_rates(spark, sf_dir, stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(k for k, _ in pairs(before)) and after.columns[: len(before.columns)] == before.columns
    assert all(r.rate >= 0 for r in rows)
    totals = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in rows], axis=0)
    first = np.sum([r.n_tokens * np.array(r.posterior) for r in rows], axis=0)
    wanted = np.array([corpus_pipeline.TARGETS[k] for k in sorted(corpus_pipeline.TARGETS)]) * sum(r.n_tokens for r in rows)
    assert np.abs(first - wanted).max() > 0.02 * wanted.sum()  # there is something to do
    assert np.abs(totals - wanted).max() < 0.7 * np.abs(first - wanted).max()  # 200 documents have few labels: no posterior is sure


def test_rates_reach_the_targets(spark):
    """With the labels of more documents the classifier tells domains apart, and the stage meets its targets."""
    sf_dir = "/root/testdata/sf0.1"
    docs = queries.table(spark, sf_dir, "documents")
    rows = corpus_pipeline.mix_to_targets(spark, docs, sf_dir).select(*docs.columns, "n_tokens", "domain", "posterior", "rate").collect()
    totals = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in rows], axis=0)
    assert totals / totals.sum() == pytest.approx([0.98, 0.02], rel=5e-3)
    labels = {r.doc_id: r.domain for r in queries.label_domains(queries.table(spark, sf_dir, "labels")).collect()}
    assert np.mean([r.domain == "toxic" for r in rows if labels.get(r.doc_id) == "toxic"]) >= 0.8
    assert np.mean([r.rate for r in rows if r.domain == "toxic"]) < 0.5 < 1 <= np.mean([r.rate for r in rows if r.domain == "clean"])


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1][2].count()
