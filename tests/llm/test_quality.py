"""Factorisation machine: held-out accuracy, the linear-time identity, odd inputs."""

import math
import zlib

import numpy as np
import pytest

from phrasemill.llm import quality
from phrasemill.llm import queries as Q
from phrasemill.llm import tables as T


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    m = quality.Model(50, 0.3, rng.normal(size=53), rng.normal(size=(53, 4)), np.zeros(3), np.ones(3))
    idx, val, dense = np.array([3, 17, 40, 5]), rng.random(4), rng.random((2, 3))
    got = quality._margin(m, np.array([0, 3, 4]), idx, val, dense)[0]
    for row, (lo, hi) in enumerate([(0, 3), (3, 4)]):
        x = dict(zip(idx[lo:hi].tolist(), val[lo:hi], strict=True)) | {50 + j: dense[row, j] for j in range(3)}
        want = m.bias + sum(m.w[i] * v for i, v in x.items()) + sum(
            m.v[i] @ m.v[j] * x[i] * x[j] for i in x for j in x if i < j)
        assert math.isclose(got[row], want, rel_tol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op9_quality(spark, sf).collect()}
    assert len(rows) == T.read(spark, sf, "documents").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(rows[x.doc_id], x.quality) for x in T.read(spark, sf, "labels").collect() if rows[x.doc_id].held_out]
    good, bad = [r.score for r, q in held if q == 1], [r.score for r, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == q for r, q in held]) > 0.9


def test_labels_and_source_are_no_inputs(spark, sf_dir):
    from pyspark.sql import functions as F
    docs = T.read(spark, sf_dir, "documents")
    m = Q.quality_model(spark, sf_dir)
    a = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), m).collect()}
    assert a == b


def test_odd_inputs(spark, nasty, sf_dir):
    m = Q.quality_model(spark, sf_dir)
    got = quality.score(nasty, m, metadata=("n_lines",)).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 for r in got)
    clash = nasty.withColumnRenamed("lang", "score")
    assert quality.score(clash, m, metadata=("n_lines",)).columns[-1] == "score_1"
    same = [r.score for r in got if r.doc_id == 9 and r.text.startswith("other")]
    assert same[0] == same[1]


def test_no_labels_and_one_class(spark, nasty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (5, 1), (None, 0), (77, None)], "doc_id long, quality int")
    for labels, low, high in ((none, 0.49, 0.51), (one, 0.7, 1)):
        m = quality.train(nasty, labels, "quality", metadata=("n_lines",))
        assert all(low <= r.score <= high for r in quality.score(nasty, m, metadata=("n_lines",)).collect())


def test_empty(no_docs, spark, sf_dir):
    assert quality.score(no_docs, Q.quality_model(spark, sf_dir)).count() == 0


@pytest.mark.parametrize("max_train", [50])
def test_bound(spark, sf_dir, max_train, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, dims, **how: seen.append(len(rows)) or quality.Model(dims))
    docs, labels = T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "labels")
    quality.train(docs, labels, "quality", max_train=max_train)
    assert 0 < seen[0] <= max_train


def test_one_document_per_label(spark, monkeypatch):
    """A labelled id that many rows share brings one of them; repeated labels count once."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, dims, **how: seen.append(rows) or quality.Model(dims))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, None), (2, "other"), (3, "third"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    for _ in range(2):
        quality.train(docs.repartition(3), labels, "quality", metadata=())
    assert [sorted(r[0] for r in rows) for rows in seen] == [[0, 0, 1, 1]] * 2
    assert all(np.array_equal(a[1], b[1]) for a, b in zip(*seen, strict=True))
