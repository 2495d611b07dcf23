"""End-to-end golden hits on the small corpus."""

import pytest
from pyspark.sql import functions as F

from fixtures import GOLDEN, TEST_CORPUS
from phrasemill.operators import index as IDX
from phrasemill.operators import search as S
from phrasemill.sources import corpus as C


@pytest.fixture(scope="module")
def docs(spark):
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    good, rejects = C.split_lines(lines)
    assert rejects.count() == 0
    return IDX.build_docs(good, []).cache()


def test_corpus_facts(docs):
    assert docs.count() == 32
    assert docs.select("title").distinct().count() == 14


@pytest.mark.parametrize("term", sorted(GOLDEN))
def test_golden_hits(spark, docs, term):
    got = [r.line_no for r in S.search_phrase(docs, term).collect()]
    want = GOLDEN[term]
    if term == "lighthouse":
        assert got == want
    else:
        assert sorted(got) == want


def test_batch_matches_single(spark, docs):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(GOLDEN))], "term_no long, term string")
    hits = S.phrase_hits(docs, S.normalize_terms(terms))
    got = {}
    for r in hits.collect():
        got.setdefault(r.term_no, []).append(r.line_no)
    for i, t in enumerate(sorted(GOLDEN)):
        assert sorted(got.get(i, [])) == sorted(GOLDEN[t]), t


def test_shuffle_path_equals_broadcast_path(spark, docs):
    terms = S.normalize_terms(spark.createDataFrame([(i, t) for i, t in enumerate(sorted(GOLDEN))],
                                                    "term_no long, term string"))
    a = {(r.term_no, r.line_no, r.tf) for r in S.phrase_hits(docs, terms).collect()}
    b = {(r.term_no, r.line_no, r.tf) for r in S.phrase_hits(docs, terms, max_broadcast_bytes=0).collect()}
    assert a == b and a


def test_terms_without_tokens_keep_their_row(spark, docs):
    terms = S.normalize_terms(spark.createDataFrame([(1, "-"), (2, " - "), (3, "lighthouse"), (4, "zzz"), (5, "")],
                                                    "term_no long, term string"))
    got = {r.term_no: r.n_hits for r in S.term_summary(terms, S.phrase_hits(docs, terms)).collect()}
    assert got == {1: 0, 2: 0, 3: 5, 4: 0, 5: 0}


def test_acronyms_option(spark):
    good, _ = C.split_lines(spark.createDataFrame([(1, "T 1.txt:they sailed to the U.S.A. by ship")], "line_no long, raw string"))
    index = IDX.build_docs(good, [])
    raw = spark.createDataFrame([(1, "U.S.A."), (2, "the U.S.A. by")], "term_no long, term string")
    assert S.phrase_hits(index, S.normalize_terms(raw)).count() == 0
    assert S.phrase_hits(index, S.normalize_terms(raw, acronyms=True)).count() == 2


def test_usage_rows_do_not_duplicate_hits(spark, docs):
    terms = S.normalize_terms(spark.createDataFrame([(1, "lighthouse")], "term_no long, term string"))
    usage = spark.createDataFrame([(18, 1), (18, 2)], "docid long, n long")
    rows = S.ranked_hits(docs, terms, usage=usage).collect()
    assert len(rows) == 5 and {r.docMatchCount for r in rows if r.docid == 18} == {4.0}


def test_invalid_formula_is_refused_first(spark, docs):
    terms = S.normalize_terms(spark.createDataFrame([(1, "lighthouse")], "term_no long, term string"))
    with pytest.raises(Exception, match="nosuch"):
        S.ranked_hits(docs, terms, formula="nosuch(_score)")
