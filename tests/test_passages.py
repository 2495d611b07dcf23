"""Passages: a hand-made table, properties on whole documents, and time that grows with the document only linearly."""

import time

import pytest
from pyspark.sql import functions as F

from phrasemill.functions import analysis as A
from phrasemill.operators import excerpt as EX
from phrasemill.operators import index as IDX
from phrasemill.operators import search as S
from phrasemill.sources import corpus as C

TEXT = "One short line. The second sentence is longer than that. A third one ends here. Then comes the fourth and last of them."
#       0               16                                        57                    80                                     119

# (match start, term length, min, max) -> passage
TABLE = [
    (20, 6, 10, 60, (16, 57)),       # its own sentence
    (20, 6, 10, 35, (16, 57)),       # no boundary fits the maximum: the first one after the match
    (20, 6, 45, 80, (16, 80)),       # the minimum takes the next sentence along
    (60, 5, 10, 60, (57, 80)),
    (60, 5, 60, 70, (57, 119)),
    (60, 5, 60, 60, (57, 80)),       # too long with the last sentence: the end before it
    (100, 6, 10, 60, (80, 119)),
    (0, 3, 5, 60, (0, 16)),
    (100, 6, 200, 300, (0, 119)),    # no start leaves room for the minimum: the whole document
    (110, 4, 5, 12, (80, 119)),      # a start further back than the maximum is taken as it is
]


def _passages(spark, text, cases):
    df = spark.createDataFrame([(i, text, *c[:4]) for i, c in enumerate(cases)],
                               "i int, content string, s int, q int, mn int, mx int")
    out = {}
    for mn, mx in {(c[2], c[3]) for c in cases}:
        part = df.filter(f"mn = {mn} and mx = {mx}").withColumn("_info", EX.sentence_info(F.col("content")))
        part = part.withColumn("_b", EX._bounds(F.col("_info"))).withColumn("_okb", EX._okb(F.col("_info"), mn))
        p = EX.passage(F.col("s"), F.col("q"), F.col("_b"), F.col("_okb"), F.transform("_okb", lambda x: x["b"]),
                       F.length("content"), mn, mx)
        out |= {r.i: (r.p.start, r.p.end) for r in part.select("i", p.alias("p")).collect()}
    return [out[i] for i in range(len(cases))]


def test_table(spark):
    assert _passages(spark, TEXT, TABLE) == [c[4] for c in TABLE]


@pytest.mark.parametrize("pick", ["first", "last"])
def test_properties(spark, sf_dir, pick):
    """The excerpt is part of its document, holds a match, and starts and ends where sentences do."""
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    docs = IDX.build_docs(good, []).cache()
    terms = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, sizes=(1, 2), whole=False, only_at=3))
    hits = S.ranked_hits(docs, terms, limit=40).join(terms.select("term_no", "term", "n_toks", "q"), "term_no")
    ex = EX.excerpts(docs, hits, 60, 180, pick)
    rows = ex.join(docs.select("line_no", "content", A.sentence_boundaries(F.col("content")).alias("b")), "line_no").collect()
    assert len(rows) > 200
    for r in rows:
        assert r.content[r.ex_start:r.ex_end] == r.excerpt
        first = r.term.replace("-", " ").replace(".", "").split(" ")[0]
        assert first in r.excerpt
        b = set(r.b)
        assert r.ex_end in b and (r.ex_start in b or r.ex_start - 2 in b)


def test_time_is_linear_in_the_document(spark):
    def seconds(n):
        text = "The start. " + "Some quiet words and then a bell rang twice over the bay. " * n
        good = spark.createDataFrame([(1, "T 1", text, 1.0)], "line_no long, title string, content string, base_score double")
        docs = IDX.build_docs(good, []).cache()
        terms = S.normalize_terms(spark.createDataFrame([(1, "bell")], "term_no long, term string"))
        hits = S.ranked_hits(docs, terms, limit=5).join(terms.select("term_no", "term", "n_toks", "q"), "term_no").cache()
        assert hits.first().tf == n
        begin = time.time()
        assert EX.excerpts(docs, hits, pick="last").count() == 1
        EX.excerpts(docs, hits, pick="last").collect()
        return time.time() - begin

    seconds(500)
    small, large = seconds(2000), seconds(16000)
    assert large < 12 * small + 3, (small, large)
