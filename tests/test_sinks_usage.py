"""Results TSV, formatting rules and the usage table feeding the formula."""

import os
import tempfile

from pyspark.sql import functions as F

from fixtures import TEST_CORPUS
from phrasemill.operators import search as S
from phrasemill.plans import batch as B
from phrasemill.sources import sinks


def test_results_tsv(spark):
    res = spark.createDataFrame([("a\tterm", "line one\nline\ttwo\r", "Title\t1")], "term string, excerpt string, title string")
    out = os.path.join(tempfile.mkdtemp(prefix="pm-tsv-"), "out")
    sinks.write_results_tsv(res, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    # the term is written as given; excerpt and title lose tabs and newlines
    assert text == "a\tterm\tline one line two \tTitle 1\n"


def test_format_columns_stop_after(spark):
    df = spark.createDataFrame([("ab 12",), ("ab cd",)], "v string")
    rules = {"v": [("[0-9]+", "#", True), ("a", "A", False)]}
    got = sorted(r.v for r in sinks.format_columns(df, rules).collect())
    assert got == ["Ab cd", "ab #"]


def test_usage_feeds_doc_match_count(spark):
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    docs, _ = B.build_index(lines)
    terms = S.normalize_terms(spark.createDataFrame([(1, "lighthouse")], "term_no long, term string"))
    base = {r.line_no: r.final_score for r in S.ranked_hits(docs, terms, formula="_score / docMatchCount").collect()}
    docid = docs.filter("line_no = 18").first().docid
    usage = spark.createDataFrame([(docid, 3)], "docid long, n long")
    used = {r.line_no: r.final_score for r in S.ranked_hits(docs, terms, formula="_score / docMatchCount",
                                                               usage=usage).collect()}
    assert abs(used[18] - base[18] / 4) < 1e-6          # docMatchCount = 1 + 3
    assert used[19] == base[19]
