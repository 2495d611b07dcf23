"""Term files searched per micro-batch; usage carries across batches."""

import os
import tempfile

from fixtures import TEST_CORPUS
from phrasemill.operators import postings as PO
from phrasemill.operators import scoring as SC
from phrasemill.plans import batch as B
from phrasemill.streaming import search_term_files


def test_term_files_stream(spark):
    root = tempfile.mkdtemp(prefix="pm-stream-")
    terms_dir = os.path.join(root, "terms")
    os.makedirs(terms_dir)
    with open(os.path.join(terms_dir, "a.txt"), "w") as f:
        f.write("lighthouse\npump\n")
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    docs, _ = B.build_index(lines)
    docs = docs.cache()
    cfg = B.SearchConfig(result_limit=2, source_cap=3, highlight_min=10, highlight_max=400,
                         scoring=SC.ExcerptScoring.default(10, 400, first_char=False))
    out = os.path.join(root, "out")
    q = search_term_files(spark, docs, terms_dir, out, os.path.join(root, "ckpt"), cfg)
    q.awaitTermination(300)
    rows = spark.read.option("sep", "\t").csv(os.path.join(out, "epoch=0")).collect()
    assert 1 <= len(rows) <= 4
    usage = spark.read.parquet(os.path.join(out, "_usage", "epoch=0")).collect()
    assert sum(r.n for r in usage) == len(rows)
    assert max(r.n for r in usage) <= 3
    # the same from a stored index
    PO.write_index(docs, os.path.join(root, "index"))
    other = os.path.join(root, "out2")
    search_term_files(spark, PO.load_index(spark, os.path.join(root, "index")), terms_dir, other, os.path.join(root, "ckpt2"), cfg).awaitTermination(300)
    assert sorted(map(tuple, spark.read.option("sep", "\t").csv(os.path.join(other, "epoch=0")).collect())) == sorted(map(tuple, rows))


def test_usage_carries_to_next_batch(spark):
    root = tempfile.mkdtemp(prefix="pm-stream2-")
    terms_dir = os.path.join(root, "terms")
    os.makedirs(terms_dir)
    with open(os.path.join(terms_dir, "a.txt"), "w") as f:
        f.write("the\n")
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    docs, _ = B.build_index(lines)
    docs = docs.cache()
    cfg = B.SearchConfig(result_limit=5, source_cap=4, highlight_min=10, highlight_max=400,
                         scoring=SC.ExcerptScoring.default(10, 400, first_char=False))
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "ckpt")
    search_term_files(spark, docs, terms_dir, out, ckpt, cfg).awaitTermination(300)
    with open(os.path.join(terms_dir, "b.txt"), "w") as f:
        f.write("old\nat\n")
    search_term_files(spark, docs, terms_dir, out, ckpt, cfg).awaitTermination(300)
    u0 = {r.docid: r.n for r in spark.read.parquet(os.path.join(out, "_usage", "epoch=0")).collect()}
    u1 = {r.docid: r.n for r in spark.read.parquet(os.path.join(out, "_usage", "epoch=1")).collect()}
    n1 = len(spark.read.option("sep", "\t").csv(os.path.join(out, "epoch=1")).collect())
    assert sum(u1.values()) == sum(u0.values()) + n1       # usage accumulates
    assert all(u1.get(k, 0) >= v for k, v in u0.items())
    assert max(u1.values()) <= 4                             # the cap holds over both batches


def test_term_numbers_are_dense(spark):
    from phrasemill.streaming.term_files import number_terms
    df = spark.range(1000, numPartitions=200).selectExpr("cast(id as string) AS term")
    a = [r.term_no for r in number_terms(df, 0).collect()]
    b = [r.term_no for r in number_terms(df, 1).collect()]
    assert sorted(a) == list(range(1000)) and min(b) == 1 << 40 and not set(a) & set(b)
