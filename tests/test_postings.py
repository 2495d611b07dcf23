"""The token-clustered index: same hits as the n-gram search, pruned reads, long terms, frequent tokens."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fixtures import GOLDEN, TEST_CORPUS
from phrasemill.operators import postings as PO
from phrasemill.operators import search as S
from phrasemill.plans import batch as B
from phrasemill.sources import corpus as C
from phrasemill.operators import index as IDX


@pytest.fixture(scope="module")
def index(spark):
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    docs, _ = B.build_index(lines)
    PO.write_index(docs, path, buckets=16, tokens_per_file=20)
    PO.write_index(docs, path, buckets=16, tokens_per_file=20)     # overwrites
    return PO.load_index(spark, path)


def _terms(spark, words):
    return S.normalize_terms(spark.createDataFrame(list(enumerate(words)), "term_no long, term string"))


def test_golden(spark, index):
    words = sorted(GOLDEN)
    got = {}
    for r in PO.phrase_hits(index, _terms(spark, [*words, "-", "zzz", ""])).collect():
        got.setdefault(r.term_no, []).append(r.line_no)
    assert {words[k]: sorted(v) for k, v in got.items()} == {w: sorted(v) for w, v in GOLDEN.items() if v}


@pytest.mark.parametrize("cap", [None, 0])
def test_same_as_ngrams_on_the_table(spark, sf_dir, cap):
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    docs = IDX.build_docs(good, []).cache()
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path)
    terms = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir))
    key = lambda r: (r.term_no, r.line_no, r.tf, tuple(r.starts), r.docid)
    a = {key(r) for r in PO.phrase_hits(PO.load_index(spark, path), terms, cap).collect()}
    b = {key(r) for r in S.phrase_hits(docs, terms, max_broadcast_bytes=cap).collect()}
    assert a == b and len(a) > 1000


def test_one_phrase_reads_its_buckets_only(spark, index):
    hits = PO.phrase_hits(index, _terms(spark, ["spring tide"]))
    assert [r.line_no for r in hits.collect()] == [26]
    near = PO.rows_of(index.postings, _terms(spark, ["spring tide"]).selectExpr("explode(toks) AS token"), index.buckets, None)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_long_term(spark, index):
    words = TEST_CORPUS[24].split(".txt:")[1].split()[1:19]
    long_term = " ".join(w.strip(".,!;") for w in words)
    hits = PO.phrase_hits(index, _terms(spark, [long_term]))
    assert [r.line_no for r in hits.collect()] == [25]
    assert "t17" not in hits._jdf.queryExecution().executedPlan().toString()    # no column per position


def test_offsets(spark, index):
    text = {r.line_no: r.content for r in index.docs.collect()}
    rows = index.postings.collect()
    assert rows and all(text[r.line_no][r.start:r.end] == r.token for r in rows)
    df = {r.token: r.df for r in index.df.collect()}
    assert df["the"] == len({r.line_no for r in rows if r.token == "the"})
    assert index.n_docs == 32


@pytest.fixture(scope="module")
def table_index(spark, sf_dir):
    """The table's documents, and an index of them with small files and row groups."""
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    docs = IDX.build_docs(good, []).cache()
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path, buckets=2, tokens_per_file=6000, row_group_bytes=4096)
    return docs, PO.load_index(spark, path)


def test_frequent_token_lies_in_several_files(spark, index):
    top = index.df.orderBy(F.desc("df")).first()
    files = index.postings.filter(F.col("token") == top["token"]).select("_metadata.file_path").distinct().count()
    assert top["df"] > 20 and files > 1


def test_buckets_follow_the_number_of_tokens(spark, table_index, monkeypatch):
    docs, _ = table_index
    monkeypatch.setattr(PO, "TOKENS_PER_BUCKET", 1000)
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path)
    index = PO.load_index(spark, path)
    n_tokens = docs.agg(F.sum("n_tokens")).first()[0]
    assert index.buckets == -(-n_tokens // 1000) > PO.MIN_BUCKETS


def test_one_phrase_reads_few_row_groups(spark, table_index):
    """The scan tests the tokens themselves; by the files' statistics few row groups can hold them."""
    import pyarrow.parquet as pq
    _, index = table_index
    rare = [r.token for r in index.df.orderBy("df", "token").limit(2).collect()]
    tokens = spark.createDataFrame([(t,) for t in rare], "token string")
    found = PO.rows_of(index.postings, tokens, index.buckets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(ln for ln in plan.splitlines() if "FileScan parquet" in ln)
    assert "PushedFilters" in scan and all(t in scan[scan.index("PushedFilters"):] for t in rare) and "PartitionFilters: [" in scan
    assert {r.token for r in found.collect()} == set(rare)
    groups = hit = 0
    for f in index.postings.select("_metadata.file_path").distinct().collect():
        meta = pq.ParquetFile(f[0].removeprefix("file://").removeprefix("file:")).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("token")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups += 1
            hit += any(s.min <= t <= s.max for t in rare)
    assert groups > 50 and hit < groups / 5, (hit, groups)


def _ranked(df):
    return sorted((r.term_no, r.line_no, r.rank, r.tf, tuple(r.starts), round(r.bm25, 9), r.final_score, r.n_hits) for r in df.collect())


@pytest.mark.parametrize("cap", [None, 0])
def test_ranked_search_is_the_same_on_the_index(spark, sf_dir, table_index, cap):
    docs, index = table_index
    terms = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, only_at=3))
    a = _ranked(S.ranked_hits(docs, terms, limit=5, max_broadcast_bytes=cap))
    b = _ranked(S.ranked_hits(index, terms, limit=5, max_broadcast_bytes=cap))
    assert a == b and len(a) > 10


def test_batch_is_the_same_on_the_index(spark, sf_dir, table_index):
    docs, index = table_index
    terms = C.terms_from_benchmark(spark, sf_dir, sizes=(1, 2), only_at=3)
    cfg = B.SearchConfig(match_limit=4, expand_iterations=1, source_cap=7)
    key = lambda d: sorted(map(tuple, B.run_batch(d, terms, cfg).collect()))
    a = key(docs)
    assert a == key(index) and a


def test_search_on_the_index_reads_no_tokens_of_documents(spark, table_index):
    docs, index = table_index
    phrase = docs.select(F.concat_ws(" ", F.slice("toks", 6, 2)).alias("p")).filter("length(p) > 8").orderBy("p").first()["p"]
    terms = _terms(spark, [phrase])
    for df in (PO.phrase_hits(index, terms), PO.phrase_counts(index, terms), S.term_idf(index, terms, index.n_docs)):
        scans = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in ln]
        assert scans and not [ln for ln in scans if "/docs" in ln or "toks" in ln.split("]")[0]]
    found = S.search_phrase(index, phrase, limit=5)
    scans = [ln for ln in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in ln and "/docs" in ln]
    assert scans and all("line_no" in ln[ln.index("PushedFilters"):] and "toks" not in ln.split("]")[0] for ln in scans)
    a, b = found.collect(), S.search_phrase(docs, phrase, limit=5).collect()
    assert [(r.line_no, r.content, r.starts, r.final_score) for r in a] == [(r.line_no, r.content, r.starts, r.final_score) for r in b] and a
    assert S.search_phrase(index, "no such words here").collect() == [] and S.search_phrase(index, "").collect() == []


@pytest.mark.parametrize("indexed", [False, True])
def test_positions_are_fetched_for_the_ranked_hits_only(spark, sf_dir, table_index, monkeypatch, indexed):
    """What is written of all hits holds no positions; the positions looked up are those of the hits that rank."""
    docs, index = table_index
    written, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: written.append((df.columns, out := cut(df))) or out)
    terms = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, sizes=(1,), whole=False))
    top = S.ranked_hits(index if indexed else docs, terms, limit=2)
    assert not [c for cols, _ in written for c in cols if c in ("starts", "pos", "first")]
    (_, all_hits), (_, kept) = written[0], written[-1]
    assert top.count() == kept.count() < all_hits.count() / 2
    assert all(len(r.starts) == r.tf for r in top.collect())
