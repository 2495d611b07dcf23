"""Mask, sentence boundaries, offsets, excerpts and a full batch run."""

import pytest
from pyspark.sql import functions as F

from fixtures import TEST_CORPUS
from phrasemill.functions import analysis as A
from phrasemill.operators import excerpt as EX
from phrasemill.operators import index as IDX
from phrasemill.operators import search as S
from phrasemill.plans import batch as B
from phrasemill.sources import corpus as C

MASK_CASES = [
    ("came that morning. Otters swam by", "came that morning. swam by"),
    ('all day.  "Rain fell', 'all day.  "fell'),
    ("Mr. Hollis stood", "Mr. Hollis stood"),
    ("from Malacca. Later it", "from Malacca. Later it"),
    ('wrote "No" then "Draft" and', 'wrote "No" then "" and'),
    (". Stop. Next one", ".  Next one"),
    ("the end! Hello", "the end! "),
    ("x. A dog", "x. A dog"),
    ("U.S.A. Army went; U.S. Army", "U.S.A. Army went; U.S. Army"),
]

BOUNDARY_CASES = [
    ("One two.  Three four; five! six? Seven.", ["One two.  ", "Three four; five! ", "six? ", "Seven."]),
    ('We met Mr. Hollis. then left. "Quick reply." End', ["We met Mr. ", "Hollis. then left. ", '"Quick reply." ', "End"]),
    ('Say "Hi!" he said. (Yes.) Ok... Fine', ['Say "Hi!" ', "he said. ", "(Yes.) ", "Ok... ", "Fine"]),
    ("what? lower! lower. lower", ["what? ", "lower! ", "lower. lower"]),
    ("Hi., there. 5 dogs", ["Hi., there. 5 dogs"]),
    ("x.Y z", ["x.Y z"]),
    ("Foo.\n\nbar.\tBaz", ["Foo.\n\n", "bar.\t", "Baz"]),
]


def test_mask(spark):
    df = spark.createDataFrame(MASK_CASES, "src string, want string")
    for r in df.select("want", A.mask_sentence_starts(F.col("src")).alias("got")).collect():
        assert r.got == r.want


def test_sentence_boundaries(spark):
    df = spark.createDataFrame([(t,) for t, _ in BOUNDARY_CASES], "t string")
    got = [r.b for r in df.select(A.sentence_boundaries(F.col("t")).alias("b")).collect()]
    for (text, pieces), b in zip(BOUNDARY_CASES, got):
        cuts = [text[i:j] for i, j in zip(b, b[1:])]
        assert cuts == pieces, (text, b)


def test_offsets_point_at_tokens(spark):
    texts = ["nobody came to the pier that morning. Otters swam while other Otters slept on the warm stones of the quay",
             "Mr. Hollis and Dr. Who. Next one! Again: Words here; U.S.A. and e.g. it's AT&T 1,000.50 www.a.com."]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    df = A.with_tokens(df).withColumn("_mk", A.mask_marked(F.col("content"))).withColumn("_m", A.unmark(F.col("_mk")))
    rows = df.select("content", "toks", A.original_token_starts(F.col("_mk"), F.col("_m")).alias("o")).collect()
    for r in rows:
        for i, (tok, off) in enumerate(zip(r.toks, r.o)):
            if i == 0 or tok in ("", "\u0001"):
                continue
            assert r.content[off:off + len(tok)] == tok or tok.endswith(("s", "S")), (tok, off)


@pytest.fixture(scope="module")
def docs(spark):
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    d, _ = B.build_index(lines)
    return d.cache()


def test_excerpt_contains_match(spark, docs):
    terms = S.normalize_terms(spark.createDataFrame([(1, "lighthouse"), (2, "Otters"), (3, "pier")],
                                                    "term_no long, term string"))
    hits = S.ranked_hits(docs, terms, limit=20).join(terms.select("term_no", "term", "n_toks", "q"), "term_no")
    for pick in ("last", "first"):
        rows = EX.excerpts(docs, hits, pick=pick).join(docs.select("line_no", "content"), "line_no").collect()
        assert rows
        for r in rows:
            assert r.content[r.ex_start:r.ex_end] == r.excerpt
            assert r.term in r.excerpt


def test_run_batch_limits(spark, docs):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["the", "old", "lighthouse", "motion", "pier"])],
                                  "term_no long, term string")
    cfg = B.SearchConfig(result_limit=3, source_cap=2, highlight_min=10, highlight_max=400)
    res = B.run_batch(docs, terms, cfg).collect()
    assert res
    per_term, per_src = {}, {}
    for r in res:
        per_term[r.term_no] = per_term.get(r.term_no, 0) + 1
        per_src[r.docid] = per_src.get(r.docid, 0) + 1
    assert max(per_term.values()) <= 3
    assert max(per_src.values()) <= 2


def test_offsets_of_whole_documents(spark, sf_dir):
    """Every token of the table stands where its offset says (possessives and the blanked first token aside)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("content"))
    df = A.with_tokens(docs).withColumn("_mk", A.mask_marked(F.col("content"))).withColumn("_m", A.unmark(F.col("_mk")))
    rows = df.select("content", "toks", A.original_token_starts(F.col("_mk"), F.col("_m")).alias("o"),
                     (A.mask_sentence_starts(F.col("content")) == F.col("_m")).alias("same_mask")).collect()
    assert rows and all(r.same_mask for r in rows)
    for r in rows:
        assert len(r.o) == len(r.toks) and list(r.o) == sorted(r.o)
        assert all(r.content.startswith(t, o) for t, o in zip(r.toks, r.o) if t not in ("", "\u0001"))


def test_excerpts_same_without_broadcast(spark, docs):
    terms = S.normalize_terms(spark.createDataFrame([(1, "lighthouse"), (2, "the old"), (3, "pier")],
                                                    "term_no long, term string"))
    hits = S.ranked_hits(docs, terms, limit=20).join(terms.select("term_no", "term", "n_toks", "q"), "term_no")
    key = lambda r: (r.term_no, r.line_no, r.ex_start, r.ex_end, r.excerpt)
    a = sorted(map(key, EX.excerpts(docs, hits).collect()))
    b = sorted(map(key, EX.excerpts(docs, hits, max_broadcast_bytes=0).collect()))
    assert a == b and a


def test_hot_document_chunks(spark, docs, monkeypatch):
    terms = S.normalize_terms(spark.createDataFrame([(i, t) for i, t in enumerate(
        ["the", "old", "ferry", "a", "on", "of", "the old", "on the", "at", "pump"])],
        "term_no long, term string"))
    hits = S.ranked_hits(docs, terms, limit=20).join(terms.select("term_no", "term", "n_toks", "q"), "term_no")
    key = lambda r: (r.term_no, r.line_no, r.ex_start, r.ex_end, r.excerpt)
    a = sorted(map(key, EX.excerpts(docs, hits).collect()))
    monkeypatch.setattr(EX, "MAX_HITS_PER_GROUP", 2)
    b = sorted(map(key, EX.excerpts(docs, hits).collect()))
    assert a == b and len(a) > 20
