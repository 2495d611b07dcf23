"""What keeps time, memory and disk in proportion to the input."""

import random
import re

from pyspark.sql import functions as F

from phrasemill.functions import patterns as P


def test_look_behind_is_tried_at_periods_only(spark):
    """The mask and the token grammar settle most places by one class, and match as their plain forms do."""
    assert P.MASK_JAVA.startswith('(?=["!?.;:])') and r"\.(?<!" in P.MASK_JAVA and P.TOKEN_RE_JAVA.startswith("(?=[a-z")
    plain = P.MASK_JAVA.removeprefix('(?=["!?.;:])').replace(P._PERIOD, "(?<!" + P._abbrev_alternation(P.ABBREVIATIONS) + r")\.")
    rng = random.Random(5)
    bits = ["Mr", "U.S", "et al", "e.g", ".", ".", " ", "\n", "Word", "other", '"', "'", "!", ";", ":", "A", "x1", "日本", "étui"]
    texts = ["".join(rng.choice(bits) for _ in range(30)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    differ = df.filter(F.regexp_replace("t", P.MASK_JAVA, "<$1$2>") != F.regexp_replace("t", plain, "<$1$2>"))
    assert differ.count() == 0 and plain != P.MASK_JAVA
    assert df.filter(F.regexp_count("t", F.lit(plain)) > 0).count() > 500
    assert not re.match(r"\(\?<!", P.MASK_JAVA)


def test_prefix_sums_of_odd_arrays(spark):
    """Null and empty arrays, in flat Arrow buffers: no pandas object per row."""
    from phrasemill.functions import analysis as A
    rows = [(1, [1, 2, 3]), (2, None), (3, []), (4, [5]), (5, None), (6, [0, 7])]
    df = spark.createDataFrame(rows, "k int, a array<int>").coalesce(1)
    assert A.array_cumsum.evalType != 200     # 200: a pandas UDF
    got = {r.k: r.s for r in df.select("k", A.array_cumsum("a").alias("s")).collect()}
    assert got == {1: [1, 3, 6], 2: None, 3: [], 4: [5], 5: None, 6: [0, 7]}
    text = [(1, "He came. Then rain fell on A town."), (2, ""), (3, "one two"), (4, None)]
    d = spark.createDataFrame(text, "k int, c string").coalesce(1)
    m = A.mask_marked(F.col("c"))
    starts = {r.k: r.s for r in d.select("k", A.original_token_starts(m, A.unmark(m)).alias("s")).collect()}
    assert starts[1] == [0, 3, 14, 19, 24, 27, 29] and starts[2] in ([], None) and starts[3] == [0, 4]


def _docs(spark, rows):
    from phrasemill.operators import index as IDX
    from phrasemill.sources import corpus as C
    good, _ = C.parse_scores(spark.createDataFrame([(k, "", "src1", t) for k, t in rows], "line_no long, raw string, title string, content string"))
    return IDX.build_docs(good, []).cache()


WORDS = "x the of the of a b the of a b the c of"


def _terms(spark, words):
    from phrasemill.operators import search as S
    return S.normalize_terms(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "term_no long, term string"))


def _key(df):
    return sorted((r.term_no, r.line_no, r.tf, tuple(r.starts), r.first_pos) for r in df.collect())


def test_equal_phrases_are_searched_once(spark):
    """Matches are counted within their document; a phrase that is a term many times is joined once."""
    from phrasemill.operators import phrases as PH
    from phrasemill.operators import search as S
    docs = _docs(spark, [(k, WORDS) for k in range(5)])
    terms = _terms(spark, ["the"] * 50 + ["of a", "the-of", "the of", "the of a b the c", "the of a b the a"])
    once, same = PH.distinct_phrases(terms)
    assert once.count() == 5 and same.count() == 55
    hits = S.phrase_hits(docs, terms)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(line_no" in plan and "hashpartitioning(term_no" not in plan
    got = _key(hits)
    assert [r[2:] for r in got if r[:2] == (0, 3)] == [(4, (1, 3, 7, 11), 1)] and len([r for r in got if r[0] < 50]) == 250
    assert [r[2:] for r in got if r[:2] == (53, 3)] == [(1, (7,), 7)] and not [r for r in got if r[0] == 54]
    assert [r[1:] for r in got if r[0] == 51] == [r[1:] for r in got if r[0] == 52]
    # terms that share a number share rows
    twice = S.phrase_hits(docs, terms.filter("term_no = 0").unionByName(terms.filter("term_no = 0")))
    assert {r.tf for r in twice.collect()} == {8}


def test_index_compares_neighbours_where_candidates_are_many(spark):
    import os
    import tempfile
    from phrasemill.operators import postings as PO
    from phrasemill.operators import search as S
    docs = _docs(spark, [(k, WORDS) for k in range(20)] + [(30, "x the of"), (31, ""), (32, "the")])
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path, buckets=2)
    index = PO.load_index(spark, path)
    terms = _terms(spark, ["the", "the of", "of the", "of a", "the of a", "of a b", "a b the", "b the of", "the c of", "c of the",
                           "the of a b the c", "nowhere", "of nowhere", ""])
    once, _ = PO.distinct_phrases(terms)
    near = PO._matched(index, once, None)
    assert len(near) == 2 and "Window" in near[0]._jdf.queryExecution().executedPlan().toString()
    assert len(PO._matched(index, once.filter("term_no = 1"), None)) == 1
    a = _key(PO.phrase_hits(index, terms))
    assert a == _key(S.phrase_hits(docs, terms)) and len(a) > 100
    assert a == _key(PO.phrase_hits(index, terms, max_broadcast_bytes=0))
    pairs = spark.createDataFrame([(0, 3), (4, 3), (10, 4), (0, 30)], "term_no long, line_no long")
    assert _key(PO.phrase_hits(index, terms, None, pairs)) == [r for r in a if r[:2] in {(0, 3), (4, 3), (10, 4), (0, 30)}]


def test_index_files_hold_about_as_many_rows(spark):
    """A token that few documents hold very often is dealt over files too, and no task gets two folders by chance."""
    import os
    import tempfile
    import pyarrow.parquet as pq
    from phrasemill.operators import index as IDX
    from phrasemill.operators import postings as PO
    from phrasemill.sources import corpus as C
    lines = [(k, "", "src1", "x " + "the " * 100 + " ".join(f"w{(k * 7 + i) % 500}" for i in range(60))) for k in range(60)]
    good, _ = C.parse_scores(spark.createDataFrame(lines, "line_no long, raw string, title string, content string"))
    docs = IDX.build_docs(good, [], starts=PO.STARTS).cache()
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    PO.write_index(docs, path, buckets=4, tokens_per_file=500)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    index = PO.load_index(spark, path)
    rows = index.postings.withColumn("file", F.input_file_name()).groupBy("file").count().collect()
    assert sum(r["count"] for r in rows) == 60 * 160 and len(rows) >= 20
    assert max(r["count"] for r in rows) <= 3 * 500, sorted(r["count"] for r in rows)
    for r in rows:
        t = pq.ParquetFile(r["file"].removeprefix("file://").removeprefix("file:")).read(["token", "line_no", "pos"]).to_pylist()
        assert [tuple(x.values()) for x in t] == sorted(tuple(x.values()) for x in t)
    assert {r.token: r.df for r in index.df.collect()} == {r.token: r.df for r in IDX.doc_freq(docs).collect()}
    text = {k: c for k, _, _, c in lines}
    assert all(text[r.line_no][r.start:r.end] == r.token for r in index.postings.collect())
    assert index.docs.columns == PO.DOC_COLUMNS and index.df.columns == ["token", "df", "bucket"]


def test_tokens_and_starts_of_one_pass(spark):
    """The same tokens, lengths and offsets as by a mask and a token pass for each."""
    from phrasemill.functions import analysis as A
    rng = random.Random(7)
    bits = ["Mr", "U.S", "U.S.", "A.B.C.", "a.b.c.", "end.", ".", ".", " ", " ", "\n", "Word", "other", '"', "'", "'s", "’S", "＇s", "cats",
            "!", ";", ":", "1.5-x", "a@b.cd", "日本", "étui", "😀", "𝒳y", "x" * 255, "y" * 256, "É.", "s", "S.", "\ue000", "\ue001"]
    rare = [*bits[:-2]] * 4 + bits[-2:]
    texts = ["".join(rng.choice(rare) for _ in range(30)) for _ in range(1500)]
    texts += ["", None, " ", "z" * 300, "z" * 300 + " b " + "z" * 300, " He came. Then rain", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string").repartition(3)
    m = A.mask_marked(F.col("content"))
    two = A.with_tokens(df).withColumn("starts", A.original_token_starts(m, A.unmark(m)))
    a = {r.k: (r.toks, r.n_tokens, r.starts) for r in two.collect()}
    b = {r.k: (r.toks, r.n_tokens, r.starts) for r in A.with_tokens(df, starts="starts").collect()}
    assert len(b) == len(texts) and [k for k in a if a[k] != b[k]] == []
    assert sum("\ue000" in (t or "") for t in texts) > 100 and sum(len(v[0] or []) for v in a.values()) > 10000


def test_possessives_and_blanks_as_their_plain_forms(spark):
    from phrasemill.functions import analysis as A
    rows = [(["Tom's", "cats", "JOHN’S", "x＇s", "U.S.", "end.", "y" * 256, "'s", "s", "A.s."],), (["y" * 256, "y" * 300, "b"],), ([],), (["y" * 256],), (None,)]
    df = spark.createDataFrame(rows, "a array<string>").coalesce(1)
    out = [(r.t, r.n) for r in df.select(A.tokens_from_spans(F.col("a")).alias("t")).withColumn("n", A.field_length(F.col("t"))).collect()]
    assert out[0] == (["", "cats", "JOHN", "x", "U.S.", "end", "\u0001", "", "s", "A.s."], 9)
    assert out[1] == (["\u0001", "\u0001", ""], 1) and out[2] == ([], 0) and out[3] == (["\u0001"], 0) and out[4][0] is None


def test_token_counts_are_exact(spark):
    from phrasemill.operators import index as IDX
    rows = [(["", "a", "b", "a", "\u0001"],), (["", "a"],), ([],), (None,), (["", "é", "é"],)]
    docs = spark.createDataFrame(rows * 3, "toks array<string>").repartition(4)
    got = {r.token: (r.df, r.n) for r in IDX.token_counts(docs).collect()}
    assert got == {"a": (6, 9), "b": (3, 3), "\u0001": (3, 3), "é": (3, 6)}


def test_packets_give_back_what_they_hold():
    import numpy as np
    import pyarrow as pa
    from phrasemill.operators import packed as PK
    rng = np.random.default_rng(3)
    arrays = [rng.integers(-5, 2 ** 31 - 1, 1000).astype(np.int32), np.empty(0, np.int64), rng.random(7), np.arange(9, dtype=np.uint8)]
    back = PK.unpack(PK.pack(*arrays), *[a.dtype.type for a in arrays])
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back))
    assert [len(a) for a in PK.unpack(PK.pack(*[np.empty(0, np.int32)] * 2), np.int32, np.int32)] == [0, 0]
    some = rng.integers(0, 10 ** 6, 500).astype(np.int32)
    assert (PK.summed(PK.steps(some)) == some).all() and len(PK.pack(PK.steps(np.arange(10 ** 5)))) < 1000
    sizes = [3, 0, 50, 0, 2, 2, 2, 7, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(sizes)], names=["n"])
    got = [b["n"].to_pylist() for b in PK.gathered(iter([batch, batch]), lambda b: b["n"].to_numpy(), 10)]
    assert [x for b in got for x in b] == sizes * 2 and all(sum(b) <= 10 or sum(b) == 50 for b in got) and len(got) < 10


def test_occurrences_travel_packed(spark, monkeypatch):
    """An exchange of an index build moves packets, not a row per occurrence; null and repeated keys keep their rows."""
    import os
    import tempfile
    from phrasemill.operators import index as IDX
    from phrasemill.operators import postings as PO
    from phrasemill.sources import corpus as C
    lines = [(None if k % 20 == 7 else k // 2, "", f"src{k % 3}", "x " + "the " * 80 + " ".join(f"w{(k * 7 + i) % 30}" for i in range(20))) for k in range(60)]
    lines += [(500, "", "src1", ""), (501, "", "src1", "x"), (502, "", "src1", None)]
    good, _ = C.parse_scores(spark.createDataFrame(lines, "line_no long, raw string, title string, content string").fillna("", ["content"]))
    docs = IDX.build_docs(good, [], starts=PO.STARTS).cache()
    moved, deal = [], type(docs).repartitionById
    monkeypatch.setattr(type(docs), "repartitionById", lambda self, n, c: moved.append(self.count()) or deal(self, n, c))
    monkeypatch.setattr(PO, "TOKENS_AT_ONCE", 1500)
    monkeypatch.setattr(PO, "ROWS_SORTED", 70)
    monkeypatch.setattr(PO, "ROWS_OUT", 40)
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path, buckets=2, tokens_per_file=900)
    assert sum(moved) < 600, moved      # a row per occurrence: 6000
    got = PO.load_index(spark, path).postings
    want = docs.select("line_no", *PO.CARRY, PO.STARTS, F.posexplode("toks").alias("pos", "token")).filter("token <> ''").select(
        "token", "line_no", "pos", F.get(PO.STARTS, F.col("pos")).cast("long").alias("start"), *PO.CARRY)
    key = lambda d: sorted(map(repr, map(tuple, d.collect())))
    assert key(got.select(*want.columns)) == key(want) and want.count() == 60 * 100
    assert got.filter("end <> start + length(token)").isEmpty() and got.filter("line_no IS NULL").count() == 300


def test_a_corpus_of_enough_splits_is_not_moved(spark):
    """Only fewer splits than keep the cores busy are spread, whatever the number of shuffle partitions."""
    from phrasemill.operators import index as IDX
    from phrasemill.operators import postings as PO
    from phrasemill.sources import corpus as C
    rows = spark.createDataFrame([(k, "", "src1", WORDS) for k in range(64)], "line_no long, raw string, title string, content string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for splits, moved in ((2, True), (16, False)):
            good, _ = C.parse_scores(rows.repartition(splits).cache())
            plan = IDX.build_docs(good, [], starts=PO.STARTS)._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(line_no" in plan) == moved
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_index_of_another_layout_is_refused(spark):
    import os
    import tempfile
    import pytest
    from phrasemill.operators import postings as PO
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    spark.createDataFrame([(1, 1.0, 2)], "n_docs long, avgdl double, buckets int").write.parquet(f"{path}/stats")
    with pytest.raises(ValueError, match="write it again"):
        PO.load_index(spark, path)


def test_neighbours_against_a_literal_search():
    """Windows and whole phrases of any length, with gaps between places, in several documents."""
    import numpy as np
    from phrasemill.operators.neighbours import Phrases
    rng = random.Random(11)
    texts = {d: {p: rng.choice("abcd") for p in range(60) if rng.random() < 0.9} for d in range(30)}
    some = {tuple(rng.choice("abcde") for _ in range(n)) for n in (1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 6) for _ in range(6)}
    for d, n in ((3, 9), (4, 4), (5, 7), (6, 30), (7, 4), (8, 5)):
        p = next(p for p in range(60) if all(p + k in texts[d] for k in range(min(n, 6))))
        some.add(tuple(texts[d].get(p + k, "a") for k in range(n)))
    rows = [(100 - k, list(p)) for k, p in enumerate(sorted(some))]
    want = sorted((no, d, p) for no, toks in rows for d, t in texts.items() for p in t if [t.get(p + k) for k in range(len(toks))] == toks)
    phrases = Phrases(rows)
    at = [(phrases.tokens.index(t), d, p) for d, x in texts.items() for p, t in sorted(x.items())]
    code, doc, pos = (np.array(c, np.int64) for c in zip(*at))
    got = sorted((int(phrases.term_no[t]), int(doc[r]), int(pos[r])) for ts, rs in phrases.matches(code, doc, pos) for t, r in zip(ts, rs))
    assert got == want and len({x[0] for x in want if len(dict(rows)[x[0]]) > 3}) > 5 and len(want) > 500
    assert [len(t) for t, _ in phrases.matches(code[:0], doc[:0], pos[:0])] == []


def test_neighbours_travel_packed(spark, monkeypatch):
    """The index search moves packets of occurrences to their documents' parts, and no row per occurrence is sorted there."""
    import os
    import tempfile
    from phrasemill.operators import neighbours as NB
    from phrasemill.operators import postings as PO
    from phrasemill.operators import search as S
    docs = _docs(spark, [(k * 10 ** 12 - 7, WORDS) for k in range(40)] + [(30, "x the of"), (31, ""), (32, "the")])
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path, buckets=2)
    index = PO.load_index(spark, path)
    terms = _terms(spark, ["the", "the of", "of the", "of a", "the of a", "of a b", "a b the", "b the of", "the c of", "of a", "the of a b the c",
                           "of the of a b the of a", "the of a b the a", "of a b c", "nowhere", "of nowhere", ""])
    monkeypatch.setattr(NB, "ROWS_AT_ONCE", 60)
    hits = PO.phrase_hits(index, terms)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "packet" in plan and "hashpartitioning(line_no" not in plan and "hashpartitioning(term_no" not in plan
    a = _key(hits)
    assert a == _key(S.phrase_hits(docs, terms)) and {r[0] for r in a} >= {0, 3, 9, 10, 11} and not {12, 13, 14} & {r[0] for r in a}
    row = lambda d: sorted(map(repr, d.select("term_no", "line_no", "n_tokens", "score", "docid", "tf").collect()))
    assert row(hits) == row(PO.phrase_counts(index, terms)) == row(PO.phrase_hits(index, terms, max_broadcast_bytes=0))
    pairs = spark.createDataFrame([(0, 30), (4, 30), (10, 10 ** 12 - 7), (11, 99), (77, 30)], "term_no long, line_no long")
    assert _key(PO.phrase_hits(index, terms, None, pairs)) == [r for r in a if r[:2] in {(0, 30), (4, 30), (10, 10 ** 12 - 7)}]
    # numbers that are no line's only one are joined as before
    twice = docs.unionByName(docs.filter("line_no = 30"))
    PO.write_index(twice, path + "-twice", buckets=2)
    other = PO.load_index(spark, path + "-twice")
    assert {r.tf for r in PO.phrase_counts(other, terms).filter("line_no = 30 AND term_no = 0").collect()} == {2}


def test_many_rows_are_checkpointed_packed(spark, monkeypatch):
    """All hits of a ranked search are kept as compressed batches, a fraction of a row's 70 bytes; no row changes."""
    from phrasemill import session
    from phrasemill.operators import search as S
    kept, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: kept.append(out := cut(df)) or out)
    rows = spark.range(40000).select((F.col("id") % 400).alias("term_no"), "id", F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias("x"),
                                     F.when(F.col("id") % 5 > 0, F.array(F.col("id").cast("int"))).alias("a"), F.lit("é").alias("s"))
    back = session.cut_lineage_packed(rows)
    assert back.schema == rows.schema and kept[0].columns == ["packet"]
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert kept[0].agg(F.sum(F.length("packet"))).first()[0] < 20 * 40000
    assert session.cut_lineage_packed(rows.filter("id < 0")).collect() == []
    docs, n = _docs(spark, [(k, WORDS) for k in range(20)]), len(kept)
    assert S.ranked_hits(docs, _terms(spark, ["the", "of a"]), starts=False).count() == 40 and ["packet"] in [d.columns for d in kept[n:]]


def test_excerpts_of_an_index_take_its_offsets(spark, sf_dir):
    """The offsets stored with the documents are used: no mask and token pass, and the same excerpts."""
    import os
    import tempfile
    from phrasemill.operators import excerpt as EX
    from phrasemill.operators import index as IDX
    from phrasemill.operators import postings as PO
    from phrasemill.operators import search as S
    from phrasemill.session import cut_lineage
    from phrasemill.sources import corpus as C
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    docs = IDX.build_docs(good, [], starts=PO.STARTS).limit(40).cache()
    path = os.path.join(tempfile.mkdtemp(prefix="pm-idx-"), "index")
    PO.write_index(docs, path, buckets=2)
    index, docs = PO.load_index(spark, path), docs.drop(PO.STARTS)
    terms = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, sizes=(1, 2), only_at=3))
    hits = cut_lineage(S.phrase_hits(docs, terms).join(terms.select("term_no", "term", "q", "n_toks"), "term_no"))
    row = lambda d: sorted(map(repr, d.select("term_no", "line_no", "title", "ex_start", "ex_end", "excerpt").collect()))
    for pick, cap in (("first", None), ("last", 0)):
        a, b = EX.excerpts(docs, hits, pick=pick, max_broadcast_bytes=cap), EX.excerpts(index.texts, hits, pick=pick, max_broadcast_bytes=cap)
        assert row(a) == row(b) and len(row(a)) > 50
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (a, b)]
        assert ["regexp_replace(content" in p and "\ue001" in p for p in plans] == [True, False]
