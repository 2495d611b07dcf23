"""Expansion rounds, result limit and the source quota against plain loops."""

import random

from phrasemill.operators import ranking as RK


def serial_quota(cands, k, cap):
    """The reference's walk: terms in order, each takes its next candidate
    whose source still has room, until k results."""
    used, out = {}, set()
    for term in sorted({c[0] for c in cands}):
        got = 0
        for _, ex_rank, src in sorted(c for c in cands if c[0] == term):
            if got >= k:
                break
            if used.get(src, 0) >= cap:
                continue
            used[src] = used.get(src, 0) + 1
            out.add((term, ex_rank))
            got += 1
    return out


def test_quota_matches_serial(spark):
    rnd = random.Random(7)
    for trial in range(3):
        cands = []
        for term in range(25):
            for r in range(1, rnd.randint(1, 12)):
                # one hot source holds about a third of all candidates
                src = 0 if rnd.random() < 0.33 else rnd.randint(1, 6)
                cands.append((term, r, src))
        k, cap = rnd.randint(1, 4), rnd.randint(1, 6)
        df = spark.createDataFrame(cands, "term_no long, ex_rank int, docid long")
        got = {(r.term_no, r.ex_rank) for r in RK.apply_source_quota(df, k, cap).collect()}
        assert got == serial_quota(cands, k, cap), (trial, k, cap)


def test_expansion_limits():
    assert RK.expansion_limits(20, 3, 2.0) == [20, 40, 80, 160]
    assert RK.expansion_limits(20, 3, 2.0, expand=False) == [20]
    assert RK.expansion_limits(10, 2, 1.5) == [10, 15, 22]


def test_select_round(spark):
    # term 1: first 20 ranks all skipped, next 20 accepted -> stops in round 2
    rows = [(1, r, None if r <= 20 else 5, 100) for r in range(1, 161)]
    # term 2: fewer hits than the match limit -> round 1
    rows += [(2, r, 3, 7) for r in range(1, 8)]
    df = spark.createDataFrame(rows, "term_no long, rank int, penalty int, n_hits long")
    cum = RK.select_round(df, [20, 40, 80, 160], 20, "cumulative").collect()
    assert {r.round for r in cum if r.term_no == 1} == {2}
    assert sorted(r.rank for r in cum if r.term_no == 1) == list(range(21, 41))
    assert len([r for r in cum if r.term_no == 2]) == 7
    band = RK.select_round(df, [20, 40, 80, 160], 20, "band").collect()
    assert sorted(r.rank for r in band if r.term_no == 1) == list(range(21, 41))


def test_quota_needs_few_rounds(spark):
    """400 terms x 160 candidates over 20 sources: the serial result in at most 12 rounds."""
    rnd = random.Random(3)
    cands = [(t, r, rnd.randint(0, 19)) for t in range(400) for r in range(1, 161)]
    df = spark.createDataFrame(cands, "term_no long, ex_rank int, docid long")
    got = {(r.term_no, r.ex_rank) for r in RK.apply_source_quota(df, 5, 50, max_rounds=12).collect()}
    assert got == serial_quota(cands, 5, 50)


def test_quota_with_usage_and_no_room(spark):
    cands = [(t, r, r % 3) for t in range(10) for r in range(1, 7)]
    df = spark.createDataFrame(cands, "term_no long, ex_rank int, docid long")
    usage = spark.createDataFrame([(0, 2), (0, 2), (1, 1)], "docid long, n long")       # source 0 is full
    got = RK.apply_source_quota(df, 3, 4, usage).collect()
    count = {d: sum(r.docid == d for r in got) for d in range(3)}
    assert count == {0: 0, 1: 3, 2: 4}


def test_top_per_group_beyond_the_group_limit(spark):
    from pyspark.sql import functions as F
    from phrasemill.session import top_per_group
    df = spark.range(20000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"), "id")
    got = top_per_group(df, ["k"], [F.col("v")], 1500, "r")
    want = {(r.k, r.id) for r in df.collect()}
    best = {k: sorted((r.v, r.id) for r in df.filter(f"k = {k}").collect())[:1500] for k in range(3)}
    rows = got.collect()
    assert len(rows) == 4500 and {(r.k, r.id) for r in rows} <= want
    assert all(best[r.k][r.r - 1] == (r.v, r.id) for r in rows)
