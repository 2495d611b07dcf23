"""The physical plans keep their scale properties (checked on the plan text)."""

from pyspark.sql import functions as F

from fixtures import TEST_CORPUS
from phrasemill.operators import index as IDX
from phrasemill.operators import search as S
from phrasemill.sources import corpus as C


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    lines = spark.createDataFrame([(i + 1, r) for i, r in enumerate(TEST_CORPUS)], "line_no long, raw string")
    good, _ = C.split_lines(lines)
    return IDX.build_docs(good, []).cache()


def _terms(spark):
    return S.normalize_terms(spark.createDataFrame([(1, "lighthouse"), (2, "apple trees"), (3, "up and down")],
                                                   "term_no long, term string"))


def test_top_n_is_a_group_limit(spark):
    p = plan(S.ranked_hits(_docs(spark), _terms(spark), limit=20, starts=False))
    assert "WindowGroupLimit" in p          # partial top-N before the shuffle


def test_small_terms_are_broadcast_and_ngrams_stay_local(spark):
    p = plan(S.phrase_hits(_docs(spark), _terms(spark)))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p
    assert p.count("Generate") == 2          # one scan: positions, then one row per term length


def test_large_terms_are_pruned_and_preaggregated(spark):
    p = plan(S.phrase_hits(_docs(spark), _terms(spark), max_broadcast_bytes=0))
    assert "LeftSemi" in p                   # first-token pruning before the shuffle
    assert "partial_collect_list" in p or "ObjectHashAggregate" in p


def test_title_pass_reads_only_id_and_title(spark, sf_dir):
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    p = plan(IDX.source_table(good, []))
    scans = [ln for ln in p.splitlines() if "FileScan parquet" in ln]
    assert scans and all("text" not in ln.split("]")[0] for ln in scans)
