"""Benchmark: the headline plans on one scale factor.

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries"
(seconds per plan), "sf", plus throughput figures}.

  BENCH_SF_DIR  input tables (default /root/testdata/sf0.1)
  BENCH_CPUS    local[N] (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from phrasemill.operators import index as IDX  # noqa: E402
from phrasemill.operators import search as S  # noqa: E402
from phrasemill.plans import batch as B  # noqa: E402
from phrasemill.session import cut_lineage, get_session  # noqa: E402
from phrasemill.sources import corpus as C  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="pm-bench-")
    spark = get_session(f"local[{cpus}]", "phrasemill-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "16g",
                               "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                               "spark.local.dir": os.path.join(scratch, "local")})
    times, extra = {}, {}

    t = time.time()
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    docs = cut_lineage(IDX.build_docs(good, []))
    n_docs, avgdl = IDX.corpus_stats(docs)
    times["index_build"] = time.time() - t
    extra["tokens"] = int(round(n_docs * avgdl))
    extra["index_tokens_per_sec"] = round(extra["tokens"] / times["index_build"], 1)

    for n in (1, 2, 3):
        terms = cut_lineage(S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, sizes=(n,), whole=False, only_at=3)))
        n_terms = terms.count()
        t = time.time()
        run(S.phrase_hits(docs, terms))
        times[f"hits_{n}tok"] = time.time() - t
        extra[f"terms_{n}tok"] = n_terms
        extra[f"terms_per_sec_{n}tok"] = round(n_terms / times[f"hits_{n}tok"], 2)

    terms_all = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, whole=False, only_at=3))
    t = time.time()
    run(S.ranked_hits(docs, terms_all, limit=20, stats=(n_docs, avgdl)))
    times["ranked_top20"] = time.time() - t

    t = time.time()
    res = B.run_batch(docs, C.terms_from_benchmark(spark, sf_dir, whole=False, only_at=3), B.SearchConfig())
    run(res)
    times["run_batch"] = time.time() - t

    total = sum(times.values())
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "phrase_search_total", "value": round(total, 3), "unit": "sec",
           "queries": {k: round(v, 3) for k, v in times.items()},
           "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus}
    out.update(extra)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
