"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say on what. Each query runs once to warm up
and then REPEATS times; the median counts. Text and vector searches run on indexes that are written once, before.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

REPEATS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from marlstone.operators import textsearch, vectorsearch
    from marlstone.queries import QUERIES, WORDS, load
    from marlstone.session import local_session

    spark = local_session(cpus, "12g", cpus)
    work = tempfile.mkdtemp(prefix="marlstone-bench-")
    took: dict[str, float] = {}

    def timed(name, run, warm: int = 1, repeats: int = REPEATS):
        for _ in range(warm):
            run()
        times = []
        for _ in range(repeats):
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times), 4)

    def whole(name):
        return lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    docs = load(spark, sf_dir, "documents")
    built = iter(f"{work}/text{i}" for i in range(1 + REPEATS))
    timed("text_index_build", lambda: textsearch.TextIndex.build(docs, "doc_id", "text").write(next(built)))
    index = textsearch.TextIndex.read(spark, f"{work}/text0").cached()
    index.postings.count(), index.idf.count()
    timed("text_knn_indexed", lambda: index.top(WORDS, 8).collect(), warm=3, repeats=7)

    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding").cache()
    vectors.count()
    asked = list(vectors.where("vec_id = 0").first()["embedding"])
    timed("vec_knn_seq", lambda: vectorsearch.nearest_by_cosine(vectors, "vec_id", "embedding", asked, 5).select("vec_id", "similarity").collect(), warm=3, repeats=7)
    lists = vectorsearch.postings(vectors, "vec_id", "embedding").cache()
    shares = vectorsearch.list_sizes(lists, vectors.count())
    timed("vec_knn_idx", lambda: vectorsearch.nearest_by_index(vectors, lists, "vec_id", "embedding", asked, 5, shares).select("vec_id", "similarity").collect(), warm=3, repeats=7)
    sparse, norms = vectorsearch.heaviest(lists).cache(), vectorsearch.full_norms(vectors, "vec_id", "embedding").cache()
    sparse.count(), norms.count()
    timed("sparse_knn", lambda: vectorsearch.sparse_scores(sparse, norms, {i: x for i, x in enumerate(asked) if x > 0}).orderBy(F.desc("similarity")).limit(5).collect(), warm=3, repeats=7)

    for name in ("scan_all", "eq_point", "range_int", "range_and_eq", "in_list", "or_parens", "insert_dedup", "bulk_first_wins", "delete_eq", "geo_within_struct", "geo_within_json", "geo_knn", "text_df_idf", "hist_tfidf_smooth", "codeword_assign", "vec_topb_sparse", "bench_summary"):
        timed(name, whole(name))
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
