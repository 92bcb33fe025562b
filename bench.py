"""Headline timings as one JSON line: python bench.py  (BENCH_SF_DIR, BENCH_CPUS)."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# name -> registered query; phases of the published baseline first. Index and question phases read all
# documents; fulltext_questions analyses them anew, stored_fulltext_questions asks a stored index.
HEADLINE = {
    "register": "cat_02",
    "pack_blocks": "doc_09",
    "fulltext_index": "idx_03",
    "fulltext_questions": "qry_03",
    "vector_questions": "qry_04",
    "hybrid_questions": "qry_15",
    "alpha_n_k_grid": "eva_05",
    "row_documents": "src_13",
    "type_inference": "gen_06",
    "joinable_tables": "gen_20",
    "verified_cells": "gen_18",
    "label_spreading": "gen_23",
}
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def stored_index(spark, sf_dir: str) -> tuple[float, float]:
    """Seconds to build and store the hybrid index, and to answer all questions from its full-text part."""
    from tablescout.operators import indexing, textindex
    from tablescout.plans import retrieval
    from tablescout.session import scratch_path

    start, path = time.perf_counter(), scratch_path(spark, "bench-index")
    indexing.build_index(retrieval.indexed_corpus(spark, sf_dir), path, stem=False)
    built = time.perf_counter()
    terms = textindex.query_terms(retrieval.plain_questions(spark, sf_dir), stem=False)
    found = textindex.text_topk(indexing.text_source(spark, path), terms, retrieval.DEPTH)
    found.write.format("noop").mode("overwrite").save()
    return built - start, time.perf_counter() - built


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tablescout.plans import QUERIES
    from tablescout.session import build_session

    shared = os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="bench-shared-")

    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(HEADLINE)
    best: dict[str, float] = {}
    for name in names:
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[HEADLINE[name]](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best[name] = min(best.get(name, spent), spent)
        print(f"{name}: {best[name]:.2f}s", file=sys.stderr, flush=True)
    if len(sys.argv) == 1:
        runs = [stored_index(spark, sf_dir) for _ in range(RUNS)]
        best["stored_hybrid_index"], best["stored_fulltext_questions"] = (min(r[i] for r in runs) for i in (0, 1))
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    questions, documents = read("benchmark"), read("documents")
    per_second = {n: round(questions / best[n], 2) for n in best if n.endswith("_questions")}
    print(json.dumps({
        "metric": "table discovery phases, best of runs", "value": round(sum(best.values()), 3), "unit": "sec",
        "queries": {n: round(t, 3) for n, t in best.items()}, "sf": os.path.basename(sf_dir.rstrip("/")),
        "questions": questions, "documents": documents, "questions_per_second": per_second,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
