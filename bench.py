"""Headline queries timed on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_top10", "vector_search", "hybrid_top10", "rerank_lexical", "rag_context", "tokenize", "chunk_by_heading",
    "chunk_by_paragraph", "embed_documents", "vector_top", "changed_notes", "upsert_notes", "resolve_names", "graph_edges",
    "relations", "backlinks", "note_moc", "tag_index", "vault_stats", "concepts", "link_candidates", "revert_links",
    "assemble_book", "chapter_text", "trim_sessions", "session_summary", "trace_audit", "export_jsonld", "alert_events",
]


def main() -> None:
    from corpusloom.plans import registry
    from corpusloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    # small runs first, so that JVM and Python workers are up for every query alike
    for name in ("bm25_top10", "embed_documents", "vector_top"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
