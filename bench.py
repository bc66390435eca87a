"""Headline timings: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
``ingest`` builds the canonical tables from transcripts; list, show and search then run on them, as
with a warm summary cache. Every other entry is a registered query over the whole tables. Times are
the slower of two runs after a warm-up run, as the figures to compare with are.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
HEADLINE = [
    "price_requests", "cost_buckets", "dedup_requests", "owned_cost", "replay_report", "list_sessions", "corpus_summary", "tree_closure",
    "tree_rollup", "pair_tool_result", "prompt_context", "mirror_dedup", "transcript_ledger", "transcript_events", "rollout_ledger",
    "rollout_events", "resolve_selector", "link_spawn", "list_fuzzy", "search_literal", "search_regex", "search_documents", "token_scan", "clean_text", "prompt_texts",
]


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("sessionlake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.default.parallelism", CPUS)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(frame) -> None:
    """Compute every row and column without keeping them."""
    frame.write.format("noop").mode("overwrite").save()


def clocked(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def transcript_corpus(spark):
    """Canonical tables over the events table written as transcripts."""
    from pyspark.sql import functions as F

    from sessionlake.corpus import Corpus
    from sessionlake.plans.staging import stage
    from sessionlake.sources import tables

    raw = stage(tables.event_transcripts(spark, SF_DIR), "bench-raw")
    files = raw.groupBy("agent", "path").agg(
        F.sum("byte_length").alias("size_bytes"), F.lit(0).cast("timestamp").alias("modified_at")
    )
    return Corpus(spark, stage(files, "bench-files"), raw, tables.event_pricing(spark))


def main() -> None:
    from pyspark.sql import functions as F

    from sessionlake.operators import search, sessions
    from sessionlake.registry import QUERIES

    spark = session()
    timings: dict[str, float] = {}
    corpus = transcript_corpus(spark)

    def ingest() -> None:
        corpus.nodes, corpus.events

    timings["ingest"] = clocked(ingest)
    size = corpus.raw.agg(F.sum("byte_length")).first()[0]
    first = corpus.roots.orderBy("ref").first()
    served = {
        "list": lambda: sessions.list_sessions(corpus.roots, sort="cost").collect(),
        "show": lambda: sessions.show_session(corpus.nodes, corpus.events, first.ref).collect(),
        "search_project": lambda: search.search_events(corpus.nodes, corpus.events, corpus.pairs, "no such words", project=first.project).collect(),
        "search_corpus": lambda: search.search_events(corpus.nodes, corpus.events, corpus.pairs, "no such words").collect(),
    }
    for name, action in served.items():
        action()
        timings[name] = max(clocked(action) for _ in range(RUNS))
    for name in HEADLINE:
        timings[name] = clocked(lambda: run(QUERIES[name](spark, SF_DIR)))
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
                "transcript_bytes": size,
                "document_search_mb_per_s": round(texts / 1e6 / timings["search_documents"], 1),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
