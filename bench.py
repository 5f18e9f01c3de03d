"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lodemap import get_session  # noqa: E402
from workload import registry  # noqa: E402

HEADLINE = [
    "blast_radius", "collapse_edges", "degree", "hubs", "links", "summary_counts", "search", "shortest_paths", "dir_tree",
    "classify_paths", "ignore_repo_rules", "file_nodes", "layer_members", "resolve_tsjs", "reference_edges", "test_pairs",
    "cap_edges", "tour", "repair_nodes", "repair_edges", "issue_totals", "snapshot_diff", "signature_changes", "freshness",
    "wiki_links", "wiki_citations", "page_links", "rect_query", "close_pairs", "debounce", "extract_packs", "line_metrics",
    "call_edges", "batches", "parse_responses", "compact_nodes", "analyze", "dependency_rank", "tree_changes",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", cpus, spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    found = registry()
    names = sys.argv[1:] or HEADLINE
    found["degree"][0](spark, sf).write.format("noop").mode("overwrite").save()  # warm up the JVM
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        found[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
