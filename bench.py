"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from passagemill.plans.queries import QUERIES
from passagemill.session import local_session

HEADLINE = (
    "norm_answer", "answer_in_context", "bleu_max", "context_assemble", "evaluate_run",
    "metrics_by_run", "selection_then_answer", "prompt_rebuild", "wins_a_over_b",
    "silver_greedy", "instruction_rows", "quota_sample", "batch_generate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in names if n] or list(HEADLINE)
    # Start-up and the first Python worker belong to no query.
    QUERIES["batch_generate"](spark, sf_dir).limit(1).collect()
    seconds: dict[str, float] = {}
    building: dict[str, float] = {}
    for name in names:
        start = time.time()
        df = QUERIES[name](spark, sf_dir)  # includes the tables a query stores on its way
        building[name] = round(time.time() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "building": building, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
