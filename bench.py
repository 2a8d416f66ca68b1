"""Time the registered queries: one JSON line with seconds per query.

Every query is run once to warm up and then up to ``BENCH_RUNS`` times (three
unless set); its time is the median of building, planning and running it with all
rows computed. Once ``BENCH_BUDGET`` seconds are used, the queries left run once
after their warm-up. The flagship also runs on ``BENCH_SMALL_DIR``, where it exists, to show
how it grows with the data.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from secretsift.catalog.queries import QUERIES  # noqa: E402
from secretsift.session import local_session  # noqa: E402

# One query per kind of work: hosts, links, resources, ranking, texts, the whole.
HEADLINE = [
    "q38_flagship", "q22_network_resources", "q24_dedup_last", "q29_tiered_limit", "q17_internal_links",
    "q37_report", "q36_candidates_per_resource", "q31_findings_generic", "q15_resolve_url",
    "q13_registered_domain", "q11_subdomain_union", "q08_archive_filter",
]


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    end = time.perf_counter() + float(os.environ.get("BENCH_BUDGET", "240"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(
        os.environ.get("BENCH_CPUS", "8"), "secretsift-bench", spark__ui__showConsoleProgress="false"
    )
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, folder)
        times = [timed(QUERIES[name], spark, folder)]
        while len(times) < runs and time.perf_counter() < end:
            times.append(timed(QUERIES[name], spark, folder))
        seconds[name] = round(statistics.median(times), 3)
        print(name, times, file=sys.stderr, flush=True)
    if os.path.isdir(small) and "q38_flagship" in names:
        seconds["q38_flagship_small"] = round(timed(QUERIES["q38_flagship"], spark, small), 3)
    total = sum(t for n, t in seconds.items() if not n.endswith("_small"))
    print(json.dumps({
        "metric": "total_seconds", "value": round(total, 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
