"""Time the queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one JSON line.

``BENCH_QUERIES`` may name queries, separated by commas. Each query is run once after a short
warm-up and its rows go to Spark's ``noop`` sink. The rate of the subtitle tokens is the median of three runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wordloom.catalog.inputs import document_subtitles  # noqa: E402
from wordloom.catalog.queries import QUERIES  # noqa: E402
from wordloom.operators.subtitles import subtitle_tokens  # noqa: E402
from wordloom.session import build_session  # noqa: E402


def timed(df_of) -> float:
    start = time.perf_counter()
    df_of().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("unique_check", "batch_status"):
        timed(lambda: QUERIES[name](spark, sf_dir))

    times = {name: timed(lambda: QUERIES[name](spark, sf_dir)) for name in names}

    # The published bound of the baseline is for tokenising subtitles, per thread.
    texts = document_subtitles(spark, sf_dir)
    n_bytes = texts.selectExpr("sum(octet_length(text))").first()[0]
    seconds = sorted(timed(lambda: subtitle_tokens(texts)) for _ in range(3))[1]
    rate = n_bytes / 1e6 / seconds / int(cpus)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "subtitle_mb": round(n_bytes / 1e6, 1),
                "subtitle_sec": seconds,
                "subtitle_mb_per_sec_per_cpu": round(rate, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
