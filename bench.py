"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Filters run over a materialised event table, as a store holds it; each figure is the median of three warm runs whose
results are fully materialised. Corpus operators run over their whole table, once after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark import catalog
from tidemark.operators import counts, writes
from tidemark.plans.filters import Filter
from tidemark.plans.query import query

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def filters() -> list[Filter]:
    a, e, p = catalog.AUTHORS, [catalog._id(n) for n in range(40, 60)], [catalog._user(n) for n in range(2, 9)]
    return [
        Filter(kinds=(1, 7, 0, 30023)), Filter(kinds=(1, 7), tags={"p": tuple(p[:2])}), Filter(tags={"p": tuple(p[:2])}), Filter(kinds=(1, 7), authors=tuple(a[:2])),
        Filter(kinds=(1, 7), since=catalog.SINCE, until=catalog.UNTIL), Filter(authors=tuple(a[:2])), Filter(tags={"e": tuple(e)}), Filter(tags={"e": tuple(e[:1])}, kinds=(1,)),
        Filter(tags={"t": ("click",), "d": ("3",)}), Filter(limit=20), Filter(since=catalog.UNTIL, kinds=(0,)), Filter(authors=tuple(a), tags={"d": ("5",)}, until=catalog.UNTIL),
    ]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}

    def run(name: str, make, times: int = 3) -> None:
        own = []
        for _ in range(times + (times > 1)):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - start)
        took[name] = round(statistics.median(own[times > 1 :]), 3)

    try:
        catalog.event_view(spark, SF).repartitionByRange(int(CPUS), "created_at").sortWithinPartitions("created_at").write.parquet(f"{folder}/events")
        events = spark.read.parquet(f"{folder}/events")
        for k, f in enumerate(filters()):
            run(f"q{k}", lambda f=f: query(events, f))
        run("count", lambda: counts.count(events, Filter(kinds=(1,))))
        run("hll", lambda: counts.registers(events, Filter(kinds=(7,)), 8))
        run("publish", lambda: writes.publish(events, events.where("created_at % 3 = 0")))
        try:
            from tidemark.llm import queries as corpus
        except ImportError:
            corpus = None
        for name, make in (corpus.QUERIES if corpus else {}).items():
            run(name, lambda make=make: make(spark, SF), 1)
        print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
        sys.stdout.flush()


if __name__ == "__main__":
    main()
