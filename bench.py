"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from kelora import catalog
from kelora.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = """q_agg02_noisy_or q_flt01_active q_agg04_distinct_authors q_agg12_median q_jon23_next_departure q_jon24_interval_match q_jon30_reconcile q_stm05_sessions q_mth16_calibrated
q_agg24_journey_hazard q_jon01_stop_times_trips q_win01_stop_pairs q_win02_interpolate q_win05_rank q_jon10_frequency_expansion q_jon06_interchanges q_agg05_repost_collapse q_flt14_document_class q_gra01_earliest_arrival
q_str16_phrases q_pip04_verified""".split()


def main() -> None:
    spark = session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()  # starts the session; not timed
    took = {}
    for name in NAMES:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total seconds (best of 2)", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    sys.exit(main())
