"""Benchmark: the source's lifecycle on Spark, timed per step.

1. ``load_tables``: derive the nine tables from the driver's star schema and
   write them as Parquet (the source builds its database once the same way);
2. every analysis (K*, R*, A*) on the stored tables, each forced to completion
   with the ``noop`` sink (nothing is collected to the driver);
3. the delivery-time pipeline: features with the chronological split, the
   route-model comparison (buffers, hybrid, scoreboard, bins, states) and the
   boosted comparison (mean and 85th-percentile trees, the source's 500 rounds each) with its reports.

Prints one JSON line. Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8), BENCH_ROUNDS (boosting rounds, default 500).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from shipwise import catalog  # noqa: E402
from shipwise.operators import evaluate as ev  # noqa: E402
from shipwise.operators import model_reports as mr  # noqa: E402
from shipwise.operators.features import model_frame  # noqa: E402
from shipwise.operators.models import METHODS, compare_methods  # noqa: E402
from shipwise.session import local_session  # noqa: E402
from shipwise.sources.files import read_tables, write_tables  # noqa: E402
from shipwise.sources.star import star_tables  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    rounds = int(os.environ.get("BENCH_ROUNDS", str(mr.ROUNDS)))
    scratch = tempfile.mkdtemp(prefix="shipwise-bench-")
    spark = local_session(cpus, max(8, 2 * cpus), app="shipwise-bench",
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # warm-up: JVM, codegen caches (not timed)
    run(star_tables(spark, sf_dir).orders.limit(1))

    tables_dir = os.path.join(scratch, "tables")
    timed("load_tables", lambda: write_tables(star_tables(spark, sf_dir), tables_dir))
    t = read_tables(spark, tables_dir)

    model_names = set(mr.queries()) | set(mr.boosted_queries())
    for name, fn in catalog.table_queries().items():
        if name in model_names:
            continue
        timed(name, lambda fn=fn: run(fn(t)))

    frame = timed("m1_m8_features_and_split", lambda: model_frame(t))
    cmp = timed("m13_m18_route_model_chain", lambda: compare_methods(frame))
    timed("e4_scoreboard_route_models", lambda: run(ev.scoreboard(cmp.test, METHODS)))
    timed("e6_by_duration_hybrid", lambda: run(ev.by_duration(cmp.test, "pred_hybrid")))
    timed("e8_by_state_hybrid", lambda: run(ev.by_state(cmp.test, "pred_hybrid", late=True)))
    if rounds > 0:
        bcmp = timed("m9_m10_boosted_comparison", lambda: compare_methods(frame, *mr.boosted(rounds)))
        cells = timed("e1_e8_boosted_cells", lambda: ev.report_cells(bcmp.test, METHODS).checkpoint(eager=True))
        timed("e4_scoreboard_boosted", lambda: run(ev.cells_scoreboard(cells)))
        timed("e8_by_state_hybrid_boosted", lambda: run(ev.cells_by_state(cells, "5_hybrid", late=True)))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus,
                      "boost_rounds": rounds, "n_queries": len(times)}))
    spark.stop()


if __name__ == "__main__":
    main()
