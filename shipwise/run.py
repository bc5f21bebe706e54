"""Run the whole workflow on a data set: load, checks, analyses, model.

    python -m shipwise.run --csv DIR --out OUT [--buckets N] [--rounds R]
    python -m shipwise.run --star SF_DIR --out OUT          # the driver's test tables

1. load: the nine tables (source CSV files, or the star schema mapped) are
   stored as Parquet under ``OUT/tables`` (with ``--buckets``: as catalog
   tables bucketed by order id); CSV records that cannot be converted go to
   ``OUT/rejects`` with their reasons;
2. every registered analysis (A4-A6, K*, R*, previews) is written to
   ``OUT/results/<name>``;
3. the v2 comparison with the boosted models is written to
   ``OUT/results/model_*`` (scoreboard, bins, states, buffers, importances).

On a cluster, ``OUT`` must be a shared folder and ``spark.checkpoint.dir``
must be set; locally both default to folders of their own.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os

from pyspark.sql import SparkSession

from . import catalog
from .operators import buffers as bf
from .operators import evaluate as ev
from .operators import model_reports as mr
from .operators.features import model_frame
from .operators.models import METHODS, compare_methods, feature_importance
from .session import ensure_checkpoint_dir
from .sources.files import load_csv, read_catalog_tables, read_tables, write_catalog_tables, write_tables
from .sources.star import star_tables


def run(spark: SparkSession, out: str, csv_dir: str | None = None, star_dir: str | None = None,
        buckets: int = 0, rounds: int = 500, lr: float = 0.05) -> dict:
    ensure_checkpoint_dir(spark)
    src, rejects = load_csv(spark, csv_dir) if csv_dir else (star_tables(spark, star_dir), None)
    tables_dir = os.path.join(out, "tables")
    layout = {"bucketed": False}
    if rejects is not None:
        rejects.write.mode("overwrite").parquet(os.path.join(out, "rejects"))
    if buckets:
        # a database of its own for each place: another run's tables are never written over
        database = f"shipwise_run_{hashlib.sha256(os.path.abspath(out).encode()).hexdigest()[:12]}"
        layout = write_catalog_tables(src, database, tables_dir, buckets)
        t = read_catalog_tables(spark, database)
    else:
        write_tables(src, tables_dir)
        t = read_tables(spark, tables_dir)

    res = os.path.join(out, "results")
    skip = set(mr.queries()) | set(mr.boosted_queries())
    written = []
    for name, fn in catalog.table_queries().items():
        if name in skip:
            continue
        fn(t).write.mode("overwrite").parquet(os.path.join(res, name))
        written.append(name)

    frame = model_frame(t)
    cmp = compare_methods(frame, *mr.boosted(rounds, lr))
    cells = ev.report_cells(cmp.test, METHODS).checkpoint(eager=True)
    model_out = {
        "model_errors": ev.cells_errors(cells, "2_base"),
        "model_scoreboard": ev.cells_scoreboard(cells),
        "model_by_duration": ev.cells_by_duration(cells, "5_hybrid"),
        "model_by_duration_base": ev.cells_by_duration(cells, "2_base"),
        "model_by_state": ev.cells_by_state(cells, "5_hybrid", late=True),
        "model_by_state_base": ev.cells_by_state(cells, "2_base"),
        "model_route_buffers": cmp.buffers,
        "model_largest_buffers": bf.buffer_extremes(cmp.buffers, 10, True),
        "model_smallest_buffers": bf.buffer_extremes(cmp.buffers, 10, False),
        "model_hybrid_extra": cmp.hybrid_extra,
        "model_split": ev.split_report(frame),
        "model_filter": ev.filter_report(t),
        "model_long_haul": ev.long_haul_share(cmp.test),
        "model_feature_importance": feature_importance(cmp.base.nodes(spark)),
        "model_training_curves": mr.training_curves(cmp.base, cmp.quantile, cmp.train),
    }
    for name, df in model_out.items():
        df.write.mode("overwrite").parquet(os.path.join(res, name))
        written.append(name)
    return {"layout": layout, "global_buffer": cmp.global_buffer, "results": written,
            "quantile_train_pinball": cmp.quantile.history()[-1]}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with the nine source CSV files")
    src.add_argument("--star", help="folder with the driver's star-schema Parquet tables")
    ap.add_argument("--out", required=True)
    ap.add_argument("--buckets", type=int, default=0, help="bucket the order-keyed tables (0: plain Parquet)")
    ap.add_argument("--rounds", type=int, default=500)
    ap.add_argument("--lr", type=float, default=0.05)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("shipwise").getOrCreate()
    print(json.dumps(run(spark, a.out, a.csv, a.star, a.buckets, a.rounds, a.lr)))


if __name__ == "__main__":
    main()
