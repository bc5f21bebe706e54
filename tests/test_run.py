"""Smoke test of the end-to-end workflow runner."""

from conftest import SF_SMALL


def test_run_workflow(spark, tmp_path):
    from shipwise.run import run
    r = run(spark, str(tmp_path / "out"), star_dir=SF_SMALL, rounds=2, lr=0.1)
    assert "k13_delay_buckets" in r["results"] and "model_scoreboard" in r["results"]
    board = spark.read.parquet(str(tmp_path / "out" / "results" / "model_scoreboard")).collect()
    assert sorted(x["method"] for x in board) == ["1_promise", "2_base", "3_route_buffer", "4_quantile_85",
                                                  "5_hybrid"]
