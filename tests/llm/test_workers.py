"""The queries run where Python workers cannot import this package (they get its functions and models by value)."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path alone
import __spark_entry__ as entry
from shipwise.session import local_session
spark = local_session(4, 4)

def importable(rows):
    list(rows)
    try:
        import shipwise
        yield 1
    except ImportError:
        yield 0
assert spark.sparkContext.parallelize(range(2), 2).mapPartitions(importable).collect() == [0, 0]
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


@pytest.mark.parametrize("names", [("op1_minhash_near_dedup", "op4_language_id", "op7_toxicity"), ("op11_hard_negatives", "op12_lm_scores", "op13_phrase_collocations")])
def test_workers_without_the_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == list(names)


def test_file_tasks_give_back_the_encoder(monkeypatch):
    """Writing and reading token files start from a worker without what encoding left in it."""
    import sys
    import numpy as np
    import pyarrow as pa
    from shipwise.llm import token_file
    rows = pa.table({"shard": [0, 0], "doc_id": [2, 1], "width": [2, 2], "ids": [np.array(x, "<u2").tobytes() for x in ([7, 2], [2])]})
    held = {"token_file": ("encoder", object())}
    monkeypatch.setitem(sys.__dict__, "_shipwise_worker_cache", held)
    segment = token_file._write(rows).column("segment")[0].as_py()
    assert not held
    held["token_file"] = ("encoder", object())
    (batch,) = token_file._read(iter([pa.RecordBatch.from_arrays([pa.array([segment + b"\n"], pa.binary())], ["content"])]))
    assert not held and batch.column("doc_id").to_pylist() == [1, 2] and batch.column("n_tokens").to_pylist() == [1, 2]
