"""Physical-plan inspection used by the plan tests and the scale review.

These read Spark's own plan strings; nothing here plans or rewrites queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# operators that must not appear in an analysis plan
FORBIDDEN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame) -> str:
    """The physical plan as Spark prints it (AQE initial plan before execution)."""
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df: DataFrame) -> str:
    """``explain('formatted')`` as a string."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def forbidden_operators(df: DataFrame) -> list[str]:
    text = plan_text(df)
    return [op for op in FORBIDDEN if op in text]


def shuffle_count(df: DataFrame) -> int:
    """Number of shuffle exchanges in the (pre-execution) physical plan."""
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                          plan_text(df)))


def scans(df: DataFrame) -> list[dict]:
    """File scans with their pushed filters and read schema."""
    out = []
    for line in plan_text(df).splitlines():
        if "FileScan" not in line:
            continue
        pushed = re.search(r"PushedFilters: \[(.*?)\]", line)
        schema = re.search(r"ReadSchema: (struct<.*?>)", line)
        out.append({"pushed": pushed.group(1) if pushed else "",
                    "read_schema": schema.group(1) if schema else ""})
    return out


def summary(df: DataFrame) -> dict:
    text = plan_text(df)
    return {
        "shuffles": shuffle_count(df),
        "broadcasts": text.count("BroadcastExchange"),
        "sort_merge_joins": text.count("SortMergeJoin"),
        "broadcast_hash_joins": text.count("BroadcastHashJoin"),
        "windows": text.count("Window ["),
        "forbidden": forbidden_operators(df),
        "scans": scans(df),
    }
