"""JSON sources: run logs and benchmark files."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession

RUN_LOG = (
    "system STRING, dataset STRING, category STRING, sample_id STRING, run_idx INT, question STRING, gold STRING, predicted STRING, correct BOOLEAN, "
    "abstained BOOLEAN, error STRING, query_tokens INT, write_tokens INT, search_ms DOUBLE, e2e_ms DOUBLE, age_days DOUBLE, extra STRUCT<verified: BOOLEAN, coverage: DOUBLE, confidence: DOUBLE>"
)


def read_run_logs(spark: SparkSession, pattern: str, schema: str = RUN_LOG) -> DataFrame:
    """Lines of all run logs that match; none gives an empty table. Blank lines are no rows, a broken line is an error."""
    if "://" not in pattern and not glob.glob(pattern):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)


def read_first_present(spark: SparkSession, folder: str, names: list[str], schema: str) -> DataFrame:
    """Union of the named files that are there, .json as one document, others line by line; raises if none is."""
    found = [os.path.join(folder, n) for n in names if os.path.exists(os.path.join(folder, n))]
    if not found:
        raise FileNotFoundError(f"none of {names} in {folder}")
    lines, whole = [f for f in found if not f.endswith(".json")], [f for f in found if f.endswith(".json")]
    parts = [spark.read.schema(schema).option("multiLine", m).json(fs) for m, fs in ((False, lines), (True, whole)) if fs]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_records(df: DataFrame, path: str, by: str = "namespace") -> None:
    """Append records as Parquet, one folder per namespace, so that scoped reads prune the rest."""
    df.write.mode("append").partitionBy(by).parquet(path)
