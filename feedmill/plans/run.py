"""A run of several stages, each for itself: one that fails doesn't keep the others from running."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stages(spark: SparkSession, stages: dict[str, Callable[[SparkSession], DataFrame]], write: Callable[[str, DataFrame], None]) -> DataFrame:
    """``stage, ok, error`` of the stages in their order; each one's table goes to ``write`` with its name."""
    log = []
    for name, stage in stages.items():
        try:
            write(name, stage(spark))
            log.append((name, True, None))
        except Exception as e:  # noqa: BLE001 - whatever a stage raises belongs into the log
            log.append((name, False, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(log, "stage string, ok boolean, error string")
