"""A Spark-native engine for text corpora and byte-level BPE tokenizers."""

from __future__ import annotations

import os
from pathlib import Path


def reach_workers(spark) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    On a cluster whose machines don't share that folder, ship the package with ``--py-files`` instead; this does no harm then.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def small_batches(spark, size: str = "16m") -> None:
    """Lower the bytes of an Arrow batch to ``size``, unless the session has a limit of its own; workers then hold less at once."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 26
    if spark.conf.get(key).rstrip("b") == str(default):
        spark.conf.set(key, size)
