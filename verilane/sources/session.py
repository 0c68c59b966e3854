"""Cutting a plan where its result is used more than once or its expressions would grow without bound."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder and read from there; a folder of our own only in local mode, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


#: Environment variable that names the folder of the result cache, and the file in it.
CACHE_VARIABLE, CACHE_FILE = "VERILANE_CACHE", "result_cache"


def cache_path(given: str | None = None) -> str:
    """Where results are cached: in the folder given, else in the one the environment names, else in the working directory."""
    folder = given or os.environ.get(CACHE_VARIABLE)
    return f"{folder.rstrip('/')}/{CACHE_FILE}" if folder else CACHE_FILE
