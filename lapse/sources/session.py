"""Cutting lineage where a table is read many times."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def pin(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder, so that later jobs, and retries after a lost
    executor, start from the written copy.

    The copy goes when the frame is no longer referenced, if the session has
    `spark.cleaner.referenceTracking.cleanCheckpoints`, or with the folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, which all executors see.

    Where none is named, a local master (one process, one machine) gets a temporary
    one that goes with the process; a cluster is refused.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lapse-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder
