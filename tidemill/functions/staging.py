"""Results that several later steps read: written once to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the cluster names in
    ``spark.checkpoint.dir``; only in local mode, where none may be named, a temporary
    one is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tidemill-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: a lost executor costs nothing that was
    finished."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
