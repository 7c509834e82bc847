"""The folder that driver and executors share, and paths in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster names it in spark.checkpoint.dir.

    Where that is unset and the master is local (tests on one machine) a temporary folder becomes
    the checkpoint folder of the session's context; on a cluster it is an error, as executors don't
    share the driver's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="eigenweave-")
        atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; it stays until clear_scratch()."""
    return f"{shared_dir(spark)}/eigenweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder. Results that still read them must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/eigenweave/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
