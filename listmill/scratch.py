"""Shared folder for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting, as in tests, gets a temporary folder of this machine, which goes with the
    process; on a cluster a missing setting is an error. A cluster's folder holds all work
    tables below ``listmill``, to be cleared when no job is running.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return f"{root.rstrip('/')}/listmill/{purpose}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{_local_folder()}/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="listmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
