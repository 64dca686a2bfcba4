"""The folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder, which goes
    when the process ends; on a cluster that is an error, as executors don't share the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share, before the session starts")
    if context.applicationId not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[context.applicationId] = f"file://{folder}"
    return _LOCAL[context.applicationId]


def application_dir(spark: SparkSession) -> str:
    """The folder that holds all of this application's tables; no other application's are in it, so
    it may be removed when the application has ended."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
