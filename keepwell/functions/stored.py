"""Tables that several passes read: written once, as Parquet, where every executor finds them.

A lost executor costs a re-read, never another order or numbering of the rows. The folder is the one
that spark.checkpoint.dir names; without that setting only a local master has a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="keepwell-tables-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/keepwell-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, written to the folder (a new one if none is given) and read back."""
    path = folder or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
