"""Tables that several passes read: written once, as Parquet, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that setting only a local master has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="keepwell-shared-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/keepwell-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df, written below folder and read back: a lost executor costs no more than a re-read."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def equal(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition on columns of one name each side, nulls equal to nulls."""
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def in_sample(key: Column, size: int, rows: int | Column) -> Column:
    """Chooses about size of rows rows by the hash of key: the same ones in every run."""
    unit = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
    if isinstance(rows, Column):
        return unit < F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(float(size)) / F.greatest(rows, F.lit(1)))
    return unit < int(2 ** 40 * min(1.0, size / max(rows, 1)))


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables that no later pass reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in names:
        path = hadoop.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
