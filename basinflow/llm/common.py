"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the byte set of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blank_if_null(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is
    unset (tests on one machine) a temporary folder of this process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.TemporaryDirectory(prefix="basinflow-")
        atexit.register(own.cleanup)
        base = f"file://{own.name}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage and survives
    lost executors, and what follows may read it several times."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the files behind a stage_table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: What operators keep in a Python worker from task to task, by owner: how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}
_owner = [""]


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _KEPT[owner] = drop


def make_room(owner: str = "") -> None:
    """At the start of a task in a Python worker: drops what other owners keep in it. Workers are
    used again by later stages, where the caches of all operators would add up."""
    if _owner[0] == owner:
        return
    _owner[0] = owner
    for name, drop in _KEPT.items():
        if name != owner:
            drop()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it gives memory back by itself, or keeps it


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bounds Arrow batches by bytes, so that very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
