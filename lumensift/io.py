"""Table access and the few session facts that operators need."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lumensift_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lumensift-code-"), "lumensift.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("lumensift", os.path.relpath(full, home)))
    context.addPyFile(path)  # served by the driver; nothing is read from this folder by others
    context._lumensift_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root` (one Parquet file or folder)."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in spark.checkpoint.dir. Only where that is
    unset (tests on one machine) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = spark.conf.get("lumensift.test.dir", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="lumensift-")
        spark.conf.set("lumensift.test.dir", made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, with its lineage cut.

    Reliable checkpointing: the files survive the loss of an executor, so what
    reads them later never goes back to the steps before.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back.

    Against settle() it keeps columns apart, so that later reads prune them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables written() made in this application; to be called when the results that read them are stored. Their number."""
    jvm = spark._jvm
    for path in _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


_WRITTEN: list[str] = []
