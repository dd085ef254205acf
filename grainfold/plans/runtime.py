"""Session-level helpers shared by all operators: table access, checkpoints, partition spread."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        place = tempfile.mkdtemp(prefix="grainfold-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        sc.setCheckpointDir(place)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the checkpoint folder and continue from it; smaller than a checkpoint and read column by column."""
    ensure_checkpoint_dir(df.sparkSession)
    place = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def bounded(df: DataFrame, most: int, held: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if it holds ``most`` at most; beyond that a join with it shuffles.

    Counted are rows, which must be of a fixed width, or what ``held`` says of each: of rows with arrays their elements, of
    rows with texts their length in units of 32 bytes. One job, so give it written data.
    """
    n = df.count() if held is None else df.agg(F.coalesce(F.sum(held), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if n <= most else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has cores.

    Only small inputs (one file, one row group) are affected; a large table has more splits than
    cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used (the optimizer doesn't merge through a generator)."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def ranges(df: DataFrame, rows_each: int, at_least: int = 1) -> int:
    """How many groups of about ``rows_each`` rows ``df`` needs; one count job."""
    return max(at_least, -(-df.count() // rows_each))
