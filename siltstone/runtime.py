"""Session helpers shared by every operator: reading tables, cutting lineage, spreading work."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, in a session started from any folder."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, whole."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names in ``spark.checkpoint.dir``.

    Only a session on one machine that names none, as in tests, gets a temporary folder of its own; on a cluster executors
    would each write to a disk of their own, so there a missing folder is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return named


def absolute(path: str) -> str:
    """A path with a scheme as it is, without a slash at its end; any other as an absolute one of this machine."""
    return path.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:/", path) else os.path.abspath(os.path.expanduser(path))


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read by several branches, survives the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(taken, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column in ``taken`` has the name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, spread over them before costly work on each row; any larger scan as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
