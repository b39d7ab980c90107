"""Session-level helpers: table loading, checkpoints in the shared folder, stable plan sizes."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A folder that is set already, or named in ``spark.checkpoint.dir``, is used as it is (on a
    cluster it is shared by all executors). Where neither exists a local session gets a temporary
    one; on a cluster that is an error, since a machine-local folder would not be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="unifold-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written files.

    Survives the loss of any executor: the files are in the shared folder, unlike a local
    checkpoint, whose only copy is on the executor that computed it. Once they are written, the
    files of the frames in ``instead_of``, which nothing must need any more, are deleted. So are the
    shuffle files that ``df`` was made from; a frame that shares its plan shuffles for itself.

    A checkpointed frame keeps the size estimate of the plan it came from. In a loop of joins the
    estimates multiply every round, until the planner computes with numbers of millions of digits;
    so the frame is made anew from the checkpointed rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # counts for frames made from here on
    try:
        saved = df.select("*").checkpoint(eager=True)._jdf
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    fresh = DataFrame(spark._jsparkSession.internalCreateDataFrame(saved.queryExecution().toRdd(), saved.schema(), False), spark)
    written = saved.logicalPlan().rdd().getCheckpointFile()
    fresh._checkpoint_file = written.get() if written.isDefined() else None
    for old in instead_of:
        path = getattr(old, "_checkpoint_file", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            old._checkpoint_file = None
    return fresh
