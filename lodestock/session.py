"""Session helpers: settings that every operator relies on, and lineage cuts in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, which need it for every operator that runs Python. Not needed
    where it's installed on them or on their PYTHONPATH, nor twice."""
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="lodestock-ship-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "lodestock.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, the command line and the bench; clusters bring their own, and ship()."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lodestock")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=defaults | conf).getOrCreate()
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a private one only on a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or sc.getConf().get(CHECKPOINT_SETTING)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lodestock-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared checkpoint folder, so it survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, limit: int) -> bool:
    """Whether df has at most `limit` rows; reads no more than it must to tell."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only for a side shown to hold at most `limit` rows; beyond it Spark shuffles."""
    return F.broadcast(df) if fits(df, limit) else df
