"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(sc: SparkContext) -> None:
    """Gives the package to the executors' Python workers, once per application, whatever their search path is.

    The archive is made on the driver and sent to the executors by Spark itself.
    """
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    if here.is_dir():
        folder = tempfile.mkdtemp(prefix="paperloom-package-")
        tree = Path(folder, "tree", here.name)
        shutil.copytree(here, tree, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(folder, here.name)), "zip", root_dir=tree.parent))
        shutil.rmtree(tree.parent)
    _SHIPPED.add(sc.applicationId)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "paperloom") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAPERLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    ship_package(spark.sparkContext)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Bytes of a table in few files from which its rows are spread over the cores, and bytes a core up to which they are.
SPREAD_FROM, SPREAD_TO = 2 << 20, 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df`, spread over all cores if it's a small table in so few files that most cores would stay idle: a file's row
    group is one task's work. Larger tables and those in enough files are left as they are, without a shuffle."""
    sc = df.sparkSession.sparkContext
    files = df.inputFiles()
    if not files or len(files) > sc.defaultParallelism // 4:
        return df
    path = sc._jvm.org.apache.hadoop.fs.Path
    size = sum(path(f).getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path(f)).getLen() for f in files)
    return df.repartition(sc.defaultParallelism) if SPREAD_FROM <= size <= SPREAD_TO * sc.defaultParallelism else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in spark.checkpoint.dir. Where the session names none, a temporary
    folder is set on one machine; on a cluster, whose executors couldn't read it, that is refused."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def shared(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that it is computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
