"""Session helpers shared by every operator: tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose row count was measured may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "rulesieve", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests, the bench and the command line use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(MAP_PARTITIONS, str(partitions))
        .getOrCreate()
    )


def own_folder() -> str:
    """This process's checkpoint folder for a local session, removed when the process ends."""
    path = Path(tempfile.gettempdir(), f"rulesieve-checkpoints-{os.getpid()}")
    if not path.exists():
        path.mkdir(parents=True)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path.as_uri()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine that names none gets a folder of its own; a cluster's must name one
    that all its executors share.
    """
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or own_folder())
        set_already = sc._jsc.sc().getCheckpointDir()
    return set_already.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def broadcast_up_to(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the measured row count allows it; otherwise the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def trimmed(column):
    """Strip all leading and trailing Unicode white space, tabs and line ends included."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def hash_sample(df: DataFrame, key: str, columns: list[str], rows: int) -> list[tuple]:
    """About ``rows`` rows, at most that many, chosen by hash of their key; for fitting on a bounded sample.

    The share taken follows from the table's row count; where keys repeat so often that it holds too
    few rows, it is doubled until it holds enough or is the whole table. A table with rows never gives
    an empty sample.
    """
    told = df.select(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1_000_003)).alias("h"), *columns)
    count = told.count()
    share = 1.2 * rows / max(1, count)
    while True:
        some = told.where(F.col("h") < int(share * 1_000_003) + 1) if share < 1 else told
        got = [tuple(r)[1:] for r in some.limit(2 * rows).collect()]
        if share >= 1 or len(got) >= min(rows, count) // 2:
            return sorted(got, key=lambda r: crc32(repr(r).encode()))[:rows]
        share *= 2


#: Session parameter: partitions that costly maps are spread over. Unset, as on a cluster, inputs are read in their own splits and not shuffled.
MAP_PARTITIONS = "spark.rulesieve.mapPartitions"


def spread(df: DataFrame) -> DataFrame:
    """The frame over as many partitions as the session parameter asks for; for small tables that come in one split."""
    told = df.sparkSession.conf.get(MAP_PARTITIONS, "")
    return df.repartition(int(told)) if told and not df.isStreaming else df
