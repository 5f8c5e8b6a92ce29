"""Session helpers: checkpoint folder, settled tables, size-checked broadcast."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import ConfigurationError

# A table is broadcast only when it is known to have at most this many rows.
BROADCAST_ROWS = 200_000


def local_session(app: str = "scenefold", cores: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_scenefold_shipped", False):
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="scenefold-package-")) / root.name), "zip", root.parent, root.name
        )
        context.addPyFile(archive)
        context._scenefold_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="scenefold-checkpoint-")
    context.setCheckpointDir(configured)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage there.

    Iterative operators settle their state once per round so that a lost
    executor replays one round, not all of them, and so that values that depend
    on the physical layout (range bounds, row positions) are fixed for every
    later reader.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_bytes(df: DataFrame) -> int:
    """The bytes of the files that ``df`` reads, by the planner; 0 where it does not know them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if len(df.inputFiles()) else 0


def spread(df: DataFrame, *columns: str, table: DataFrame | None = None, share: int = 2 << 20) -> DataFrame:
    """Deal rows by columns to partitions whose number follows the bytes of ``table``, so that the rows of a task do not grow with it.

    ``share`` bytes by the planner are some 400,000 narrow rows; there are never fewer partitions than the session's.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, file_bytes(df if table is None else table) // share), *columns)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads at most ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting it; leave it to a shuffle beyond."""
    return F.broadcast(df) if has_at_most(df, rows) else df
