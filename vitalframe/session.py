"""Session helpers: settings are read from the session; own values are set only where none are given."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows of a dimension table that is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def local_session(app: str = "vitalframe", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine, with a checkpoint folder that is removed at its end."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", _own_folder()).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="vitalframe-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a folder of this machine's is
    taken if driver and executors are one process (master local), as in tests; on a cluster that would lose the
    checkpoints, so it raises ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jsc = spark.sparkContext._jsc.sc()
    if named is None:
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a reliable checkpoint, so that a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_of(df: DataFrame, rows: int = BROADCAST_ROWS) -> list:
    """All rows of a dimension; one of more than ``rows`` rows raises ValueError, so that none is ever left out."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a dimension of more than {rows} rows: {df.columns}")
    return got


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows, else unchanged (a shuffle join follows)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df
