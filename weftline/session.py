"""Session, shared folder and the few helpers that every operator uses."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests, a laptop) makes a folder of its own; a cluster
    gets an error, as each executor would else keep its stages on its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)  # our own folder only; a cluster's stays
        spark.sparkContext.setCheckpointDir(root)
    return str(root).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", drop: tuple = (), count: str | None = None, sweep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, its
    lineage ends in files every executor can read, and a lost executor loses nothing.

    drop: frames materialized before that nothing needs any more once this one is written;
    their files are removed.  The others go when the application ends.  count: SQL condition;
    the rows that meet it are counted while they are written, see ``counted``.  sweep: the
    driver collects its garbage afterwards, which lets Spark remove the shuffle files that led here.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    seen = Observation() if count else None
    (df.observe(seen, F.count_if(F.expr(count)).alias("n")) if seen else df).write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stage_path, found._counted = path, seen and seen.get["n"]
    _stages.setdefault(spark.sparkContext.applicationId, set()).add(path)
    release(*drop)
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return found


def counted(frame: DataFrame) -> int:
    """What ``materialize`` counted for its frame."""
    return frame._counted


_stages: dict[str, set[str]] = {}


def release(*frames: DataFrame) -> None:
    """Remove the files of materialized frames; frames that are none of these are left alone."""
    for frame in frames:
        path = getattr(frame, "_stage_path", None)
        if path:
            _delete(frame.sparkSession, path)
            _stages.get(frame.sparkSession.sparkContext.applicationId, set()).discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _stages.pop(spark.sparkContext.applicationId, set()):
        try:
            _delete(spark, path)
        except Exception:  # the session is on its way down; what is left is temporary
            return


atexit.register(_clear)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted size allows it; else the frame as it is, for a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path of the driver's."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="weftline-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/weftline.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, f"weftline/{path.relative_to(package)}")
    context.addPyFile(f"{folder}/weftline.zip")


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named Parquet tables of a folder, in order; one frame if one name is given."""
    ship(spark)
    frames = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
    return frames[0] if len(frames) == 1 else frames
