"""Tables written to the folder that all executors share, size-checked broadcasts, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch sent to Python, where the session sets none: texts and what is made of them are held a batch at a time.
ARROW_BYTES = 4 << 20
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_own_dir: str | None = None
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="vecloom-core-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        root = f"file://{_own_dir}"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, with its place."""
    path = f"{shared_dir(df.sparkSession)}/vecloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if ``df`` has at most ``limit`` rows; as it is, for a shuffle join, otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_batches(spark: SparkSession | None = None) -> None:
    """Arrow batches of at most ARROW_BYTES in the session, unless it has a setting of its own."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_ARROW_SETTING, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    small_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="vecloom-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "vecloom_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
