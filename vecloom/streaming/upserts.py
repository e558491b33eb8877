"""Structured Streaming: incremental upserts, file refresh, and sliding-window usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


#: Parts of a state, by hash of the key: a micro-batch rewrites only those that it touches.
BUCKETS = 64


def _parts(spark: SparkSession, path: str) -> dict[int, dict[int, str]]:
    """Folder of each bucket in each whole version: {bucket: {version: path}}."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, dict[int, str]] = {}
    if not system.exists(root):
        return out
    for s in system.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            for b in system.listStatus(s.getPath()):
                part = b.getPath().getName()
                if part.startswith("_bucket="):
                    out.setdefault(int(part.partition("=")[2]), {})[int(name[1:])] = f"{path}/{name}/{part}"
    return out


def latest_version(spark: SparkSession, path: str) -> int:
    """Highest batch id whose rows are wholly written, or -1."""
    return max((v for versions in _parts(spark, path).values() for v in versions), default=-1)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The state: each bucket as its latest version has it."""
    latest = [versions[max(versions)] for versions in _parts(spark, path).values()]
    return spark.read.parquet(*latest) if latest else None


def _prune(spark: SparkSession, path: str, before: int) -> None:
    """Delete the parts of a bucket that a later version up to ``before`` has replaced."""
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for versions in _parts(spark, path).values():
        done = sorted(v for v in versions if v <= before)
        for v in done[:-1]:
            system.delete(jvm.org.apache.hadoop.fs.Path(versions[v]), True)


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep the row of highest ``order`` for each key in a state at ``path``, in ``buckets`` parts by hash of the key.

    A micro-batch is merged with the latest earlier versions of the buckets that it touches, and only these are written, as a version of its own; so running a batch
    again gives the same. Parts that no batch can need again, those replaced before the last batch, are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        parts = _parts(spark, path)
        old = [parts[b][max(v for v in parts[b] if v < batch_id)] for b in touched if any(v < batch_id for v in parts.get(b, {}))]
        every = batch
        if old:
            every = spark.read.parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).unionByName(batch)
        best = every.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
        best.select("_bucket", key, *[F.col(f"r.{c}").alias(c) for c in rest]).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{batch_id}")
        _prune(spark, path, batch_id - 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Changes(StatefulProcessor):
    """Gives a file's row when it is new or newer than any seen before."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("mtime", "mtime timestamp")

    def handleInputRows(self, key, rows, timerValues):
        before = self.seen.get()[0] if self.seen.exists() else None
        latest = max(t for frame in rows for t in frame["mtime"])
        if before is None or latest.to_pydatetime() > before:
            self.seen.update((latest.to_pydatetime(),))
            yield pd.DataFrame({"name": [key[0]], "mtime": [latest]})

    def close(self) -> None:
        pass


def changed_stream(listing: DataFrame) -> DataFrame:
    """(name, mtime) of the rows of a stream (name, mtime) that are new or newer than the name's rows in all batches before; state by name.

    Needs the RocksDB state store, ``spark.sql.streaming.stateStore.providerClass``.
    """
    return listing.groupBy("name").transformWithStateInPandas(_Changes(), "name string, mtime timestamp", "Update", "None")


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, form: str = "parquet") -> DataFrame:
    """Files of a folder as micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def document_stream(spark: SparkSession, root: str, files_per_batch: int = 100, pattern: str = "*") -> DataFrame:
    """(name, mtime, text) of new files below a folder."""
    from ..functions.text import relative_path
    from ..sources.files import document_text

    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(root)
    return rows.select(relative_path("path", root).alias("name"), F.col("modificationTime").alias("mtime"), document_text("path", "content").alias("text"))


def usage_stream(log: DataFrame, ts: str, by: str, tokens: str, span: str = "70 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Requests and tokens by key in sliding windows, for logs whose rows come at most ``late`` late."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, span, slide), by).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens")).select("window.start", "window.end", by, "requests", "tokens")
