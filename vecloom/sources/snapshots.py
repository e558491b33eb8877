"""Snapshots: named Parquet tables in one folder, and a JSON description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quant as Q


def save(path: str, tables: dict[str, DataFrame], about: dict) -> None:
    """Write each table, then the description, which so exists only beside whole tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(about | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, about


def table_or_path(spark: SparkSession, source: str | DataFrame, name: str = "rows") -> DataFrame:
    """A DataFrame as it is; a path as the snapshot's table."""
    return source if isinstance(source, DataFrame) else spark.read.parquet(f"{source}/{name}")


def extract_index(rows: DataFrame) -> DataFrame:
    """The vector index of a text database's rows."""
    return rows.select("label", "grp", "pos", "vec")


def save_index(path: str, index: DataFrame, spec: Q.QuantSpec = Q.FLOAT) -> None:
    """An index (label, grp, pos, vec) with how its vectors are stored, and its groups' numbers beside it."""
    from ..operators.index import group_ids

    save(path, {"index": index.select("label", "grp", "pos", "vec"), "groups": group_ids(index)}, {"spec": spec.to_json()})


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, Q.QuantSpec]:
    """(index, spec) of a saved index, or of the index inside a saved text or document database: whichever is at ``path``."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    spec = Q.QuantSpec.from_json(about["spec"])
    tables = set(about["tables"])
    if "index" in tables:
        return spark.read.parquet(f"{path}/index"), spec
    if "rows" in tables:
        return extract_index(spark.read.parquet(f"{path}/rows")), spec
    if "chunks" in tables:
        chunks = spark.read.parquet(f"{path}/chunks")
        return chunks.select(F.struct("doc", "chunk_no").alias("label"), F.col("doc").alias("grp"), F.xxhash64("doc", "chunk_no").alias("pos"), "vec"), spec
    raise ValueError(f"{path} holds no index")


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    """(grp, gid) of a saved index."""
    return spark.read.parquet(f"{path}/groups")
