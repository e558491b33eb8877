"""Bounded samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import crc_mod


def training_texts(docs: DataFrame, labels: DataFrame, label: str, by: int, held_out: int, rows: int) -> list[tuple[str, object]]:
    """About ``rows`` (text, label) at most, spread over the label's values by hash of doc_id; in a fixed order.

    A doc_id with several labels has the least of them. Only rows whose crc32(doc_id as text) mod ``by`` is not ``held_out`` are taken. The ids are chosen first, from ``labels(doc_id, label)``;
    the texts of these few are then read by a broadcast join, whose size ``rows`` bounds.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", by) != held_out)).select("doc_id", F.col(label).alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    quota = rows / len(counts)
    small = sum(c for c in counts.values() if c <= quota)
    many = [k for k, c in counts.items() if c > quota]
    each = (rows - small) / len(many) if many else 0
    share = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(1.0 if c <= quota else each / c))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    ids = known.filter(draw < share[F.col("_label")]).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    found = docs.select("doc_id", "text").filter("doc_id is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "_label").toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [(r["text"] or "", r["_label"]) for r in found]
