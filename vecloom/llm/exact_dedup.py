"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash of the groups that survive both.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Only narrow rows are shuffled: lengths and hashes, never
a text; and the full hash is computed only for rows whose length and prefix some other row shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import discard, join_groups, materialize, maybe_broadcast, one_row, seen

#: Characters of the normalised text that the second refinement hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Text without white space; null is empty. Plain replacements: each is one pass over the bytes."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _keys(docs: DataFrame) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with n (the normalised text), n_cp, norm_len and prefix_hash."""
    rows = docs.select("*", F.length(F.coalesce("text", F.lit(""))).alias("n_cp"), normalised(F.col("text")).alias("n"))
    return rows.select("*", F.length("n").alias("norm_len"), F.xxhash64(F.substring("n", 1, PREFIX)).alias("prefix_hash"))


def _candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_cp, norm_len, prefix_hash, text_sha256, c) of the rows whose length and prefix some other row shares, c of them alike."""
    norm = normalised(F.col("text"))
    narrow = materialize(docs.select(norm.alias("n")).select(F.length("n").alias("norm_len"), F.xxhash64(F.substring("n", 1, PREFIX)).alias("prefix_hash")), "lengths")
    lengths = narrow.groupBy("norm_len").agg(F.count("*").alias("c")).filter("c > 1").select("norm_len")
    alike = narrow.join(maybe_broadcast(lengths), "norm_len", "left_semi").groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("c")).filter("c > 1").select("norm_len", "prefix_hash")
    alike = materialize(alike, "alike")
    full = _keys(docs.select("doc_id", "text")).join(maybe_broadcast(alike), ["norm_len", "prefix_hash"], "left_semi")
    full = full.select("doc_id", "n_cp", "norm_len", "prefix_hash", F.sha2("n", 256).alias("text_sha256"))
    same = materialize(full.groupBy("norm_len", "text_sha256", "prefix_hash", "n_cp", "doc_id").agg(F.count("*").alias("c")), "candidates")
    discard(narrow, alike)
    return same


def _groups(same: DataFrame) -> DataFrame:
    # ~doc_id falls as doc_id rises, for all longs; the smallest long stands for null, so that it comes last
    order = F.coalesce(F.bitwise_not("doc_id"), F.lit(-(1 << 63)))
    groups = same.groupBy("norm_len", "text_sha256").agg(F.sum("c").alias("group_size"), F.max(F.struct(F.col("n_cp"), order.alias("o"), F.col("doc_id"), F.col("c"))).alias("top"))
    return groups.filter("group_size > 1").select("norm_len", "text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.n_cp").alias("keep_cp"), "group_size", F.col("top.c").alias("tied"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of two or more equal texts of ``docs(doc_id, text)``: (norm_len, text_sha256, keep_id, keep_cp, group_size, tied).

    ``keep_id`` is the doc_id of the row with the most code points (keep_cp) in the original text, then the smallest doc_id, null last; ``tied``
    counts the rows that have both, more than one only where rows repeat. Null texts count as empty; an empty table has no groups.
    """
    same = _candidates(docs)
    out = materialize(_groups(same), "groups", members=F.sum("group_size"))
    discard(same)
    return out


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``. Other columns are not looked at.

    A row without doc_id is kept where its whole group has none, or where its text is alone. Repeated rows are marked alike.
    """
    groups = exact_duplicates(docs.select("doc_id", "text"))
    n = F.col("_n")
    rows = docs.select("doc_id", normalised(F.col("text")).alias("_n")).select("doc_id", F.length(n).alias("norm_len"), F.sha2(n, 256).alias("text_sha256"))
    out = join_groups(rows, groups, ["norm_len", "text_sha256"], "group_size", seen(groups, "members"), "doc_id", "left")
    alone = F.col("group_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as given. Of wholly tied rows that with the least text, then the least rest, stays.

    Whole texts are hashed only where length and prefix are those of another row, and again only where a row with the same doc_id, length
    and prefix is to go. A null text counts as empty; null and repeated doc_ids are allowed; an empty table stays empty.
    """
    same = _candidates(docs.select("doc_id", "text"))
    groups = materialize(_groups(same), "groups", members=F.sum("group_size"))
    marked = join_groups(same, groups, ["norm_len", "text_sha256"], "group_size", seen(groups, "members"), "doc_id")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    key = ["n_cp", "norm_len", "prefix_hash"]
    gone = marked.filter(~stays | (F.col("c") > 1)).groupBy("doc_id", *key).agg(F.collect_set(F.when(~stays, F.col("text_sha256"))).alias("_gone"), F.collect_set(F.when(stays, F.col("text_sha256"))).alias("_tied"))
    gone = materialize(gone.withColumnRenamed("doc_id", "_id"), "gone", tied=F.sum(F.size("_tied")))
    discard(same, groups)
    inner = {c: f"_in_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    rows = _keys(docs.withColumnsRenamed(inner))
    rows = rows.join(maybe_broadcast(gone), [F.col("doc_id").eqNullSafe(F.col("_id")), *[rows[k] == gone[k] for k in key]], "left")
    sha = F.sha2("n", 256)
    back = [F.col("doc_id"), F.col("text"), *[F.col(v).alias(k) for k, v in inner.items()]]
    left = rows.filter(F.when(F.col("_gone").isNull(), True).otherwise(~F.array_contains("_gone", sha)))
    if not seen(gone, "tied"):
        return left.select(*back).select(docs.columns)
    tied = F.when(F.col("_gone").isNull(), False).otherwise(F.array_contains("_tied", sha))
    again = one_row(left.filter(tied).select(sha.alias("_sha"), F.struct(*back).alias("_r")), "_sha", [F.col("_r.text")])
    return left.filter(~tied).select(*back).unionByName(again.select("_r.*")).select(docs.columns)
