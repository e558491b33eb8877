"""Text, document and file databases: texts, their chunks and their vectors as tables, with search over them.

Every database is immutable: a change gives a new one. ``save`` writes Parquet tables with a small JSON description beside them.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quant as Q
from ..functions.text import context_line, split_text
from ..functions.vec import normalize
from ..plans.shared import small, written
from ..sources import files, snapshots
from . import index as I
from . import knn
from .aggregates import centroids
from .embed import Embedder, HashEmbedder, given_once, pooled


def _queries(spark: SparkSession, embedder: Embedder, query) -> DataFrame:
    """(qid, vec) of a text, a list of texts, a vector, or a DataFrame (qid, text) or (qid, vec)."""
    if isinstance(query, DataFrame):
        return query.select("qid", "vec") if "vec" in query.columns else query.select("qid", embedder.column("text").alias("vec"))
    if isinstance(query, str):
        query = [query]
    if query and isinstance(query[0], (int, float)):
        return spark.createDataFrame([(0, [float(x) for x in query])], "qid int, vec array<double>")
    return spark.createDataFrame(list(enumerate(query)), "qid int, text string").select("qid", embedder.column("text").alias("vec"))


def _engine(query) -> str:
    return "arrow" if isinstance(query, DataFrame) else "sql"


@dataclass(frozen=True)
class TextDB:
    """Rows (label, grp, pos, text, vec); ``empty`` only if there are none."""

    rows: DataFrame
    embedder: Embedder = field(default_factory=HashEmbedder)
    spec: Q.QuantSpec = Q.FLOAT
    empty: bool = False

    @classmethod
    def create(cls, spark: SparkSession, embedder: Embedder | None = None, spec: Q.QuantSpec = Q.FLOAT, label: str = "string", group: str = "string") -> TextDB:
        vec = "array<int>" if spec.quantized else "array<double>"
        return cls(spark.createDataFrame([], f"label {label}, grp {group}, pos long, text string, vec {vec}"), embedder or HashEmbedder(), spec, True)

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str, name_col: str = "title", text_col: str = "text", max_rows: int | None = None, **options) -> TextDB:
        return cls.create(spark, **options).add(_named(files.read_jsonl(spark, path, f"{name_col} string, {text_col} string", max_rows), name_col, text_col))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, name_col: str = "title", text_col: str = "text", max_rows: int | None = None, **options) -> TextDB:
        return cls.create(spark, **options).add(_named(files.read_csv(spark, path, max_rows=max_rows), name_col, text_col))

    @classmethod
    def from_batches(cls, spark: SparkSession, batches, **options) -> TextDB:
        """From an iterable of lists of (label, text), or of DataFrames (label, text, grp, ord): one upsert of all, in which a later batch wins.

        Batches that are lists are written to the shared folder as they come, so the plan doesn't grow with their number.
        """
        return cls.create(spark, **options).add(gather_batches(spark, batches))

    @classmethod
    def merge(cls, shards: list[TextDB]) -> TextDB:
        """Text databases in order: of a label that several have the last one's row counts, at the first one's place; groups are kept."""
        packed = [s.rows.select("label", "grp", "pos", F.struct("text", "vec").alias("vec")) for s in shards]
        return replace(shards[0], rows=I.merge(packed).select("label", "grp", "pos", "vec.text", "vec.vec"), empty=False)

    def add(self, rows: DataFrame) -> TextDB:
        """``rows(label, text, grp, ord)``: of a label given twice the last row counts, at the first place; known labels are overwritten.

        Into an empty database, labels given once are numbered by themselves and then joined, so texts are embedded where they are read.
        """
        kinds = dict(self.rows.dtypes)
        if self.empty and dict(rows.dtypes)["label"] == kinds["label"] and given_once(rows, "label", "ord"):
            places = I.with_positions(rows.select("label", "ord"), ["ord", "label"]).select("label", "pos")
            vec = Q.quantize(self.embedder.column("text"), self.spec).cast(kinds["vec"])
            embedded = rows.select("label", F.col("grp").cast(kinds["grp"]).alias("grp"), "text", vec.alias("vec"))
            return replace(self, rows=embedded.join(small(places), "label").select("label", "grp", "pos", "text", "vec"), empty=False)
        once = rows.groupBy("label").agg(F.max_by(F.struct("text", "grp"), "ord").alias("v"), F.min("ord").alias("ord")).select("label", "v.text", "v.grp", "ord")
        embedded = once.withColumn("vec", Q.quantize(self.embedder.column("text"), self.spec))
        packed = embedded.select("label", F.col("grp").cast(dict(self.rows.dtypes)["grp"]).alias("grp"), "ord", F.struct("text", F.col("vec").cast(dict(self.rows.dtypes)["vec"]).alias("vec")).alias("vec"))
        old = self.rows.select("label", "grp", "pos", F.struct("text", "vec").alias("vec"))
        merged = I.upsert(old, packed)
        return replace(self, rows=merged.select("label", "grp", "pos", "vec.text", "vec.vec"), empty=False)

    def remove(self, labels: list | None = None, where: Column | None = None, strict: bool = False) -> TextDB:
        gone = None if labels is None else self.rows.sparkSession.createDataFrame([(x,) for x in labels], f"label {dict(self.rows.dtypes)['label']}")
        rows = self.rows
        if strict and gone is not None:
            rows = I._require(rows, gone.join(self.rows, "label", "left_anti").select("label"), "no such label")
        return replace(self, rows=I.delete(rows, gone, where))

    def clear(self) -> TextDB:
        return replace(self, rows=I.clear(self.rows), empty=True)

    def count(self) -> int:
        return self.rows.count()

    def text(self, requested: DataFrame) -> DataFrame:
        """(ord, label, text) of ``requested(ord, label)``; a missing label raises."""
        return I.get(self.rows.select("label", F.col("text").alias("vec")), requested).withColumnRenamed("vec", "text")

    def vectors(self, requested: DataFrame) -> DataFrame:
        return I.get(self.rows, requested).withColumn("vec", Q.dequantize("vec", self.spec))

    def similarity(self, query, groups: list | None = None) -> DataFrame:
        return knn.similarity(_queries(self.rows.sparkSession, self.embedder, query), self.rows, groups, self.spec)

    def search(self, query, groups: list | None = None, top_k: int = 10, cutoff: float | None = None, engine: str | None = None) -> DataFrame:
        """(qid, rank, label, sim), best first; similarities must be strictly above ``cutoff``. A table of queries takes the Arrow engine unless told otherwise."""
        return knn.topk(_queries(self.rows.sparkSession, self.embedder, query), self.rows, top_k, groups, cutoff, engine or _engine(query), self.spec)

    def context(self, query, **options) -> DataFrame:
        """(qid, context): ``label: text`` of the matches, best first, with a blank line between."""
        return context(self.search(query, **options), self.rows)

    def save(self, path: str) -> None:
        snapshots.save(path, {"rows": self.rows}, {"embedder": self.embedder.name, "spec": self.spec.to_json()})

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> TextDB:
        tables, about = snapshots.load(spark, path, ["rows"])
        embedder = embedder or HashEmbedder()
        _same_embedder(about, embedder)
        return cls(tables["rows"], embedder, Q.QuantSpec.from_json(about["spec"]))


def gather_batches(spark: SparkSession, batches) -> DataFrame:
    """(label, text, grp, ord, batch) of batches in turn: ord runs through all of them."""
    out = None
    for i, batch in enumerate(batches):
        rows = batch if isinstance(batch, DataFrame) else spark.createDataFrame([(x, t, None, k) for k, (x, t) in enumerate(batch)], "label string, text string, grp string, ord long")
        rows, _ = written(rows.select("label", "text", "grp", F.struct(F.lit(i).alias("batch"), F.col("ord").cast("long").alias("row")).alias("ord"), F.lit(i).alias("batch")), "batch")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "label string, text string, grp string, ord struct<batch:int,row:bigint>, batch int") if out is None else out


def ingestion_counts(gathered: DataFrame) -> DataFrame:
    """(batch, rows, total): rows of each batch, and of all up to it."""
    each = gathered.groupBy("batch").agg(F.count("*").alias("rows"))
    return each.withColumn("total", F.sum("rows").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _named(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(name_col).alias("label"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("grp"), F.monotonically_increasing_id().alias("ord"))


def _same_embedder(about: dict, embedder: Embedder) -> None:
    if about["embedder"] != embedder.name:
        warnings.warn(f"saved with embedder {about['embedder']!r}, loaded with {embedder.name!r}", stacklevel=3)


def context(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, context) from matches (qid, rank, label): texts are joined to the narrow ranking last."""
    lines = matches.select("qid", "rank", "label").join(texts.select("label", "text"), "label").select("qid", "rank", context_line("label", "text").alias("line"))
    return lines.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n\n").alias("context"))


Splitter = Callable[[Column], Column]


def chunk(docs: DataFrame, delim: str | None | Splitter = "\n", min_len: int = 1, max_len: int | None = None) -> DataFrame:
    """(doc, chunk_no, text) of ``docs(doc, text)``; documents without a part that is long enough vanish.

    ``delim`` is a regular expression, or a function of the text column that gives an array of texts, a Pandas UDF for one; lengths then don't matter.
    """
    parts = delim(F.col("text")) if callable(delim) else split_text("text", delim, min_len, max_len)
    return docs.filter("text is not null").select("doc", F.posexplode(parts).alias("chunk_no", "text"))


def rebuild(chunks: DataFrame, docs: DataFrame | None = None, separator: str = "\n\n") -> DataFrame:
    """(doc, text): chunks joined in order, of the documents in ``docs(doc)`` or of all."""
    if docs is not None:
        chunks = chunks.join(docs.select("doc"), "doc", "left_semi")
    return chunks.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]), separator).alias("text"))


def two_stage(queries: DataFrame, docs: DataFrame, chunks: DataFrame, top_d: int | None = 25, k: int = 10, cutoff: float | None = None, spec: Q.QuantSpec = Q.FLOAT) -> DataFrame:
    """Top k chunks (label, grp, pos, vec) of each query among those of its ``top_d`` best documents (label, pos, vec), or of all for None.

    A few queries are joined with their documents' chunks; of more the pairs are not rows: see :func:`vecloom.operators.knn.group_topk`.
    """
    if top_d is None:
        return knn.topk(queries, chunks, k, None, cutoff, "arrow", spec)
    best = knn.topk(queries, docs.withColumn("grp", F.lit(None).cast("string")), top_d, engine="arrow").select("qid", F.col("label").alias("grp"))
    best, _ = written(best, "best")
    if queries.limit(knn.SQL_QUERIES + 1).count() > knn.SQL_QUERIES:
        scored = knn.group_topk(best.join(queries.select("qid", "vec"), "qid"), chunks, k, spec)
        return knn.ranked(scored, k, cutoff).select("qid", "rank", "label", "sim")
    asked = knn.few_vectors(best.join(queries.select("qid", F.col("vec").alias("qvec")), "qid"), "qvec")
    scored = chunks.join(asked, "grp").select("qid", "label", "pos", Q.quantized_dot("vec", "qvec", spec).alias("sim"))
    return knn.ranked(scored, k, cutoff).select("qid", "rank", "label", "sim")


@dataclass(frozen=True)
class DocumentDB:
    """Chunks (doc, chunk_no, pos, text, vec) and documents (doc, vec), the vector a document's centroid; ``empty`` only if there are none."""

    chunks: DataFrame
    docs: DataFrame
    embedder: Embedder = field(default_factory=HashEmbedder)
    spec: Q.QuantSpec = Q.FLOAT
    delim: str | None | Splitter = "\n"
    min_len: int = 1
    max_len: int | None = None
    empty: bool = False

    @classmethod
    def create(cls, spark: SparkSession, embedder: Embedder | None = None, spec: Q.QuantSpec = Q.FLOAT, doc: str = "string", **splitting) -> DocumentDB:
        vec = "array<int>" if spec.quantized else "array<double>"
        return cls(spark.createDataFrame([], f"doc {doc}, chunk_no int, text string, vec {vec}"), spark.createDataFrame([], f"doc {doc}, vec array<double>"), embedder or HashEmbedder(), spec, empty=True, **splitting)

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str, name_col: str = "title", text_col: str = "text", max_rows: int | None = None, **options) -> DocumentDB:
        named = _named(files.read_jsonl(spark, path, f"{name_col} string, {text_col} string", max_rows), name_col, text_col)
        return cls.create(spark, **options).add(named.withColumnRenamed("label", "doc"))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, name_col: str = "title", text_col: str = "text", max_rows: int | None = None, **options) -> DocumentDB:
        named = _named(files.read_csv(spark, path, max_rows=max_rows), name_col, text_col)
        return cls.create(spark, **options).add(named.withColumnRenamed("label", "doc"))

    def add(self, docs: DataFrame, replace_all: bool = True) -> DocumentDB:
        """``docs(doc, text, ord)``: the last text of a name counts. Its old chunks go, or with ``replace_all=False`` only those of the same number."""
        once = docs.select("doc", "text") if given_once(docs, "doc", "ord") else docs.groupBy("doc").agg(F.max_by("text", "ord").alias("text"))
        fresh = chunk(once, self.delim, self.min_len, self.max_len)
        vec = Q.quantize(self.embedder.column("text"), self.spec).cast(dict(self.chunks.dtypes)["vec"])
        new = fresh.select("doc", "chunk_no", "text", vec.alias("vec"))
        vectors = self._centroids(once)
        if self.empty and dict(once.dtypes)["doc"] == dict(self.chunks.dtypes)["doc"]:
            return replace(self, chunks=new, docs=vectors, empty=False)
        names = once.filter("text is not null").select("doc")
        kept = self.chunks.join(names if replace_all else new.select("doc", "chunk_no"), ["doc"] if replace_all else ["doc", "chunk_no"], "left_anti")
        old = self.docs.join(names if replace_all else vectors.select("doc"), "doc", "left_anti")
        return replace(self, chunks=kept.select(self.chunks.columns).unionByName(new), docs=old.select("doc", "vec").unionByName(vectors), empty=False)

    def _centroids(self, once: DataFrame) -> DataFrame:
        """(doc, vec) of ``once(doc, text)``: tasks bring a document's chunks together, if the embedder lets them."""
        if not hasattr(self.embedder, "encoder"):
            fresh = chunk(once, self.delim, self.min_len, self.max_len)
            return centroids(fresh.select("doc", self.embedder.column("text").alias("vec")), ["doc"])
        numbered = once.select(F.struct("doc", F.monotonically_increasing_id().alias("row")).alias("doc"), "text")
        parts = chunk(numbered, self.delim, self.min_len, self.max_len).select(F.col("doc.doc").alias("key"), F.col("doc.row").alias("row"), F.col("text").alias("part"))
        return pooled(parts, self.embedder, once=True).select(F.col("key").alias("doc"), normalize("vec").alias("vec"))

    def remove(self, names: list | DataFrame) -> DocumentDB:
        """Without the documents in a list of names or in ``names(doc)``; unknown ones don't matter."""
        gone = names if isinstance(names, DataFrame) else self.docs.sparkSession.createDataFrame([(n,) for n in names], f"doc {dict(self.docs.dtypes)['doc']}")
        gone = small(gone.select("doc"))
        return replace(self, chunks=self.chunks.join(gone, "doc", "left_anti").select(self.chunks.columns), docs=self.docs.join(gone, "doc", "left_anti").select("doc", "vec"))

    def clear(self) -> DocumentDB:
        return replace(self, chunks=I.clear(self.chunks), docs=I.clear(self.docs), empty=True)

    def get(self, names: list | DataFrame) -> DataFrame:
        """(ord, doc, text) of a list of names, numbered as given, or of ``names(ord, doc)``."""
        asked = names if isinstance(names, DataFrame) else self.docs.sparkSession.createDataFrame(list(enumerate(names)), f"ord int, doc {dict(self.docs.dtypes)['doc']}")
        return asked.join(rebuild(self.chunks, asked), "doc").select("ord", "doc", "text")

    def _doc_index(self) -> DataFrame:
        return self.docs.select(F.col("doc").alias("label"), F.lit(None).cast("string").alias("grp"), F.xxhash64("doc").alias("pos"), "vec")

    def _chunk_index(self) -> DataFrame:
        return self.chunks.select(F.struct("doc", "chunk_no").alias("label"), F.col("doc").alias("grp"), F.xxhash64("doc", "chunk_no").alias("pos"), "vec")

    def search_docs(self, query, top_k: int = 25) -> DataFrame:
        return knn.topk(_queries(self.docs.sparkSession, self.embedder, query), self._doc_index(), top_k, engine=_engine(query))

    def search_chunks(self, query, top_d: int | None = None, top_k: int = 10, cutoff: float | None = None) -> DataFrame:
        """(qid, rank, label, sim) of chunks; with ``top_d`` only those of the best documents are compared."""
        q = _queries(self.docs.sparkSession, self.embedder, query)
        if top_d is None:
            return knn.topk(q, self._chunk_index(), top_k, None, cutoff, _engine(query), self.spec)
        return two_stage(q, self._doc_index(), self._chunk_index(), top_d, top_k, cutoff, self.spec)

    def context(self, query, **options) -> DataFrame:
        return context(self.search_chunks(query, **options), self.chunks.select(F.struct("doc", "chunk_no").alias("label"), "text"))

    def save(self, path: str) -> None:
        if callable(self.delim):
            raise ValueError("a database with a splitter function can't be saved")
        about = {"embedder": self.embedder.name, "spec": self.spec.to_json(), "splitting": json.dumps([self.delim, self.min_len, self.max_len])}
        snapshots.save(path, {"chunks": self.chunks, "docs": self.docs}, about)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> DocumentDB:
        tables, about = snapshots.load(spark, path, ["chunks", "docs"])
        embedder = embedder or HashEmbedder()
        _same_embedder(about, embedder)
        return cls(tables["chunks"], tables["docs"], embedder, Q.QuantSpec.from_json(about["spec"]), *json.loads(about["splitting"]))


@dataclass(frozen=True)
class FilesDB:
    """A folder's text files as a :class:`DocumentDB`, with the times (name, mtime) at which they were read."""

    db: DocumentDB
    times: DataFrame
    root: str
    pattern: str = "*"

    @classmethod
    def create(cls, spark: SparkSession, root: str, pattern: str = "*", **options) -> FilesDB:
        empty = spark.createDataFrame([], "name string, mtime timestamp")
        return cls(DocumentDB.create(spark, **options), empty, root, pattern).reindex()

    def listing(self) -> DataFrame:
        return files.list_files(self.db.docs.sparkSession, self.root, self.pattern)

    def reindex(self, names: DataFrame | None = None) -> FilesDB:
        """Read all files again, or those in ``names(name)``; files that can't be read as text have no document."""
        found = files.read_documents(self.db.docs.sparkSession, self.root, self.pattern)
        if names is not None:
            found = found.join(names, "name", "left_semi")
        base = self.db.clear() if names is None else self.db
        docs = found.filter("text is not null").select(F.col("name").alias("doc"), "text", F.lit(0).alias("ord"))
        times = found.select("name", "mtime")
        kept = times if names is None else self.times.join(names, "name", "left_anti").select("name", "mtime").unionByName(times)
        return replace(self, db=base.add(docs), times=kept)

    def changed(self) -> DataFrame:
        """(name) of the files that are new or newer than when they were read."""
        return changed(self.listing(), self.times)

    def refresh(self, drop_missing: bool = False) -> FilesDB:
        out = self.reindex(self.changed())
        if drop_missing:
            gone, _ = written(self.times.join(self.listing(), "name", "left_anti").select("name"), "missing")
            out = replace(out, db=out.db.remove(gone.withColumnRenamed("name", "doc")), times=out.times.join(gone, "name", "left_anti"))
        return out

    def save(self, path: str) -> None:
        self.db.save(path)
        snapshots.save(f"{path}/files", {"times": self.times}, {"root": self.root, "pattern": self.pattern})

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> FilesDB:
        tables, about = snapshots.load(spark, f"{path}/files", ["times"])
        return cls(DocumentDB.load(spark, path, embedder), tables["times"], about["root"], about["pattern"])


def changed(listing: DataFrame, times: DataFrame) -> DataFrame:
    """(name) of rows of ``listing(name, mtime)`` that ``times`` lacks or has with an earlier mtime."""
    seen = times.select("name", F.col("mtime").alias("_seen"))
    return listing.join(seen, "name", "left").filter(F.col("_seen").isNull() | (F.col("mtime") > F.col("_seen"))).select("name")
