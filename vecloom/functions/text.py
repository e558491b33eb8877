"""Text functions: splitting into chunks, whitespace, paths, context lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import col

_BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
MIME = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "py": "text/x-python", "xml": "text/xml", "css": "text/css", "tsv": "text/tab-separated-values", "json": "application/json", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "doc": "application/msword", "js": "text/javascript", "sh": "application/x-sh", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/x-wav", "bin": "application/octet-stream", "so": "application/octet-stream", "exe": "application/octet-stream"}


def strip(c: str | Column) -> Column:
    """Without white space at both ends, any that Unicode knows; texts without any there are not searched."""
    p = col(c)
    ends = F.concat(F.substring(p, 1, 1), F.substring(p, -1, 1))
    return F.when(F.rlike(ends, F.lit(r"(?U)[\s\x1c-\x1f]")), F.regexp_replace(p, _BLANK, "")).otherwise(p)


def slices(c: str | Column, width: int) -> Column:
    """Cuts of ``width`` characters, the last one short; an empty text has none."""
    p = col(c)
    n = F.ceil(F.length(p) / width).cast("int")
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(p, i * width + 1, F.lit(width))))


def split_text(c: str | Column, delim: str | None = "\n", min_len: int = 1, max_len: int | None = None) -> Column:
    """Parts between matches of the regex ``delim``, stripped, shorter ones than ``min_len`` dropped, then cut to ``max_len``.

    Without a delimiter the whole text is one part, not stripped. Cuts are not filtered again.
    """
    t = F.coalesce(col(c), F.lit(""))
    parts = F.array(t) if delim is None else F.transform(F.split(t, delim, -1), strip)
    kept = F.filter(parts, lambda p: F.length(p) >= min_len)
    return kept if max_len is None else F.flatten(F.transform(kept, lambda p: slices(p, max_len)))


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def mime_type(path: str | Column) -> Column:
    """By extension alone; null if unknown."""
    pairs = [F.lit(x) for kv in MIME.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension(path))


def relative_path(path: str | Column, root: str) -> Column:
    plain = F.regexp_replace(col(path), "^file:/+", "/")
    return F.regexp_replace(plain, "^" + _quote(root.rstrip("/")) + "/", "")


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def run_name(c: str | Column) -> tuple[Column, Column, Column, Column]:
    """(org, model, max_len, quant) of ``org/model-maxlen-quant``: split at the first slash and the last two hyphens; no org is empty."""
    pattern = r"^(?:([^/]*)/)?(.*)-([^-]*)-([^-]*)$"
    return tuple(F.regexp_extract(col(c), pattern, k) for k in (1, 2, 3, 4))


def strip_prefix(c: str | Column, prefix: str = "##") -> Column:
    """A token without its continuation prefix."""
    return F.when(F.startswith(col(c), F.lit(prefix)), F.substring(col(c), len(prefix) + 1, 1 << 30)).otherwise(col(c))


def truncate(c: str | Column, n: int) -> Column:
    """The first ``n`` elements of an array."""
    return F.slice(col(c), 1, n)


def context_line(label: str | Column, text: str | Column) -> Column:
    return F.concat(col(label).cast("string"), F.lit(": "), col(text))


def hash_buckets(c: str | Column, dims: int) -> Column:
    """Feature buckets of a text's words (runs of letters, lower case): first byte of the md5, modulo ``dims``."""
    words = F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}]+", -1), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int") % dims)


def hash_embedding(c: str | Column, dims: int = 64) -> Column:
    """Unit vector of the buckets' counts; a text without words is zero."""
    from .vec import let, normalize

    counts = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(b, lambda x: x == d)).cast("double"))
    return normalize(let(hash_buckets(c, dims), counts))
