"""Columns over text and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import model


def tokens(text: Column, least: int = 1) -> Column:
    """A third of the code points, at least ``least``."""
    return F.greatest(F.lit(least), F.floor(F.char_length(text) / 3)).cast("int")


def sanitize_line(text: Column) -> Column:
    """Cut at the first ``#``, then right-trimmed of all white space."""
    return F.regexp_replace(F.split_part(text, F.lit("#"), F.lit(1)), r"\s+$", "")


def contains_any(text: Column, hints: tuple[str, ...]) -> Column:
    """Whether the lower-cased text has any hint as a plain substring."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h.lower())) for h in hints], F.lit(False))


def generated(path: Column, snippet: Column) -> Column:
    """Generated by suffix, by a path segment, or by a marker in the first three lines."""
    low = F.lower(path)
    segment = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(s) for s in model.GENERATED_SEGMENTS]))
    header = F.array_join(F.slice(F.split(F.coalesce(snippet, F.lit("")), "\n"), 1, 3), "\n")
    return F.endswith(low, F.lit(model.GENERATED_SUFFIX)) | segment | contains_any(header, model.GENERATED_HEADERS)


def decoded(files: DataFrame, column: str = "content") -> Column:
    """A file's text; of bytes that are no UTF-8, one replacement character for each run that cannot be read."""
    return F.make_valid_utf8(F.col(column).cast("string")) if dict(files.dtypes)[column] == "binary" else F.col(column)


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def path_match(a: Column, b: Column) -> Column:
    """Equal, or the shorter path is the tail of the longer, by whole segments."""
    x, y = F.concat(F.lit("/"), F.ltrim(a, F.lit("/"))), F.concat(F.lit("/"), F.ltrim(b, F.lit("/")))
    return F.endswith(x, y) | F.endswith(y, x)


def module_score(a: Column, b: Column, full: float = 1.0, part: float = 0.5) -> Column:
    """``full`` for one directory, ``part`` for a common leading directory, else 0."""
    da, db = parent_dir(a), parent_dir(b)
    lead = (F.split_part(da, F.lit("/"), F.lit(1)) == F.split_part(db, F.lit("/"), F.lit(1))) & (da != "") & (db != "")
    return F.when(da == db, F.lit(full)).when(lead, F.lit(part)).otherwise(F.lit(0.0))


def module_name(path: Column, root: str = "") -> Column:
    """The dotted module of a root-relative ``.py`` path; a package for its ``__init__``."""
    rel = relative_path(path, root)
    return F.translate(F.regexp_replace(rel, r"(/__init__)?\.py$", ""), "/", ".")


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    p = F.regexp_replace(path, r"^(?:file:)?/*(?=/)", "")
    return F.when(F.startswith(p, F.lit(prefix)), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p) if root else p


def repo_dir_name(url: Column) -> Column:
    """A directory name from the path of a repository URL."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/?", ""), r"(\.git)?/*$", "")
    return F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "_")


def node_id(kind: Column, name: Column, path: Column, start_byte: Column) -> Column:
    """``kind:name@path:byte``; white space is collapsed and names above 256 code points end in a digest."""
    n = F.regexp_replace(F.trim(name), r"\s+", " ")
    short = F.when(F.char_length(n) > 256, F.concat(F.substring(n, 1, 246), F.lit("-"), F.substring(F.sha1(F.encode(n, "UTF-8")), 1, 8))).otherwise(n)
    return F.concat(F.lower(kind), F.lit(":"), short, F.lit("@"), path, F.lit(":"), start_byte.cast("string"))


def cache_key(parts: list[Column]) -> Column:
    return F.sha1(F.encode(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\u001f"), "UTF-8"))
