"""Columns that take text apart: verdicts, CWE lists, commit URLs, stringly rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERDICT = "vulnerable string, severity string, description string, cwe_id string"


def to_int(c: Column) -> Column:
    """An integer as text, else 0 (``"3.0"`` is not one)."""
    s = F.trim(c.cast("string"))
    return F.coalesce(F.when(F.rlike(s, F.lit(r"^[+-]?[0-9]+$")), s.try_cast("int")), F.lit(0))


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def cwe_list(c: Column) -> Column:
    """All ``CWE-n`` in order without repeats; else all digits as one number; else none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?i)CWE-([0-9]+)"), 1), lambda x: x.try_cast("int")))
    digits = F.regexp_replace(c, "[^0-9]", "")
    none = F.array().cast("array<int>")
    return F.coalesce(F.when(F.size(found) > 0, found).when(digits != "", F.array(digits.try_cast("int"))).otherwise(none), none)


def cwe_number(c: Column) -> Column:
    """``CWE-n`` or ``n``; anything else is null."""
    s = F.regexp_replace(F.trim(c.cast("string")), "^CWE-", "")
    return F.when(F.rlike(s, F.lit("^[0-9]+$")), s.try_cast("int"))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def severity(*columns: Column) -> Column:
    return F.lower(first_text(*columns))


def commit_url(c: Column) -> Column:
    """``struct(repo_url, hash)`` of ``scheme://host/owner/name/commit/hash``; else null."""
    path = F.array_remove(F.split(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/"), "")
    n = F.size(path)
    repo = F.concat(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit("/"), F.array_join(F.slice(path, F.lit(1), F.greatest(n - 2, F.lit(0))), "/"))
    return F.when((n >= 4) & (F.get(path, n - 2) == "commit"), F.struct(repo.alias("repo_url"), F.get(path, n - 1).alias("hash")))


def _valid(raw: Column) -> Column:
    """A parsed object, if it says ``vulnerable`` as a boolean, 0 or 1."""
    v = F.from_json(raw, _VERDICT)
    return F.when(v["vulnerable"].isin("true", "false", "0", "1") & ~F.rlike(raw, F.lit(r'"vulnerable"\s*:\s*"')), v)


def _last_verdict(raws: Column) -> Column:
    return F.get(F.array_compact(F.transform(F.reverse(raws), _valid)), 0)


def review_verdict(response: Column) -> Column:
    """``struct(vulnerable, severity, description, cwe_id)`` from the last usable flat object in the last 500 characters.

    No usable object: not vulnerable, the rest null. Unknown severities and CWEs that are not whole numbers are null.
    """
    v = _last_verdict(F.regexp_extract_all(F.right(response, F.lit(500)), F.lit(r"(\{[^{}]*\})"), 1))
    level = F.upper(v["severity"])
    return F.struct(
        F.coalesce(v["vulnerable"].isin("true", "1"), F.lit(False)).alias("vulnerable"),
        F.when(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), level).alias("severity"),
        F.nullif(F.trim(v["description"]), F.lit("")).alias("description"),
        F.when(F.rlike(v["cwe_id"], F.lit("^[0-9]+$")), v["cwe_id"].try_cast("int")).alias("cwe_id"),
    )


def judge_verdict(response: Column) -> Column:
    """Whether the last usable object of the whole text says vulnerable; null if there is none."""
    v = _last_verdict(F.regexp_extract_all(response, F.lit(r"(?s)(\{.*?\})"), 1))
    return v["vulnerable"].isin("true", "1")
