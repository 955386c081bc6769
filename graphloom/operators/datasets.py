"""Labelled benchmark datasets: filtering, grouping, pairing, merging, counting, judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import parsing, text
from graphloom.staging import dealt, materialize


# ---------------------------------------------------------------- fix commits

def usable_fixes(rows: DataFrame, least_score: int = 4) -> DataFrame:
    """Coerced rows that are Python, no tests, scored well enough, from a readable commit URL, and really changed."""
    before, after = F.trim("func_before"), F.trim("func_after")
    out = rows.withColumn("commit", parsing.commit_url(F.trim("commit_url")))
    return out.filter((F.lower("extension") == "py") & ~F.col("is_test") & (F.col("vulnerability_score") >= least_score) & F.col("commit").isNotNull() & (before != "") & (after != "") & (before != after))


def coerce_fixes(raw: DataFrame) -> DataFrame:
    """Stringly rows with typed ``vulnerability_score``, ``is_test`` and ``cwe_ids``; other nulls become empty."""
    strings = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("func_before", "func_after", "commit_url", "file_name", "cve_id", "extension", "commit_msg")}
    return raw.withColumns(strings | {"vulnerability_score": parsing.to_int(F.col("vulnerability_score")), "is_test": parsing.to_bool(F.col("is_test")), "cwe_ids": parsing.cwe_list(F.col("cwe_id").cast("string"))})


def group_commits(rows: DataFrame, ord_column: str = "ord") -> DataFrame:
    """One row a commit with its rows in input order, commits in the order first seen."""
    body = F.struct(F.col(ord_column).alias("ord"), *[c for c in rows.columns if c not in ("commit", ord_column)])
    grouped = rows.groupBy("commit.repo_url", "commit.hash").agg(F.min(ord_column).alias("first"), F.array_sort(F.collect_list(body)).alias("entries"))
    return grouped


# ---------------------------------------------------------------- CVE-style tables

def cve_rows(fixes: DataFrame, file_change: DataFrame, cve: DataFrame, cwe: DataFrame) -> DataFrame:
    """Changed Python files of each fix with what is known of its CVE; several CWEs give several rows."""
    changed = file_change.filter((F.col("programming_language") == "Python") & F.col("diff_parsed").isNotNull())
    return fixes.join(changed, "hash").join(cve, "cve_id", "left").join(cwe, "cve_id", "left")


def diff_lines(column: Column, *names: str) -> Column:
    """Line numbers above 0 of ``deleted`` or ``added`` in a diff written as JSON or as a Python literal; of several names, a struct.

    A diff is read once, as JSON first, which is the faster: what reads as both gives the same numbers.
    """
    from pyspark.sql.functions import pandas_udf

    def read(values):
        import ast
        import json

        import pandas as pd

        def one(v):
            if v is None or not v.strip():
                return [None] * len(names)
            for parse in (json.loads, ast.literal_eval):
                try:
                    got = parse(v.strip())
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(got, dict):
                    return [numbers(got.get(key)) for key in names]
            return [None] * len(names)

        def numbers(chunks):
            lines = [str(c[0]).strip() for c in chunks if isinstance(c, (list, tuple)) and c] if isinstance(chunks, list) else []
            return [int(x) for x in lines if x.lstrip("+-").isdigit() and int(x) > 0]

        return pd.DataFrame([one(v) for v in values], columns=list(names))

    pd = __import__("pandas")
    read.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    found = pandas_udf(read, ", ".join(f"`{n}` array<int>" for n in names))(column)
    return found if len(names) > 1 else found[names[0]]


def cve_entries(rows: DataFrame) -> DataFrame:
    """``cve_id, repo_url, hash, is_vulnerable, description, cwe_id, severity, files``, ``files`` an array of path and spans.

    The vulnerable side has the deleted lines of the old path, the fixed side the added lines of the new one.
    """
    from graphloom.operators import spans

    keys = ["cve_id", "repo_url", "hash", "is_vulnerable"]
    rest = [c for c in ("cwe_id", "cvss3_base_severity", "severity", "description", "ord") if c in rows.columns]
    # A diff is read once for both sides and all that follows, in all tasks; runs and files are groups of their dealt rows.
    read = dealt(rows, *keys[:3]).withColumn("_lines", diff_lines(F.col("diff_parsed"), "deleted", "added"))
    side = lambda vulnerable, key, *order: F.struct(F.lit(vulnerable).alias("is_vulnerable"), parsing.first_text(*[F.col(c) for c in order]).alias("file_path"), F.col("_lines")[key].alias("lines"))
    both = F.array(side(True, "deleted", "old_path", "new_path", "filename"), side(False, "added", "new_path", "old_path", "filename"))
    known = read.select(*keys[:3], *rest, F.explode(both).alias("_s")).select(*keys[:3], *rest, "_s.*").filter("file_path is not null and size(lines) > 0")
    known = materialize(known, "changed")
    runs = spans.islands(dealt(known, *keys).select(*keys, "file_path", F.explode("lines").alias("line")), [*keys, "file_path"])
    files = runs.groupBy(*keys, "file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("spans"))
    files = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("file_path", "spans"))).alias("files"))
    cwe, sev = parsing.cwe_number(F.col("cwe_id")), parsing.severity(F.col("cvss3_base_severity"), F.col("severity"))
    about = parsing.first_text(F.col("description"))
    named = dealt(known.select(*keys, *rest), *keys).groupBy(*keys).agg(*[F.min_by(v, F.when(v.isNotNull(), F.col("ord"))).alias(n) for n, v in (("description", about), ("cwe_id", cwe), ("severity", sev))])
    return named.join(files, keys)


# ---------------------------------------------------------------- pairs and samples

def locate(files: DataFrame, needles: DataFrame, keys: tuple[str, ...] = ("file_path",), how: str = "inner") -> DataFrame:
    """``needles`` (``keys``, ``code``) with ``start_line, end_line`` of their first hit in ``files`` (``keys``, ``content``).

    Lines are compared right-trimmed, then with white space collapsed, then dedented; blank lines do not count. With ``how`` as
    ``left``, needles without a file stay, found nowhere.
    """
    from pyspark.sql.functions import pandas_udf

    import pandas as pd

    def find(content: pd.Series, code: pd.Series) -> pd.DataFrame:
        hits = [find_lines(a, b) or (None, None) for a, b in zip(content, code, strict=True)]
        return pd.DataFrame({name: pd.array([h[k] for h in hits], dtype="Int32") for k, name in enumerate(("start_line", "end_line"))})

    find.__annotations__ = {"content": pd.Series, "code": pd.Series, "return": pd.DataFrame}
    hit = pandas_udf(find, "start_line int, end_line int")(F.col("content"), F.col("code"))
    return needles.join(files.select(*keys, text.decoded(files).alias("content")), list(keys), how).withColumn("_hit", hit).select(*needles.columns, "_hit.*")


def find_lines(content: str | None, code: str | None) -> tuple[int, int] | None:
    import textwrap

    if not content or not code:
        return None
    squeeze = lambda s: " ".join(s.split())
    lines = content.splitlines()
    for needle, shape in ((code, str.rstrip), (code, squeeze), (textwrap.dedent, squeeze)):
        want = [shape(x) for x in (needle(code) if callable(needle) else needle).splitlines() if x.strip()]
        have = [shape(x) for x in lines]
        kept, numbers = [x for x in have if x], [i for i, x in enumerate(have, 1) if x]
        at, last = -1, len(kept) - len(want) + 1
        while want and last > at + 1:
            try:
                at = kept.index(want[0], at + 1, last)
            except ValueError:
                break
            if kept[at : at + len(want)] == want:
                return numbers[at], numbers[at + len(want) - 1]
    return None


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``_k``, 1, 2, 3 ... by ``order``: ranges are numbered apart and shifted by the counts before them."""
    dealt = materialize(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # a row a range
    within = Window.partitionBy("_range").orderBy(order)
    return dealt.withColumn("_rn", F.row_number().over(within)).join(shifts, "_range").withColumn("_k", F.col("_rn") + F.col("_shift")).drop("_range", "_rn", "_shift")


def number_samples(pairs: DataFrame, prefix: str, limit: int | None = None, order: str = "ord") -> DataFrame:
    """A vulnerable and a fixed sample of each accepted pair, ``prefix-1`` with ``prefix-2`` and so on.

    Ranks come from the pairs' own order; a limit takes whole pairs, so that an odd one is rounded down.
    """
    ranked = _numbered(pairs, order)
    ranked = ranked.filter(F.col("_k") <= limit // 2) if limit is not None else ranked
    both = F.explode(F.array(F.struct(F.lit(1).alias("label"), (2 * F.col("_k") - 1).alias("n")), F.struct(F.lit(0).alias("label"), (2 * F.col("_k")).alias("n"))))
    rows = ranked.withColumn("_s", both)
    return rows.select(F.concat(F.lit(prefix + "-"), F.col("_s.n").cast("string")).alias("sample_id"), F.col("_s.label").alias("label"), *[c for c in pairs.columns])


def fix_pairs(fixes: DataFrame, files: DataFrame, least_found: int = 1) -> DataFrame:
    """Two rows a commit, ``is_vulnerable`` and not, with what is common to its usable ``fixes`` and where their code stands.

    ``files`` are both checkouts, ``repo_url, hash, is_vulnerable, file_path, content``. A function counts if it is found on
    both sides; a commit without such a function has no pair. ``files`` of the result holds paths, first seen first, with spans
    in row order; ``func_code`` joins the functions' texts; the rest is that of the commit's first row.
    """
    side = F.explode(F.array(F.struct(F.lit(True).alias("is_vulnerable"), F.col("func_before").alias("code")), F.struct(F.lit(False).alias("is_vulnerable"), F.col("func_after").alias("code"))))
    commit = [F.col("commit.repo_url").alias("repo_url"), F.col("commit.hash").alias("hash")]
    head = ["commit_url", "file_name", "cve_id", "cwe_ids", "vulnerability_score", "commit_msg"]
    needles = fixes.select(*commit, "ord", F.col("file_name").alias("file_path"), F.struct(*head).alias("head"), side.alias("s")).select("repo_url", "hash", "ord", "file_path", "head", "s.*")
    side_keys = ["repo_url", "hash", "is_vulnerable"]
    # Functions found nowhere stay for what their commit's first row says.
    found = materialize(locate(files, needles, (*side_keys, "file_path"), "left"), "located")
    # A commit's rows are dealt to one task once: the window and both groupings need no further exchange.
    rows = dealt(found, "repo_url", "hash")
    of_row = Window.partitionBy("repo_url", "hash", "ord")
    hit, vulnerable = F.col("start_line").isNotNull(), F.col("is_vulnerable")
    rows = rows.withColumn("_both", F.bool_or(hit & vulnerable).over(of_row) & F.bool_or(hit & ~vulnerable).over(of_row))
    hits = F.collect_list(F.when(hit & F.col("_both"), F.struct("ord", "start_line", "end_line", "code")))
    per_file = rows.groupBy(*side_keys, "file_path").agg(F.min("ord").alias("ord"), F.min_by("head", "ord").alias("head"), hits.alias("hits"))
    spans = F.transform(F.sort_array("hits"), lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    in_file = F.struct(F.array_min(F.transform("hits", lambda x: x["ord"])).alias("first"), "file_path", spans.alias("spans"))
    codes = F.flatten(F.collect_list(F.transform("hits", lambda x: F.struct(x["ord"].alias("ord"), x["code"].alias("code")))))
    per_side = per_file.groupBy(*side_keys).agg(F.min("ord").alias("ord"), F.min_by("head", "ord").alias("head"), codes.alias("codes"), F.collect_list(F.when(F.size("hits") > 0, in_file)).alias("files"))
    paths = F.transform(F.sort_array("files"), lambda x: F.struct(x["file_path"].alias("file_path"), x["spans"].alias("spans")))
    code = F.array_join(F.transform(F.sort_array("codes"), lambda x: x["code"]), "\n")
    out = per_side.filter(F.size("codes") >= max(1, least_found)).select(*side_keys, "ord", "head.*", code.alias("func_code"), paths.alias("files"))
    return out.withColumn("cwe_id", F.get("cwe_ids", F.lit(0))).withColumn("pair_id", F.concat_ws("@", "repo_url", "hash"))


def pairs_within_budget(pairs: DataFrame, budget: int) -> DataFrame:
    """Pairs whose code, on both sides, is within the budget of tokens."""
    over = pairs.filter(text.tokens(F.col("func_code")) > budget).select("pair_id").distinct()
    return pairs.join(over, "pair_id", "left_anti")


def pairs_of_small_repositories(pairs: DataFrame, files: DataFrame, most_bytes: int) -> DataFrame:
    """Pairs both of whose checkouts hold at most ``most_bytes``, ``.git`` not counted; ``n_bytes`` where ``files`` have it, else of the contents."""
    counted = files.filter(~F.array_contains(F.split("file_path", "/"), ".git"))
    size = counted.groupBy("repo_url", "hash", "is_vulnerable").agg(F.sum("n_bytes" if "n_bytes" in files.columns else F.octet_length("content")).alias("n"))
    large = size.filter(F.col("n") > most_bytes).select("repo_url", "hash").distinct()
    return pairs.join(large, ["repo_url", "hash"], "left_anti")


def within_budget(rows: DataFrame, budget: int, column: str = "text") -> DataFrame:
    return rows.filter(text.tokens(F.col(column)) <= budget)


def complete_pairs(rows: DataFrame, n_strategies: int) -> DataFrame:
    """``pair_id, ord`` of the pairs for which every strategy gave text on both sides; ``rows`` hold ``full`` or not."""
    good = rows.groupBy("pair_id").agg(F.bool_and("full").alias("full"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    return good.filter(F.col("full") & (F.col("n") == 2 * n_strategies)).select("pair_id", "ord")


# ---------------------------------------------------------------- merging and counting

def check_same_kind(datasets: DataFrame) -> None:
    """Datasets of different names or task types must not be merged."""
    kinds = [c for c in ("name", "task_type") if c in datasets.columns]
    if kinds and len(datasets.select(*kinds).distinct().limit(2).collect()) > 1:
        raise ValueError("datasets differ in name or task_type")


def merge_datasets(datasets: DataFrame) -> DataFrame:
    """The first of the samples that share a CVE and label, or, without a CVE, are equal as a whole; in order ``ord``."""
    body = F.to_json(F.struct(*sorted(c for c in datasets.columns if c != "ord")))
    named = F.col("cve_id").isNotNull() & F.col("label").isNotNull()
    key = F.when(named, F.concat_ws("::", "cve_id", F.col("label").cast("string"))).otherwise(F.sha2(body.cast("binary"), 256))
    w = Window.partitionBy(key).orderBy("ord")
    return datasets.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def cwe_histogram(samples: DataFrame, column: str = "cwe_number") -> DataFrame:
    return samples.filter(F.col(column).isNotNull()).groupBy(F.concat(F.lit("CWE-"), F.col(column).cast("string")).alias("cwe")).agg(F.count(F.lit(1)).alias("n"))


def sum_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("cwe").agg(F.sum("n").alias("n"))


def accuracy(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``n, invalid, accuracy``: an unusable verdict (null ``predicted``) counts as wrong; no samples give 0."""
    right = F.sum((F.col("predicted") == F.col("label")).cast("int"))
    rows = judged.groupBy(*by) if by else judged
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted").isNull()).alias("invalid"), F.coalesce(right / F.count(F.lit(1)), F.lit(0.0)).alias("accuracy"))


SAMPLE = ("sample_id string, code string, label int, cve_id string, cwe_number int, severity string, description string, commit_url string, ord bigint")
