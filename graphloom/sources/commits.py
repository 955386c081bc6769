"""Files of commits, out of the objects of local clones: no working copy is made, and a row a commit is dealt to the tasks.

Clones lie in one folder that all executors reach, each in a directory named after its repository (``repo_dir_name``). The
``git`` command reads their objects; contents come in batches of bounded bytes. What cannot be read gives an ``error`` row.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text

#: Bytes of files that a task reads at a time.
BATCH_BYTES = 16 << 20

FILES = "repo_url string, hash string, is_vulnerable boolean, file_path string, n_bytes long, content binary, error string"
_COLUMNS = [c.split()[0] for c in FILES.split(", ")]


class _Unreadable(Exception):
    pass


def _git(clone: str, *args: str, data: bytes | None = None) -> bytes:
    run = subprocess.run(["git", "-c", "safe.directory=*", "-C", clone, *args], input=data, capture_output=True, check=False)
    if run.returncode:
        raise _Unreadable(run.stderr.decode(errors="replace").strip().split("\n")[0] or f"git {args[0]} failed")
    return run.stdout


def _target(clone: str, fix: str, vulnerable: bool) -> str:
    """The fix itself, or its first parent."""
    if not re.fullmatch("[0-9a-fA-F]{4,64}", fix or ""):
        raise _Unreadable(f"{fix} is no commit id")
    found = _git(clone, "rev-list", "--parents", "-n", "1", fix).decode().split()
    if vulnerable and len(found) < 2:
        raise _Unreadable(f"{fix} has no parent")
    return found[1] if vulnerable else found[0]


def tree(clone: str, commit: str) -> list[tuple[str, str, int]]:
    """Path, object and bytes of each file of a commit."""
    out = []
    for entry in _git(clone, "ls-tree", "-r", "-z", "--long", commit).split(b"\0"):
        if entry:
            about, path = entry.split(b"\t", 1)
            _, kind, name, size = about.split()
            if kind == b"blob":  # a commit here is a submodule
                out.append((path.decode("utf-8", "replace"), name.decode(), int(size)))
    return out


def blobs(clone: str, wanted: list[tuple[str, str, int]]) -> Iterator[list[tuple[str, int, bytes]]]:
    """Path, bytes and content of files, in batches."""
    at = 0
    while at < len(wanted):
        end, size = at, 0
        while end < len(wanted) and (end == at or size + wanted[end][2] <= BATCH_BYTES):
            size += wanted[end][2]
            end += 1
        data, place, out = _git(clone, "cat-file", "--batch", data="\n".join(w[1] for w in wanted[at:end]).encode() + b"\n"), 0, []
        for path, _, n in wanted[at:end]:
            head = data.index(b"\n", place)
            out.append((path, n, data[head + 1 : head + 1 + n]))
            place = head + 2 + n
        yield out
        at = end


def files(commits: DataFrame, clones: str, suffix: str = ".py", sides: tuple[bool, ...] = (True, False), contents: bool = True) -> DataFrame:
    """``repo_url, hash, is_vulnerable, file_path, n_bytes, content, error`` of both sides of each row ``repo_url, hash`` of ``commits``.

    Every file is listed, with its size; contents are those of files that end in ``suffix``. The vulnerable side is the parent.
    """
    side = F.explode(F.array(*map(F.lit, sides)))
    rows = commits.select("repo_url", "hash").distinct().withColumn("is_vulnerable", side).withColumn("_dir", text.repo_dir_name(F.col("repo_url")))
    rows = rows.repartition(int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo_url", "hash", "is_vulnerable")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                key = (r.repo_url, r.hash, bool(r.is_vulnerable))
                try:
                    clone = os.path.join(clones, r.dir)
                    if not os.path.isdir(clone):
                        raise _Unreadable(f"no clone {r.dir}")
                    there = tree(clone, _target(clone, r.hash, r.is_vulnerable))
                    wanted = [x for x in there if contents and x[0].endswith(suffix)]
                    rest = [(*key, p, n, None, None) for p, _, n in there if not (contents and p.endswith(suffix))]
                    yield pd.DataFrame(rest, columns=_COLUMNS)
                    for part in blobs(clone, wanted):
                        yield pd.DataFrame([(*key, p, n, c, None) for p, n, c in part], columns=_COLUMNS)
                except _Unreadable as e:
                    yield pd.DataFrame([(*key, None, None, None, str(e))], columns=_COLUMNS).astype({"n_bytes": "Int64"})

    return rows.select("repo_url", "hash", "is_vulnerable", F.col("_dir").alias("dir")).mapInPandas(read, FILES)
