"""Files as a git repository lists them."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def git(root: str, *args: str) -> str | None:
    """What a git command prints; None if it fails or there is no git."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def top_level(path: str) -> str | None:
    out = git(path, "rev-parse", "--show-toplevel")
    return out.strip() if out else None


def tracked(spark: SparkSession, root: str, paths: tuple[str, ...] = ()) -> DataFrame:
    """``(path, blob)`` of the tracked files under some paths of a repository, all of them by default."""
    lines = (git(root, "ls-files", "-s", "--", *paths) or "").splitlines()
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    head, path = F.split("line", "\t")[0], F.split("line", "\t")[1]
    return rows.select(path.alias("path"), F.get(F.split(head, " +"), F.lit(1)).alias("blob")).where("path is not null")


def state(root: str, paths: tuple[str, ...] = ()) -> dict | None:
    """Commit, branch, and the files that differ from it; None outside of a repository."""
    commit = git(root, "rev-parse", "HEAD")
    if commit is None:
        return None
    changed = [x[3:] for x in (git(root, "status", "--porcelain", "--", *paths) or "").splitlines()]
    return {"commit": commit.strip(), "ref": (git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip(), "dirty": bool(changed), "dirty_files": sorted(changed)}
