"""Manifests of files by content: what was analysed, under which role, and what changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import ancestry


def lines_of_code(text: str) -> Column:
    """Line ends, and one more for an unfinished last line; 0 for an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))) + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)


def manifest(files: DataFrame) -> DataFrame:
    """``(path, role, ext, sha, bytes, loc)`` from ``(path, text[, role])``."""
    role = F.col("role") if "role" in files.columns else F.lit("core")
    name = F.substring_index("path", "/", -1)
    ext = F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("—")
    return files.select("path", role.alias("role"), ext.alias("ext"), F.sha2(F.col("text"), 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), lines_of_code("text").cast("long").alias("loc"))


def profile(files: DataFrame) -> DataFrame:
    """``(role, ext, files, bytes, loc)``: by role, by extension, and the total, the other columns being null."""
    sets = files.groupingSets([[F.col("role")], [F.col("ext")], []], F.col("role"), F.col("ext"))
    return sets.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("loc").alias("loc"))


def largest(files: DataFrame, limit: int = 10) -> DataFrame:
    return files.select("path", "bytes").orderBy(F.desc("bytes"), "path").limit(limit)


def scope_id(files: DataFrame) -> DataFrame:
    """One row ``(scope_id)``: the hash of all paths and content hashes, in order of path.

    The list is gathered in one task: a hash of a sequence has no partial form. It has some hundred bytes a file.
    """
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat(x["path"], F.lit("\t"), x["sha"])), "\n")
    return files.agg(F.concat(F.lit("sha256:"), F.sha2(lines, 256)).alias("scope_id"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)``: added, removed or changed, between two manifests."""
    a, b = old.select("path", F.col("sha").alias("old")), new.select("path", F.col("sha").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def assign_roles(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files ``(path)`` with the ``role`` of the longest root ``(prefix, role)`` that holds them; ``core`` without any."""
    dotted = F.translate("path", ".", "\u0001")
    prefixes = F.transform(ancestry(F.translate(dotted, "/", ".")), lambda x: F.translate(F.translate(x, ".", "/"), "\u0001", "."))
    named = files.select("path").distinct().withColumn("prefix", F.explode(prefixes)).join(roots, "prefix")
    best = named.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.length("prefix").desc(), "role"))).where("k = 1").select("path", "role")
    return files.drop("role").join(best, "path", "left").withColumn("role", F.coalesce("role", F.lit("core")))
