"""From places in files to symbols, and from unified diffs to places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph

BAND = 256  # lines: definitions are looked up by the bands that they cover


def _definitions(graph: PropertyGraph) -> DataFrame:
    own = graph.nodes.where(F.col("kind").isin("function", "class", "attribute")).where("file is not null and lineno is not null")
    own = own.select("file", F.col("lineno").alias("lo"), F.coalesce(F.when(F.col("endlineno") != 0, F.col("endlineno")), "lineno").alias("hi"), F.col("id").alias("found"))
    # An equi-join on file and band; a file of a million lines is no single key.
    return own.withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / BAND), F.floor(F.greatest("lo", "hi") / BAND))))


def symbol_at(graph: PropertyGraph, places: DataFrame) -> DataFrame:
    """``(file, line, symbol)`` for places ``(file, line)``: the tightest definition around the line, else the file's module.

    Of definitions equally tight the one with the smaller id. Lines of unknown files are left out.
    """
    asked = places.select("file", "line").distinct().withColumn("band", F.floor(F.col("line") / BAND))
    inside = asked.join(_definitions(graph), ["file", "band"]).where("line between lo and hi")
    tight = inside.groupBy("file", "line").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("span"), "found")).alias("best"))
    modules = graph.nodes.where("kind = 'module' and file is not null").groupBy("file").agg(F.max("id").alias("module"))
    out = asked.drop("band").join(tight, ["file", "line"], "left").join(modules, "file", "left")
    return out.select("file", "line", F.coalesce("best.found", "module").alias("symbol")).where("symbol is not null")


def symbols_in_ranges(graph: PropertyGraph, ranges: DataFrame) -> DataFrame:
    """``(file, start, end, symbol)`` for ``(file, start, end)``: the distinct symbols of the lines of each range."""
    asked = ranges.select("file", "start", "end").distinct()
    lines = asked.where("end >= start").withColumn("line", F.explode(F.sequence("start", "end")))
    return lines.join(symbol_at(graph, lines), ["file", "line"]).select("file", "start", "end", "symbol").distinct()


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(diff, n, line)``: the lines of unified diffs, one file each, numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff"), "value")
    return whole.select("diff", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """``(diff, file, start, end)``: ranges of lines on the new side of unified diffs, from ``(diff, n, line)``.

    Deleted files have none; a hunk without new lines is anchored at its start.
    """
    header = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.trim(F.split(F.substring("line", 5, 1 << 20), "\t")[0]), "^b/", ""))
    upto = Window.partitionBy("diff").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.withColumn("file", F.last(header, ignorenulls=True).over(upto)).where(F.col("line").rlike(pattern))
    start = F.regexp_extract("line", pattern, 1).cast("int")
    count = F.regexp_extract("line", pattern, 2)
    size = F.when(count == "", 1).otherwise(F.when(count != "", count).cast("int"))
    return rows.where("file is not null and file <> '/dev/null'").select("diff", "file", start.alias("start"), F.greatest(start, start + size - 1).alias("end"))
