"""Review of a change: the symbols it touches, each with what depends on it, ranked by risk. All symbols are handled together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.locate import symbols_in_ranges
from graphloom.operators.lookup import resolve
from graphloom.operators.neighbors import call_contract, callees, callers, columns_of, references_to
from graphloom.session import few


def changed_symbols(graph: PropertyGraph, hunks: DataFrame | None, symbols: DataFrame | None) -> DataFrame:
    """``(symbol)``: ids of the symbols named, or touched by hunks ``(file, start, end)``; names are resolved."""
    parts = []
    if hunks is not None:
        parts.append(symbols_in_ranges(graph, hunks).select(F.col("symbol").alias("input")))
    if symbols is not None:
        parts.append(symbols.select(F.col("symbol").alias("input")))
    if not parts:
        raise ValueError("hunks or symbols are needed")
    asked = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return resolve(graph, asked.distinct()).select(F.col("id").alias("symbol")).distinct()


def unresolved_hunks(graph: PropertyGraph, hunks: DataFrame) -> DataFrame:
    """Hunks that touch no symbol."""
    return hunks.select("file", "start", "end").distinct().join(symbols_in_ranges(graph, hunks), ["file", "start", "end"], "left_anti")


def dossier(graph: PropertyGraph, symbols: DataFrame) -> DataFrame:
    """``(symbol, kind, n_callers, n_callees, n_contract, n_external, n_references, reads, writes, score, risk)``.

    score: callers, twice the references from outside the core, rows of the call contract, and one for touching columns.
    """
    asked = few(symbols.select("symbol").distinct())
    kinds = graph.nodes.select(F.col("id").alias("symbol"), "kind")
    none = F.expr("cast(array() as array<string>)")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.join(asked, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias(name))

    refs = references_to(graph, asked).groupBy("symbol").agg(F.count("*").alias("n_references"), F.count_if(F.col("root") != "core").alias("n_external"))
    own = columns_of(graph).join(asked, "symbol", "left_semi")
    out = asked.join(kinds, "symbol", "left")
    for part in (counted(callers(graph), "n_callers"), counted(callees(graph), "n_callees"), counted(call_contract(graph, asked), "n_contract"), refs, own):
        out = out.join(part, "symbol", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_callers", "n_callees", "n_contract", "n_external", "n_references")}
    function = F.col("kind") == "function"
    n["n_callees"] = F.when(function, n["n_callees"]).otherwise(0).cast("long")
    touched = {c: F.coalesce(F.when(function, F.col(c)), none) for c in ("reads", "writes")}
    score = n["n_callers"] + 2 * n["n_external"] + n["n_contract"] + F.when(F.size(touched["reads"]) + F.size(touched["writes"]) > 0, 1).otherwise(0)
    out = out.select("symbol", "kind", *[v.alias(k) for k, v in n.items()], *[v.alias(k) for k, v in touched.items()], score.cast("long").alias("score"))
    return out.withColumn("risk", F.when((F.col("n_external") > 0) | (F.col("score") >= 5), "high").when(F.col("score") >= 2, "medium").otherwise("low"))


def review(graph: PropertyGraph, hunks: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """The dossiers of a change set; a report orders them by score, highest first, then symbol."""
    return dossier(graph, changed_symbols(graph, hunks, symbols))


def summary(dossiers: DataFrame) -> DataFrame:
    """``(risk, n, n_references, n_external)`` of dossiers."""
    return dossiers.groupBy("risk").agg(F.count("*").alias("n"), F.sum("n_references").alias("n_references"), F.sum("n_external").alias("n_external"))
