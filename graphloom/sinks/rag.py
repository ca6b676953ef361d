"""Retrieval chunks: one row, or one line of JSON, for every class and function, with its neighbourhood and a text for an embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, parent, short
from graphloom.operators import neighbors as N

SHOWN = 8


def _lists(graph: PropertyGraph, kind: str, key: str, value: str, name: str) -> DataFrame:
    """The other ends of edges, as a sorted list for each key; repeated edges go with the list, so edges are shuffled once, and not combined before."""
    own = graph.of(kind).select(F.col(key).alias("id"), value)
    return own.repartition("id").groupBy("id").agg(F.array_sort(F.collect_set(value)).alias(name))


def neighborhoods(graph: PropertyGraph, *more: Column | str) -> DataFrame:
    """``(id, bases, calls, called_by, implements, implementers, calls_via_methods, registered_as)``; empty lists are null. more: further columns of nodes."""
    via = N.class_outward_calls(graph).groupBy(F.col("class").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target", "via"))).alias("calls_via_methods"))
    out = graph.nodes.where(F.col("kind").isin("class", "function")).select("id", *more, F.col("extras.registry.key").alias("registered_as"))
    for part in (
        _lists(graph, "inherits", "source", "target", "bases"),
        _lists(graph, "calls", "source", "target", "calls"),
        _lists(graph, "calls", "target", "source", "called_by"),
        _lists(graph, "implements", "source", "target", "implements"),
        _lists(graph, "implements", "target", "source", "implementers"),
        via,
    ):
        out = out.join(part, "id", "left")
    return out


def _sentence(head: str, items: Column | str, tail: str = ".") -> Column:
    c = F.col(items) if isinstance(items, str) else items
    return F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", "), F.lit(tail)))


def _shorts(c: str, limit: int | None = None) -> Column:
    names = F.transform(F.col(c), lambda x: short(x))
    return names if limit is None else F.slice(names, 1, limit)


def chunks(graph: PropertyGraph) -> DataFrame:
    """The chunks, with their embedding ``text``."""
    own = ("kind", parent("id").alias("module"), "file", "lineno", "endlineno", "signature", "docstring", F.when(F.col("is_deprecated"), True).alias("deprecated"))
    first = F.trim(F.get(F.split(F.trim(F.col("docstring")), "\n"), F.lit(0)))
    seams = F.slice(F.transform("calls_via_methods", lambda x: F.concat(short(x["target"]), F.lit(" (via "), short(x["via"]), F.lit(")"))), 1, SHOWN)
    text = F.concat_ws(
        " ",
        F.concat("kind", F.lit(" "), short("id"), F.lit(" in "), "module", F.lit(".")),
        F.when(F.col("signature") != "", F.concat(F.lit("Signature: "), "signature", F.lit("."))),
        F.when(first != "", first),
        _sentence("Inherits: ", _shorts("bases")),
        _sentence("Calls: ", _shorts("calls", SHOWN)),
        _sentence("Called by: ", _shorts("called_by", SHOWN)),
        F.when(F.col("registered_as") != "", F.concat(F.lit("Registered as '"), "registered_as", F.lit("'."))),
        _sentence("Implements: ", _shorts("implements")),
        _sentence("Implemented by: ", _shorts("implementers", SHOWN)),
        _sentence("Methods call: ", seams),
    )
    return neighborhoods(graph, *own).withColumn("text", text)


def json_lines(graph: PropertyGraph) -> DataFrame:
    """``(id, value)``: each chunk as JSON without its empty fields."""
    own = chunks(graph)
    near = F.struct(*[c for c in ("bases", "calls", "called_by", "registered_as", "implements", "implementers", "calls_via_methods")])
    lines = F.when(F.col("lineno").isNotNull() | F.col("endlineno").isNotNull(), F.array("lineno", "endlineno"))
    return own.select("id", F.to_json(F.struct("id", "kind", "module", "file", lines.alias("lines"), "signature", "docstring", "deprecated", near.alias("neighbors"), "text"), {"ignoreNullFields": "true"}).alias("value"))


def write(graph: PropertyGraph, path: str) -> None:
    """One JSON object a line, in parts ordered by id."""
    json_lines(graph).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)
