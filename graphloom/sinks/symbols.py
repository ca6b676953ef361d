"""A symbol index: stable descriptors of symbols, where they are defined, and how types relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, ancestry, parent, short
from graphloom.operators.neighbors import type_relations

SCHEME = "graphloom python"


def escaped(c: Column) -> Column:
    """A name as it is if it is simple, else in backticks, those inside doubled."""
    return F.when(c.rlike(r"^[A-Za-z0-9_+$]+$"), c).otherwise(F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`")))


def descriptors(graph: PropertyGraph) -> DataFrame:
    """``(id, descriptor)``: each segment of an id with the mark of its kind: ``/`` module, ``#`` class, ``().`` function, ``.`` attribute.

    An ancestor that is no node counts as a module, the last segment as an attribute.
    """
    mark = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("module", "/", "class", "#", "function", "().", "attribute", ".", "doc", "/", "column", "/")]), F.col("kind")), F.lit("/"))
    own = graph.nodes.select("id", F.concat(escaped(short("id")), mark).alias("d"), F.when(F.contains("id", F.lit(".")), parent("id")).alias("parent"))
    # What is above is written once for each parent, not for each of its children.
    parts = own.where("parent is not null").select("parent").distinct().select("parent", F.posexplode(ancestry("parent")).alias("i", "prefix"))
    known = own.join(parts.select(F.col("prefix").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("prefix"), F.col("d").alias("known"))
    one = F.coalesce("known", F.concat(escaped(short("prefix")), F.lit("/")))
    above = parts.join(known, "prefix", "left").groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("d")))), lambda x: x["d"]), "").alias("above"))
    return own.join(above, "parent", "left").select("id", F.concat(F.coalesce("above", F.lit("")), "d").alias("descriptor"))


def symbol_kind(graph: PropertyGraph) -> DataFrame:
    """``(id, symbol_kind)``: a function under a class is a Method, an attribute under one a Field."""
    classes = graph.nodes.where("kind = 'class'").select(F.col("id").alias("up"), F.lit(True).alias("in_class"))
    rows = graph.nodes.select("id", "kind", parent("id").alias("up")).join(classes, "up", "left")
    inside = F.coalesce("in_class", F.lit(False)) & (F.col("up") != F.col("id"))
    return rows.select("id", F.when(F.col("kind") == "module", "Module").when(F.col("kind") == "class", "Class").when(F.col("kind") == "function", F.when(inside, "Method").otherwise("Function")).when(F.col("kind") == "attribute", F.when(inside, "Field").otherwise("Variable")).otherwise("UnspecifiedKind").alias("symbol_kind"))


def index(graph: PropertyGraph, package: str | None = None, version: str = ".") -> DataFrame:
    """``(file, language, symbol, symbol_kind, start, end, test, documentation, relations)``: definitions that have a file; lines count from 0.

    end is null where a definition takes one line; relations list the descriptors of bases and protocols that are nodes.
    """
    own = graph.nodes.where(F.col("kind").isin("module", "class", "function", "attribute")).where("file is not null")
    own = own.select("id", "file", "docstring", F.coalesce(F.col("lineno") - 1, F.lit(0)).alias("start"), F.when(F.col("endlineno") != F.coalesce("lineno", F.lit(1)), F.col("endlineno") - 1).alias("end"), (F.coalesce("extras.root", F.lit("core")) == "tests").alias("test"))
    named = descriptors(graph)
    related = type_relations(graph).join(named.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("descriptor")).alias("relations"))
    out = own.join(named, "id").join(symbol_kind(graph), "id").join(related, "id", "left")
    return out.select("file", F.when(F.col("file").endswith(".py"), "Python").otherwise("").alias("language"), F.concat_ws(" ", F.lit(SCHEME), F.lit(package or graph.target), F.lit(version), "descriptor").alias("symbol"), "symbol_kind", "start", "end", "test", F.col("docstring").alias("documentation"), F.coalesce("relations", F.expr("cast(array() as array<string>)")).alias("relations"))


#: Numbers of the published index format.
KINDS = {"UnspecifiedKind": 0, "Class": 7, "Field": 15, "Function": 17, "Method": 26, "Module": 29, "Variable": 61}
DEFINITION, TEST, UTF8 = 1, 32, 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n) if n else b""


def _bytes(field: int, value: bytes | str) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _document(file: str, rows: list, prefix: str) -> bytes:
    occurrences, infos = [], []
    for r in sorted(rows, key=lambda r: r.symbol):
        place = _number(1, r.start)
        span = b"" if r.end is None else _bytes(11, _number(1, r.start) + _number(3, r.end))
        occurrences.append(_bytes(2, _bytes(2, r.symbol) + _number(3, DEFINITION | (TEST if r.test else 0)) + _bytes(8, place) + span))
        related = b"".join(_bytes(4, _bytes(1, prefix + d) + _number(3, 1)) for d in r.relations)
        infos.append(_bytes(3, _bytes(1, r.symbol) + (_bytes(3, r.documentation) if r.documentation else b"") + related + _number(5, KINDS[r.symbol_kind])))
    language = _bytes(4, rows[0].language) if rows[0].language else b""
    return _bytes(1, file) + b"".join(occurrences) + b"".join(infos) + language + _number(6, UTF8)


def write_index(graph: PropertyGraph, path: str, project_root: str, package: str | None = None, package_version: str = ".", version: str = "0.1") -> None:
    """The index as protocol buffers of the public code-intelligence format, one document at a time: the driver holds one file's symbols."""
    prefix = f"{SCHEME} {package or graph.target} {package_version} "
    tool = _bytes(1, "graphloom") + _bytes(2, version)
    with open(path, "wb") as out:
        out.write(_bytes(1, _bytes(2, tool) + _bytes(3, f"file://{project_root}") + _number(4, UTF8)))
        file, rows = None, []
        for r in index(graph, package, package_version).orderBy("file").toLocalIterator():
            if rows and r.file != file:
                out.write(_bytes(2, _document(file, rows, prefix)))
                rows = []
            file = r.file
            rows.append(r)
        if rows:
            out.write(_bytes(2, _document(file, rows, prefix)))
