"""The graph: two DataFrames with fixed schemas.

``nodes`` are keyed by a dotted id, ``edges`` are typed and may dangle, repeat, and carry evidence in ``extras``. Keys of ``extras``
that the schema doesn't know are kept in its ``other`` map, as JSON text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut

SCHEMA_VERSION = "0.9"
KINDS = ("module", "class", "function", "attribute", "doc", "column")
#: Edges that say who depends on whom.
IMPACT_TYPES = ("calls", "references", "inherits", "imports", "decorated_by")

NODE_EXTRAS = (
    "struct<root:string,annotation:string,params:array<struct<name:string,type:string>>,returns:string,"
    "calls:struct<out:bigint,resolved:bigint,external:bigint,unresolved:bigint,dynamic:bigint>,"
    "control:struct<branches:bigint,loops:bigint,try:boolean,generator:boolean,async:boolean>,"
    "is_dataclass:boolean,registry:struct<decorator:string,key:string>,key:string,subscripted:boolean,other:map<string,string>>"
)
EDGE_EXTRAS = (
    "struct<as:string,public:boolean,external:boolean,resolution:string,callsites:bigint,posargs:array<int>,kwargs:array<string>,"
    "splat:boolean,via:string,access:string,other:map<string,string>>"
)
NODES = (
    "id string not null, kind string not null, file string, lineno int, endlineno int, signature string, docstring string, "
    f"visibility string, decorators array<string>, is_deprecated boolean, extras {NODE_EXTRAS}"
)
EDGES = f"type string not null, source string not null, target string not null, ord bigint, extras {EDGE_EXTRAS}"


@functools.cache
def schema(ddl: str) -> T.StructType:
    """The schema that NODES or EDGES describes; a session must be running."""
    return T.StructType.fromDDL(ddl)


DEFAULTS = {"visibility": "'public'", "is_deprecated": "false", "decorators": "cast(array() as array<string>)"}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the schema's columns, missing ones null or, in nodes, at their defaults. Fields of extras may be missing too."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema(ddl).fields:
        kind = f.dataType.simpleString()
        if f.name == "extras":
            inner = {g.name for g in have["extras"].fields} if "extras" in have else set()
            fields = [f"'{g.name}', cast({f'extras.`{g.name}`' if g.name in inner else 'null'} as {g.dataType.simpleString()})" for g in f.dataType.fields]
            value = f"named_struct({', '.join(fields)})"
        else:
            value = f"cast({f'`{f.name}`' if f.name in have else 'null'} as {kind})"
            value = f"coalesce({value}, {DEFAULTS[f.name]})" if f.name in DEFAULTS else value
        out.append(f"{value} as `{f.name}`")
    return df.selectExpr(*out)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class PropertyGraph:
    """nodes and edges are DataFrames. A graph whose edges are stored or made by type takes ``by_type``, a function for each type; then
    ``of`` touches only those asked for, and ``edges`` is their union. nodes may be a function, called when they are first needed."""

    def __init__(self, target: str, nodes: DataFrame | Callable[[], DataFrame], edges: DataFrame | None = None, by_type: dict[str, Callable[[], DataFrame]] | None = None) -> None:
        if (edges is None) == (by_type is None):
            raise ValueError("a graph has either edges or by_type")
        self.target, self._nodes, self._edges = target, nodes, edges
        self._by_type = None if by_type is None else {k: functools.cache(f) for k, f in by_type.items()}

    @property
    def nodes(self) -> DataFrame:
        if not isinstance(self._nodes, DataFrame) and callable(self._nodes):
            self._nodes = self._nodes()
        return self._nodes

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = union([f() for f in self._by_type.values()])
        return self._edges

    def of(self, *types: str) -> DataFrame:
        """Edges of the given types; a filter on ``type`` alone, which reaches the scan."""
        if self._by_type is None:
            return self.edges.where(F.col("type").isin(*types))
        own = [f for t, f in self._by_type.items() if t in types]
        return union([f() for f in own]) if own else self.edges.limit(0)

    def pairs(self, kind: str) -> DataFrame:
        """Distinct (source, target) of one type: the simple directed graph of that type."""
        return self.of(kind).select("source", "target").distinct()

    def roots(self) -> DataFrame:
        """(id, root) of every node."""
        return self.nodes.select("id", F.coalesce("extras.root", F.lit("core")).alias("root"))

    def cached(self) -> PropertyGraph:
        return PropertyGraph(self.target, self.nodes.cache(), self.edges.cache())


def short(c: Column | str) -> Column:
    """The last dotted segment of an id."""
    return F.substring_index(F.col(c) if isinstance(c, str) else c, ".", -1)


def parent(c: Column | str) -> Column:
    """The id without its last segment; an id of one segment is its own parent."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\.[^.]*$", "")


def within(member: Column | str, of: Column | str) -> Column:
    """Whether an id is the other one or lies under it. Not LIKE, in which an underscore is a wildcard."""
    m, o = (F.col(x) if isinstance(x, str) else x for x in (member, of))
    return (m == o) | m.startswith(F.concat(o, F.lit(".")))


def ancestry(c: Column | str) -> Column:
    """An id and all its dotted prefixes, as an array: a prefix join becomes an equi-join with its elements."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def with_root(df: DataFrame, graph: PropertyGraph, node: str, name: str = "root") -> DataFrame:
    """Adds the provenance root of a node column; nodes that aren't in the graph count as core."""
    roots = graph.roots().select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return df.join(roots, F.col(node) == F.col("_id"), "left").withColumn(name, F.coalesce("_root", F.lit("core"))).drop("_id", "_root")


def canonical_order(edges: DataFrame) -> DataFrame:
    """Edges with ``ord``: their place by type, source, target, then as they were.

    Ranges of that order are numbered each on its own; to each is added how many edges the ranges before it have. So no task sorts
    all edges of a type.
    """
    keys = ["type", "source", "target", "ord"]
    ranged = cut(edges.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return numbered.join(before, "_range").withColumn("ord", F.col("_before") + F.col("_k")).drop("_range", "_before", "_k").select(*edges.columns)
