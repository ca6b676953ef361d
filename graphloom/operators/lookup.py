"""Finding nodes: by name, by part of an id, by an id that is only nearly right, by type, by decorator.

Functions answer for all nodes at once, or for the ids or names in a DataFrame; one question is a filter on the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, parent, short, with_root
from graphloom.operators.neighbors import ancestors

#: Containers in a type that say nothing about what it holds.
TYPE_NOISE = ["Any", "Callable", "Dict", "Iterable", "List", "Mapping", "None", "Optional", "Sequence", "Set", "Tuple", "Type", "Union"]


def find(graph: PropertyGraph, name: str | None = None) -> DataFrame:
    """``(name, id, kind, file, lineno)``: nodes by their last segment."""
    out = graph.nodes.select(short("id").alias("name"), "id", "kind", "file", "lineno")
    return out if name is None else out.where(F.col("name") == name).orderBy("id")


def search(graph: PropertyGraph, term: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose id contains the term, whatever the case; shortest ids first."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = graph.nodes.where(F.lower("id").contains(term.lower()))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    return rows.select("id", "kind", "file", "lineno").orderBy(F.length("id"), "id").limit(limit)


def resolve(graph: PropertyGraph, requests: DataFrame) -> DataFrame:
    """``(input, id, ambiguous, alternatives)`` for the names and ids in the column ``input``; inputs without any match are left out.

    An id stands for itself. Else nodes with the same last segment compete: most path segments in common, then the shorter id, then
    the smaller. It is ambiguous if several share the most segments.
    """
    asked = requests.select("input").distinct()
    ids = graph.nodes.select("id")
    exact = asked.join(ids, F.col("input") == F.col("id")).select("input", "id", F.lit(False).alias("ambiguous"), F.expr("cast(array() as array<string>)").alias("alternatives"))
    rest = asked.join(ids, F.col("input") == F.col("id"), "left_anti").withColumn("name", short("input"))
    # All ids of a name are one row, in order: a row for each request and id, ranked by windows, would be sorted in a few tasks.
    split = F.split("id", r"\.").alias("parts")
    named = ids.select(short("id").alias("name"), F.struct("id", split).alias("c")).join(rest.select("name").distinct(), "name", "left_semi")
    alike = named.groupBy("name").agg(F.array_sort(F.collect_list("c")).alias("all"))
    shared = F.transform("all", lambda c: F.size(F.array_intersect(c["parts"], F.split("input", r"\."))))
    asked_of = rest.join(alike.hint("merge"), "name").select("input", F.col("all.id").alias("ids"), F.explode(F.array(shared)).alias("shared"))
    top = asked_of.select("input", "ids", "shared", F.explode(F.array(F.array_max("shared"))).alias("top"))
    # Ids are in order, so the first of the shortest is the smallest.
    best = F.array_min(F.filter(F.transform("ids", lambda x, i: F.when(F.get("shared", i) == F.col("top"), F.struct(F.length(x).alias("n"), i.alias("at")))), lambda x: x.isNotNull()))["at"]
    at = top.select("input", "ids", "shared", "top", F.explode(F.array(best)).alias("at"))
    chosen = at.select(
        "input",
        F.get("ids", F.col("at")).alias("id"),
        (F.size(F.filter("shared", lambda n: n == F.col("top"))) > 1).alias("ambiguous"),
        F.filter("ids", lambda x, i: i != F.col("at")).alias("alternatives"),
    )
    return exact.unionByName(chosen)


def where_defined(graph: PropertyGraph) -> DataFrame:
    """``(name, id)``: definitions of a name, under their own name or one they are exported by."""
    own = graph.nodes.select(short("id").alias("name"), "id")
    exported = graph.of("export").select(F.coalesce("extras.as", F.lit("")).alias("name"), F.col("target").alias("id"))
    return own.union(exported).distinct()


def impact_targets(graph: PropertyGraph, requests: DataFrame) -> DataFrame:
    """``(input, id)``: the nodes that a name or id stands for when asking for its impact.

    The first of these that has any: the id itself; all nodes of that name; the resolution of a re-export's id; exported names.
    """
    asked = requests.select("input").distinct()
    ids = graph.nodes.select("id")
    exact = asked.join(ids, F.col("input") == F.col("id")).select("input", "id", F.lit(1).alias("way"))
    named = asked.join(ids.withColumn("name", short("id")), F.col("input") == F.col("name")).select("input", "id", F.lit(2).alias("way"))
    resolved = resolve(graph, requests).select("input", "id", F.lit(3).alias("way"))
    exported = asked.join(where_defined(graph), F.col("input") == F.col("name")).select("input", "id", F.lit(4).alias("way"))
    ways = exact.union(named).union(resolved).union(exported)
    first = F.min("way").over(Window.partitionBy("input"))
    return ways.withColumn("first", first).where("way = first").select("input", "id").distinct()


def members(graph: PropertyGraph) -> DataFrame:
    """``(symbol, member)``: every node with itself and the nodes under it."""
    return ancestors(graph).select(F.explode("ups").alias("symbol"), F.col("target").alias("member"))


def decorated(graph: PropertyGraph, decorator: str | None = None) -> DataFrame:
    """``(source, decorator)`` of every decoration, or those by a decorator's path or last segment."""
    out = graph.of("decorated_by").select("source", F.col("target").alias("decorator"))
    return out if decorator is None else out.where((F.col("decorator") == decorator) | (short("decorator") == decorator)).orderBy("source")


def type_tokens(c: Column | str) -> Column:
    """The names in a type's text, without containers."""
    names = F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_except(names, F.array(*[F.lit(x) for x in TYPE_NOISE]))


def producers(graph: PropertyGraph) -> DataFrame:
    """``(type, id)``: functions whose return type mentions the type."""
    return graph.nodes.where("kind = 'function'").select(F.explode(type_tokens("extras.returns")).alias("type"), "id").distinct()


def consumers(graph: PropertyGraph) -> DataFrame:
    """``(type, id)``: functions with a parameter whose type mentions the type."""
    given = graph.nodes.where("kind = 'function'").select("id", F.explode("extras.params").alias("p"))
    return given.select(F.explode(type_tokens("p.type")).alias("type"), "id").distinct()


def columns(graph: PropertyGraph, everything: bool = False) -> DataFrame:
    """``(key)``: string keys; those ever used in a subscript, or all."""
    rows = graph.nodes.where("kind = 'column'")
    rows = rows if everything else rows.where(F.coalesce("extras.subscripted", F.lit(True)))
    return rows.select(F.coalesce("extras.key", F.regexp_replace("id", "^column:", "")).alias("key"))


def stats_kinds(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.groupBy("kind").agg(F.count("*").alias("n"))


def stats_edges(graph: PropertyGraph) -> DataFrame:
    """Edges are counted as they are, repeated ones too."""
    return graph.edges.groupBy("type").agg(F.count("*").alias("n"))


def first_line(c: str) -> Column:
    """The first line of a text that isn't blank, trimmed; null without any."""
    return F.get(F.filter(F.transform(F.split(F.col(c), "\n"), F.trim), lambda x: x != ""), F.lit(0))


def api_surface(graph: PropertyGraph) -> DataFrame:
    """``(module, id, kind, signature, summary, is_deprecated)``: public classes, functions and attributes directly in public modules."""
    public = graph.nodes.where("visibility = 'public'")
    modules = public.where("kind = 'module'").select(F.col("id").alias("module"))
    own = public.where(F.col("kind").isin("class", "function", "attribute")).withColumn("module", parent("id"))
    return own.join(modules, "module", "left_semi").select("module", "id", "kind", "signature", first_line("docstring").alias("summary"), "is_deprecated")


def public_symbols(graph: PropertyGraph) -> DataFrame:
    """``(module, id, kind)`` of the core root's public classes and functions, by parent."""
    rows = with_root(graph.nodes.where("visibility = 'public'").where(F.col("kind").isin("class", "function")), graph, "id")
    return rows.where("root = 'core'").select(parent("id").alias("module"), "id", "kind")
