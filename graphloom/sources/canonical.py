"""The canonical JSON document of a graph, and Parquet as the working format."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import EDGE_EXTRAS, EDGES, NODE_EXTRAS, NODES, SCHEMA_VERSION, PropertyGraph, canonical_order, conform
from graphloom.session import cut

NODE_JSON = "id string, kind string, file string, lineno int, endlineno int, signature string, docstring string, visibility string, decorators array<string>, is_deprecated boolean, extras string"
EDGE_JSON = "type string, source string, target string, extras string"


def _extras(spec: str) -> tuple[str, list[str]]:
    """The struct's known fields as DDL, and their names."""
    fields = spec[len("struct<") : -1].rpartition(",other:")[0]
    names, depth, start = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            names.append(fields[start:i].partition(":")[0])
            start = i + 1
    return f"struct<{fields}>", names


def _parsed(df: DataFrame, spec: str) -> DataFrame:
    """The text column extras as a struct; keys that it doesn't know go to ``other``, as JSON text."""
    ddl, names = _extras(spec)
    known = F.from_json("extras", ddl)
    raw = F.from_json("extras", "map<string,string>")
    other = F.map_filter(raw, lambda k, v: ~k.isin(names))
    return df.withColumn("extras", F.struct(*[known[n].alias(n) for n in names], F.when(F.size(other) > 0, other).alias("other")))


def _rows(fields: str) -> str:
    return "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in (f.split(" ") for f in fields.split(", "))) + ">>"


def load(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from its document, whatever the name before ``_schema`` that its version goes by.

    Of nodes that share an id the last counts. Another major version is refused.
    """
    doc = cut(spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")))
    head = doc.select(F.get(F.map_values(F.map_filter("m", lambda k, v: k.endswith("_schema"))), F.lit(0)).alias("version"), F.element_at("m", "target").alias("target")).first()
    if head is None or head.target is None:
        raise ValueError(f"{path} holds no graph")
    if head.version is not None and head.version.split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"schema {head.version} can't be read, this is {SCHEMA_VERSION}")
    nodes = doc.select(F.posexplode(F.from_json(F.element_at("m", "nodes"), _rows(NODE_JSON))).alias("n", "r")).select("n", "r.*")
    last = nodes.groupBy("id").agg(F.max_by(F.struct(*[c for c in nodes.columns if c not in ("n", "id")]), "n").alias("r")).select("id", "r.*")
    edges = doc.select(F.posexplode(F.from_json(F.element_at("m", "edges"), _rows(EDGE_JSON))).alias("ord", "r")).select("ord", "r.*")
    return PropertyGraph(head.target, cut(conform(_parsed(last, NODE_EXTRAS), NODES)), cut(canonical_order(conform(_parsed(edges, EDGE_EXTRAS), EDGES))))


def _plain(row, keep: tuple[str, ...]) -> dict:
    """A row as JSON values: null extras are left out, ``other`` is spread."""
    out = {k: row[k] for k in keep}
    extras = {k: v for k, v in (row["extras"].asDict(True) if row["extras"] else {}).items() if v is not None}
    for k, v in (extras.pop("other", None) or {}).items():
        try:
            extras[k] = json.loads(v)
        except ValueError:
            extras[k] = v
    for k in ("calls", "control", "registry"):
        if isinstance(extras.get(k), dict):
            extras[k] = {a: b for a, b in extras[k].items() if b is not None}
    return out | {"extras": extras}


def dumps(graph: PropertyGraph) -> str:
    """The document, nodes by id and edges in canonical order, without times: the same graph gives the same text."""
    nodes = graph.nodes.orderBy("id").toLocalIterator()
    edges = graph.edges.orderBy("type", "source", "target", "ord").toLocalIterator()
    own = tuple(f.split(" ")[0] for f in NODE_JSON.split(", ") if not f.startswith("extras"))
    doc = {"graph_schema": SCHEMA_VERSION, "target": graph.target, "nodes": [_plain(r, own) for r in nodes], "edges": [_plain(r, ("type", "source", "target")) for r in edges]}
    return json.dumps(doc, indent=2, ensure_ascii=False)


def save(graph: PropertyGraph, path: str) -> None:
    Path(path).write_text(dumps(graph) + "\n", encoding="utf-8")


def write_tables(graph: PropertyGraph, path: str) -> None:
    """Parquet: nodes sorted by id, edges partitioned by type and sorted by target, so that filters on either skip what they can."""
    graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("type", "target").sortWithinPartitions("type", "target").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    graph.nodes.sparkSession.createDataFrame([(graph.target, SCHEMA_VERSION)], "target string, version string").write.mode("overwrite").json(f"{path}/head")


def read_tables(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(spark.read.json(f"{path}/head").first().target, conform(spark.read.parquet(f"{path}/nodes"), NODES), conform(spark.read.parquet(f"{path}/edges"), EDGES))
