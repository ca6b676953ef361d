"""The shape of a whole system: layers, coupling, hot spots, unused and unreachable symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, short, with_root
from graphloom.operators.neighbors import pervasive


def import_modules(graph: PropertyGraph) -> DataFrame:
    """``(module)``: all modules, and what else is at an end of an import."""
    ends = graph.pairs("imports").select(F.explode(F.array("source", "target")).alias("module"))
    return graph.nodes.where("kind = 'module'").select(F.col("id").alias("module")).union(ends).distinct()


def layer_of(graph: PropertyGraph, c: str):
    parts = F.split(F.col(c), r"\.")
    return F.when((parts[0] == graph.target) & (F.size(parts) >= 2), F.get(parts, F.lit(1))).otherwise("(root)")


def layers(graph: PropertyGraph) -> DataFrame:
    """``(layer, module)`` of the core's modules."""
    return with_root(import_modules(graph), graph, "module").where("root = 'core'").select(layer_of(graph, "module").alias("layer"), "module")


def layer_edges(graph: PropertyGraph) -> DataFrame:
    """``(source_layer, target_layer, n)``: imports between layers, both ends in the core."""
    pairs = with_root(with_root(graph.pairs("imports"), graph, "source", "source_root"), graph, "target", "target_root").where("source_root = 'core' and target_root = 'core'")
    out = pairs.select(layer_of(graph, "source").alias("source_layer"), layer_of(graph, "target").alias("target_layer")).where("source_layer <> target_layer")
    return out.groupBy("source_layer", "target_layer").agg(F.count("*").alias("n"))


def layer_violations(graph: PropertyGraph) -> DataFrame:
    """``(layer_a, layer_b)``: layers that import each other."""
    pairs = layer_edges(graph).select(F.least("source_layer", "target_layer").alias("layer_a"), F.greatest("source_layer", "target_layer").alias("layer_b"))
    return pairs.groupBy("layer_a", "layer_b").count().where("count = 2").drop("count")


def coupling(graph: PropertyGraph, root: str | None = "core") -> DataFrame:
    """``(module, ca, ce, instability)``: importers, imports, and ce / (ca + ce), unrounded; 0 without either.

    Imports from and into all roots count; only modules of ``root`` are listed. Ranked reports order by ca, then module.
    """
    pairs = graph.pairs("imports")
    ends = pairs.select(F.col("target").alias("module"), F.lit(1).alias("a"), F.lit(0).alias("e")).union(pairs.select("source", F.lit(0), F.lit(1)))
    every = ends.union(graph.nodes.where("kind = 'module'").select("id", F.lit(0), F.lit(0)))
    out = every.groupBy("module").agg(F.sum("a").cast("long").alias("ca"), F.sum("e").cast("long").alias("ce"))
    out = out.withColumn("instability", F.coalesce(F.try_divide(F.col("ce").cast("double"), (F.col("ca") + F.col("ce")).cast("double")), F.lit(0.0)))
    return out if root is None else with_root(out, graph, "module").where(F.col("root") == root).drop("root")


def most_depended(graph: PropertyGraph, limit: int = 15) -> DataFrame:
    return coupling(graph, None).where("ca > 0").orderBy(F.desc("ca"), "module").limit(limit).select("module", F.col("ca").alias("n_importers"))


def god_classes(graph: PropertyGraph, root: str = "core", least: int = 12) -> DataFrame:
    """``(class, methods)``: classes that contain many functions; repeated edges count."""
    kinds = graph.nodes.select("id", "kind")
    functions = kinds.where("kind = 'function'").select(F.col("id").alias("target"))
    classes = kinds.where("kind = 'class'").select(F.col("id").alias("source"))
    own = graph.of("contains").select("source", "target").join(functions, "target", "left_semi").join(classes, "source", "left_semi")
    counts = own.groupBy(F.col("source").alias("class")).agg(F.count("*").alias("methods")).where(F.col("methods") >= least)
    return with_root(counts, graph, "class").where(F.col("root") == root).drop("root")


def call_degrees(graph: PropertyGraph, root: str | None = "core") -> DataFrame:
    """``(id, degree, pervasive)``: callers plus callees of everything at an end of a call."""
    ends = graph.pairs("calls").select(F.explode(F.array("source", "target")).alias("id"))
    out = ends.groupBy("id").agg(F.count("*").alias("degree")).withColumn("pervasive", pervasive("id"))
    return out if root is None else with_root(out, graph, "id").where(F.col("root") == root).drop("root")


def call_hubs(graph: PropertyGraph, root: str = "core", limit: int = 15) -> DataFrame:
    return call_degrees(graph, root).orderBy(F.desc("degree"), "id").limit(limit)


def dead_symbols(graph: PropertyGraph) -> DataFrame:
    """``(id)``: private functions that nothing calls; names with two underscores on both sides are called implicitly."""
    private = graph.nodes.where("kind = 'function' and visibility = 'private'").where(~(short("id").startswith("__") & short("id").endswith("__")))
    return private.select("id").join(graph.of("calls").select(F.col("target").alias("id")), "id", "left_anti")


def orphan_modules(graph: PropertyGraph, root: str | None = None) -> DataFrame:
    """``(root, module)``: modules that nothing imports, but for the package itself and entry points."""
    rows = import_modules(graph).where(F.col("module") != graph.target).where(~short("module").isin("__init__", "__main__"))
    rows = rows.join(graph.of("imports").select(F.col("target").alias("module")), "module", "left_anti")
    out = with_root(rows, graph, "module").select("root", "module")
    return out if root is None else out.where(F.col("root") == root)


def orphans_by_root(graph: PropertyGraph) -> DataFrame:
    return orphan_modules(graph).groupBy("root").agg(F.array_sort(F.collect_list("module")).alias("modules"))


def calls_by_resolution(graph: PropertyGraph) -> DataFrame:
    return graph.of("calls").groupBy(F.coalesce("extras.resolution", F.lit("")).alias("resolution")).agg(F.count("*").alias("n"))


def coverage(graph: PropertyGraph) -> DataFrame:
    """One row: how the calls of all functions were resolved, as counts."""
    names = ("out", "resolved", "external", "unresolved", "dynamic")
    return graph.nodes.where("kind = 'function'").agg(*[F.coalesce(F.sum(f"extras.calls.{n}"), F.lit(0)).cast("long").alias(f"n_{n}") for n in names])
