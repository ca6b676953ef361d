"""Subsystems: modules that import each other more than the rest.

Greedy modularity (Clauset, Newman and Moore 2004) joins, again and again, the two groups whose union raises the modularity most. Every
step depends on those before in the same connected component, and on no other: only groups that import each other are joined, and their
gain takes nothing else from the whole than its number of imports. So components are worked out apart, each by one task; labels and sizes
are Spark aggregates. Among equal gains the pair with the smallest modules is joined.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, with_root
from graphloom.operators.structure import import_modules, layer_of
from graphloom.session import components, cut, merged


def greedy_modularity(nodes: list[str], pairs: list[tuple[str, str]], total: int | None = None) -> list[list[str]]:
    """Groups of nodes, over undirected pairs without repetitions or loops. total: the pairs of the whole graph, where these are a component's."""
    names = sorted(set(nodes) | {x for p in pairs for x in p})
    number = {n: i for i, n in enumerate(names)}
    m = total or len(pairs)
    if not m:
        return [[n] for n in names]
    near: dict[int, dict[int, float]] = defaultdict(dict)
    degree = [0] * len(names)
    for a, b in pairs:
        i, j = number[a], number[b]
        degree[i] += 1
        degree[j] += 1
        near[i][j] = near[j][i] = 1.0
    share = [d / (2 * m) for d in degree]
    gain = lambda i, j: near[i].get(j, 0.0) / m - 2 * share[i] * share[j]
    groups = {i: [i] for i in range(len(names))}
    heap = [(-gain(i, j), i, j) for i in near for j in near[i] if i < j]
    heapq.heapify(heap)
    while heap:
        g, i, j = heapq.heappop(heap)
        if g >= -1e-12:
            break
        if i not in groups or j not in groups or abs(-g - gain(i, j)) > 1e-12 or j not in near[i]:
            continue
        groups[i] += groups.pop(j)  # i is the smaller, and stands for the group by its smallest node
        share[i] += share[j]
        for k, w in near.pop(j).items():
            near[k].pop(j, None)
            if k != i:
                near[i][k] = near[k][i] = near[i].get(k, 0.0) + w
        for k in near[i]:
            a, b = min(i, k), max(i, k)
            heapq.heappush(heap, (-gain(a, b), a, b))
    return [sorted(names[x] for x in g) for g in groups.values()]


def communities(graph: PropertyGraph) -> DataFrame:
    """``(label, size, modules)`` of the core's modules, none if they don't import each other.

    The label is the commonest layer of a group; among equally common ones that of the first module.
    """
    core = with_root(import_modules(graph), graph, "module").where("root = 'core'").select("module")
    core = cut(core)
    core = merged(core, core.count())
    pairs = graph.pairs("imports").join(core.select(F.col("module").alias("source")), "source", "left_semi").join(core.select(F.col("module").alias("target")), "target", "left_semi")
    pairs = pairs.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    pairs = cut(pairs)
    m = pairs.count()
    roots = cut(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), merge=True).select(F.col("node").alias("a"), "root"))
    own = pairs.join(merged(roots, m), "a").groupBy("root").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("pairs"):
                found = greedy_modularity([], [(p["a"], p["b"]) for p in row.as_py()], m)
                out = [(g[0], x) for g in found for x in g]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["community", "module"])

    alone = core.join(merged(roots.select(F.col("a").alias("module")), m), "module", "left_anti").select(F.col("module").alias("community"), "module").where(F.lit(m > 0))
    groups = cut(own.select("pairs").mapInArrow(group, "community string, module string").union(alone).withColumn("layer", layer_of(graph, "module")))
    by = groups.groupBy("community", "layer").agg(F.count("*").alias("n"), F.min("module").alias("first"))
    top = by.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "first"))).where("k = 1").select("community", F.col("layer").alias("label"))
    sizes = groups.groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("module")).alias("modules"))
    return sizes.join(merged(top, m), "community").select("label", "size", "modules")
