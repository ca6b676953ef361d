"""Breadth-first traversals, for many starting points at once.

A frontier is a DataFrame keyed by its starting point, so all of them share each level's joins. Levels are unrolled up to the depth;
from the third on, what was found so far is checkpointed, as each level would otherwise repeat the plans of those before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, union, with_root
from graphloom.operators.neighbors import ancestors, inbound, members_of, references_to
from graphloom.session import cut, few, held, merged, stored

IMPACT = ["symbol", "source", "type", "root", "target", "distance"]


def impact(graph: PropertyGraph, symbols: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """``(symbol, source, type, root, target, distance)``: what a change of a symbol reaches.

    Distance 1 has all direct references. Farther out each source occurs once, with the smallest target of the level before that it
    refers to, and the first type of reference in order of name. symbols: a DataFrame with the column ``symbol``; all nodes if None.
    """
    return union([_reached(r, k) for k, r in enumerate(_impact(graph, symbols, depth), 1)]) if depth >= 1 else references_to(graph, symbols).withColumn("distance", F.lit(0)).select(*IMPACT).limit(0)


def _impact(graph: PropertyGraph, symbols: DataFrame | None, depth: int, names: DataFrame | None = None) -> list[DataFrame]:
    """``(source, root, found)`` for each distance: the symbols that a source reaches, as an array of ``(target, type, symbols)``.

    A level costs a row for each edge, which brings what its target reaches as an array, not a row for each edge and symbol; a source
    with all that it reaches is one row. names: see ``ancestors``; the symbols are then names.
    """
    edges, own = inbound(graph), ancestors(graph, names)
    into = own if symbols is None else members_of(graph, symbols).groupBy("target").agg(F.collect_list("symbol").alias("ups"))
    refs = edges.join(into, "target", "left" if depth > 1 else "inner").repartition("source").groupBy("source").agg(F.collect_list(F.struct("target", "type", F.col("ups").alias("symbols"))).alias("refs"))
    about = graph.roots().withColumnRenamed("id", "source").join(own.select(F.col("target").alias("source"), F.col("ups").alias("own")), "source")
    none = F.expr(f"cast(array() as {into.schema['ups'].dataType.simpleString()})")
    refs = refs.join(about, "source", "left").withColumn("root", F.coalesce("root", F.lit("core"))).withColumn("own", F.coalesce("own", none))
    elsewhere = F.transform("refs", lambda r: F.struct(r["target"], r["type"], F.array_except(r["symbols"], F.col("own")).alias("symbols")))
    first = refs.select("source", "root", "own", F.filter(elsewhere, lambda r: F.size(r["symbols"]) > 0).alias("found"))
    if depth == 1:
        return [first.drop("own")]
    levels = [stored(first)]
    # What a source reached so far, and the nodes it lies under: neither is found again.
    known = levels[0].select("source", "root", F.concat("own", F.flatten(F.col("found.symbols"))).alias("known"))
    for level in range(2, depth + 1):
        front = levels[-1].select(F.col("source").alias("target"), F.array_distinct(F.flatten(F.col("found.symbols"))).alias("symbols")).where(F.size("symbols") > 0)
        step = edges.join(front.hint("merge"), "target").repartition("source").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("target", "type", "symbols"))).alias("refs"))
        step = step.join(known.hint("merge"), "source")
        place = F.flatten(F.transform("refs", lambda r, i: F.transform(r["symbols"], lambda s: F.struct(s.alias("symbol"), i.alias("at")))))
        before = F.transform("known", lambda s: F.struct(s.alias("symbol"), F.lit(-1).alias("at")))
        step = _worked_out(step, "all", F.sort_array(F.concat(before, place)))
        step = _worked_out(step, "new", F.filter("all", lambda x, i: (x["at"] >= 0) & ((i == 0) | (F.get("all", i - 1)["symbol"] != x["symbol"])))).where(F.size("new") > 0)
        found = F.transform("new", lambda x: F.struct(F.get("refs", x["at"])["target"].alias("target"), F.get("refs", x["at"])["type"].alias("type"), F.array(x["symbol"]).alias("symbols")))
        step = step.select("source", "root", found.alias("found"))
        if level < depth:
            step = stored(step)
            known = known.join(step.select("source", F.flatten(F.col("found.symbols")).alias("more")).hint("merge"), "source", "left").select("source", "root", F.when(F.col("more").isNull(), F.col("known")).otherwise(F.concat("known", "more")).alias("known"))
        levels.append(step)
    return levels


def _worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn, by a generator: expressions over the column, as in lambdas, would else repeat its own for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _reached(level: DataFrame, distance: int) -> DataFrame:
    refs = level.select("source", "root", F.explode("found").alias("r")).select("source", "root", "r.target", "r.type", F.explode("r.symbols").alias("symbol"))
    return refs.withColumn("distance", F.lit(distance)).select(*IMPACT)


def impact_counted(graph: PropertyGraph, depth: int, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """count, one of the functions below, of the impact of all nodes. Nodes go by number up to the last, small join: their ids would be most of what is shuffled."""
    names = held(graph.nodes.select("id").distinct().withColumn("name", F.monotonically_increasing_id()))
    counted = count(union([_reached(r, k) for k, r in enumerate(_impact(graph, None, depth, names), 1)]))
    return counted.withColumnRenamed("symbol", "name").join(names.withColumnRenamed("id", "symbol"), "name").select(*counted.columns)


def impact_by_root(refs: DataFrame) -> DataFrame:
    """``(symbol, root, type, n)``"""
    return refs.groupBy("symbol", "root", "type").agg(F.count("*").alias("n"))


def impact_by_distance(refs: DataFrame) -> DataFrame:
    """``(symbol, distance, n)``"""
    return refs.groupBy("symbol", "distance").agg(F.count("*").alias("n"))


def risk(breadth: Column | str, reach: Column | str, roots: Column | str) -> Column:
    """How risky a change is, by the number of references, the distance they reach and the roots they come from."""
    b, r, o = (F.col(x) if isinstance(x, str) else x for x in (breadth, reach, roots))
    return F.when(b == 0, "none").when((b >= 30) | (o >= 4) | ((b >= 15) & (r >= 3)), "high").when((b >= 5) | (o >= 2) | (r >= 2), "medium").otherwise("low")


def impact_summary(refs: DataFrame) -> DataFrame:
    """``(symbol, breadth, max_distance, n_roots, risk)``; symbols without references aren't listed: their risk is ``none``."""
    out = refs.groupBy("symbol").agg(F.count("*").alias("breadth"), F.max("distance").alias("max_distance"), F.count_distinct("root").alias("n_roots"))
    return out.withColumn("risk", risk("breadth", "max_distance", "n_roots"))


def entry_points(graph: PropertyGraph, root: str | None = "core") -> DataFrame:
    """``(id)``: what calls but isn't called."""
    out = graph.of("calls").select(F.col("source").alias("id")).distinct().join(graph.of("calls").select(F.col("target").alias("id")), "id", "left_anti")
    return out if root is None else with_root(out, graph, "id").where(F.col("root") == root).select("id")


def flow(graph: PropertyGraph, entries: DataFrame | None = None, max_depth: int = 5) -> DataFrame:
    """``(entry, source, target, distance)``: the calls that an entry sets in motion.

    All calls of each node reached are listed, also those back to nodes reached before; a node is followed once. entries: a
    DataFrame with the column ``entry``; the core's entry points if None. What a level follows is made once, and broadcast while it
    is small: calls are then read where they are, not shuffled for each level, and never sent to the driver.
    """
    calls = graph.of("calls").select("source", "target")
    starts = few(entry_points(graph).select(F.col("id").alias("entry")) if entries is None else entries.select("entry").distinct())
    frontier, out = starts.select("entry", F.col("entry").alias("source")), None
    seen = frontier.select("entry", F.col("source").alias("node"))
    for level in range(1, max_depth + 1):
        step = frontier.join(calls, "source").select("entry", "source", "target").distinct().withColumn("distance", F.lit(level))
        if level > 2 or level < max_depth:
            step = cut(step)
        out = step if out is None else out.union(step)
        if level < max_depth:
            new = few(step.select("entry", F.col("target").alias("node")).distinct().join(seen, ["entry", "node"], "left_anti"))
            seen, frontier = seen.union(new), new.select("entry", F.col("node").alias("source"))
    if out is None:
        return starts.select("entry", F.col("entry").alias("source"), F.col("entry").alias("target"), F.lit(0).alias("distance")).limit(0)
    return out


def flow_reach(edges: DataFrame) -> DataFrame:
    """``(entry, reached, max_depth)`` of the calls found by ``flow``."""
    return edges.groupBy("entry").agg(F.count_distinct(F.when(F.col("target") != F.col("entry"), F.col("target"))).alias("reached"), F.max("distance").alias("max_depth"))


def import_cycles(graph: PropertyGraph, longest: int | None = None) -> DataFrame:
    """``(length, path)``: the elementary circuits of the import graph, each once, from its smallest module; ``longest`` leaves out longer ones.

    Paths grow from every module over larger ones, and only over those from which there is a way back to it over larger ones. Those are found
    first, level by level, so that imports that close no circuit cost nothing. Circuits can be exponentially many.
    """
    arcs = cut(graph.pairs("imports"))
    n = arcs.count()
    new = arcs.where("source >= target").select(F.col("target").alias("start"), F.col("source").alias("node"))
    known, level = merged(cut(new), n), 1
    before = merged(arcs.select(F.col("source").alias("before"), F.col("target").alias("node")), n)
    while longest is None or level < longest:
        new = cut(new.join(before, "node").where("node <> start and before > start").select("start", F.col("before").alias("node")).distinct().join(known, ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        known, level = merged(cut(known.union(new)), n), level + 1
    starts = known.select("start").distinct()
    allowed = merged(cut(known.union(starts.select("start", "start")).distinct().select("start", F.col("node").alias("next"))), n)
    ahead = merged(arcs.select(F.col("source").alias("last"), F.col("target").alias("next")), n)
    paths, found, size = cut(starts.select("start", F.col("start").alias("last"), F.array("start").alias("path"))), [], 1
    while (longest is None or size <= longest) and not paths.isEmpty():
        on = cut(paths.join(ahead, "last").join(allowed, ["start", "next"], "left_semi"))
        found.append(on.where("next = start").select("path"))
        paths = on.where("next > start").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"))
        size += 1
    return union([*found, paths.select("path").limit(0)]).select(F.size("path").alias("length"), "path")
