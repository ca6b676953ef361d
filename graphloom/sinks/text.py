"""Diagrams, notes and reports as Markdown. What they show is ranked and cut in Spark; only that reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, parent, short, within
from graphloom.operators import communities, lookup, neighbors, structure, traverse

SHOWN = {"modules": 15, "symbols": 25, "references": 40, "list": 40, "coupling": 12, "entries": 15}


def _safe(node: str) -> str:
    return node.translate(str.maketrans(".[]", "___"))


def _tail(node: str) -> str:
    return node.rpartition(".")[2]


def _diagram(head: str, nodes: list[str], arrows: list[tuple[str, str, str]], form: str, marks: dict[str, str] | None = None, end: tuple[str, ...] = ()) -> str:
    marks = marks or {}
    body = [form.format(id=_safe(n), name=_tail(n)) + marks.get(n, "") for n in sorted(nodes)] + [f"{_safe(a)} {how} {_safe(b)}" for a, how, b in arrows] + list(end)
    return "\n".join(["```mermaid", head, *(f"    {x}" for x in body), "```", ""])


def diagram(graph: PropertyGraph, kind: str = "class", scope: str | None = None, root: str | None = None, depth: int = 2) -> str:
    """A Mermaid diagram of class relations, of imports, or of the calls that ``root`` reaches; scope keeps ids under a prefix."""
    inside = lambda c: F.lit(True) if scope is None else within(c, F.lit(scope))
    rows = lambda df: sorted((r.source, r.target) for r in df.select("source", "target").distinct().collect())
    if kind == "class":
        up, real = rows(graph.pairs("inherits").where(inside("source"))), rows(graph.pairs("implements").where(inside("source") | inside("target")))
        return _diagram("classDiagram", list({x for p in up + real for x in p}), [(b, "<|--", a) for a, b in up] + [(b, "<|..", a) for a, b in real], 'class {id}["{name}"]')
    if kind == "deps":
        own = rows(graph.pairs("imports").where(inside("source") & inside("target")))
        return _diagram("graph LR", list({x for p in own for x in p}), [(a, "-->", b) for a, b in own], '{id}["{name}"]')
    if kind == "calls":
        if not root:
            raise ValueError("a diagram of calls needs a root symbol")
        if graph.nodes.where(F.col("id") == root).isEmpty():
            first = lookup.find(graph, root).first()
            if first is None:
                raise KeyError(f"no such symbol: {root}")
            root = first.id
        start = graph.nodes.sparkSession.createDataFrame([(root,)], "entry string")
        own = rows(traverse.flow(graph, start, depth))
        return _diagram("graph LR", list({root, *(x for p in own for x in p)}), [(a, "-->", b) for a, b in own], '{id}["{name}"]', {root: ":::root"}, ("classDef root fill:#f9f,stroke:#333;",))
    raise ValueError(f"no diagram of this kind: {kind}")


def vault(graph: PropertyGraph) -> DataFrame:
    """``(path, content)``: a linked note for every module, class, function and document, and an index; made by the executors."""
    nodes = graph.nodes
    link = lambda c: F.concat(F.lit("[["), c, F.lit("|"), short(c), F.lit("]]"))
    known = nodes.select(F.col("id").alias("to"), F.lit(True).alias("known"))

    def section(pairs: DataFrame, key: str, value: str, title: str, at: int) -> DataFrame:
        item = F.concat(F.lit("- "), F.when(F.col("known"), link(F.col("to"))).otherwise(F.concat(F.lit("`"), "to", F.lit("`"))))
        rows = pairs.select(F.col(key).alias("id"), F.col(value).alias("to")).distinct().join(known, "to", "left")
        return rows.groupBy("id").agg(F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.array_sort(F.collect_list(item)), "\n"), F.lit("\n")).alias("part")).withColumn("at", F.lit(at))

    members = nodes.where(F.col("kind").isin("class", "function")).select(parent("id").alias("up"), "id", "kind")
    used = neighbors.vault_used_by(graph)
    item = F.concat(F.lit("- "), F.when(F.col("known"), link(F.col("source"))).otherwise(F.concat(F.lit("`"), "source", F.lit("`"))), F.lit(" _("), "root", F.lit(")_"))
    used = used.join(known.withColumnRenamed("to", "source"), "source", "left").groupBy(F.col("symbol").alias("id")).agg(F.concat(F.lit("\n## Used outside the core\n\n"), F.array_join(F.array_sort(F.collect_set(item)), "\n"), F.lit("\n")).alias("part")).withColumn("at", F.lit(9))
    outer = graph.of("calls", "references").join(nodes.where(F.coalesce("extras.root", F.lit("core")) != "core").select(F.col("id").alias("source")), "source", "left_semi")
    parts = [
        section(members.where("kind = 'class'"), "up", "id", "Classes", 1),
        section(members.where("kind = 'function'"), "up", "id", "Functions", 2),
        section(neighbors.bases(graph), "class", "base", "Inherits", 3),
        section(neighbors.subclasses(graph), "class", "subclass", "Subclasses", 4),
        section(neighbors.callees(graph), "symbol", "callee", "Calls", 5),
        section(neighbors.callers(graph), "symbol", "caller", "Called by", 6),
        section(outer, "source", "target", "Refers to", 7),
        used,
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    text = every.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("sections"))
    tags = F.concat(F.lit("#"), "kind", F.lit(" #"), F.coalesce("extras.root", F.lit("core")), F.when(F.col("is_deprecated"), " #deprecated").otherwise(""))
    body = F.concat(
        F.lit("# `"), short("id"), F.lit("`\n\n"), tags, F.lit("\n"),
        F.when(F.col("kind").isin("class", "function"), F.concat(F.lit("\nIn "), link(parent("id")), F.lit(".\n"))).otherwise(""),
        F.when(F.col("signature") != "", F.concat(F.lit("\n```python\n"), "signature", F.lit("\n```\n"))).otherwise(""),
        F.when(F.trim("docstring") != "", F.concat(F.lit("\n"), F.trim("docstring"), F.lit("\n"))).otherwise(""),
        F.when(F.col("extras.registry.key").isNotNull(), F.concat(F.lit("\nRegistered as `"), "extras.registry.key", F.lit("`.\n"))).otherwise(""),
        F.coalesce("sections", F.lit("")),
    )
    notes = nodes.where(F.col("kind").isin("module", "class", "function", "doc")).join(text, "id", "left").select(F.concat("id", F.lit(".md")).alias("path"), body.alias("content"))
    heads = nodes.where(F.col("kind").isin("module", "doc")).agg(F.concat(F.lit(f"# {graph.target}\n\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), link(F.col("id"))))), "\n"), F.lit("\n")).alias("content"))
    return notes.union(heads.select(F.lit("index.md").alias("path"), "content"))


def _bullets(rows: list[str]) -> list[str]:
    return [f"- {r}" for r in rows] or ["Nothing found."]


def _ids(df: DataFrame, c: str) -> list[str]:
    return [f"`{r[0]}`" for r in df.select(c).orderBy(c).collect()]


def dependencies(graph: PropertyGraph) -> str:
    cycles = sorted((r.path for r in traverse.import_cycles(graph).collect()), key=lambda p: (len(p), p))
    top = [f"`{r.module}`: {r.n_importers} importers" for r in structure.most_depended(graph, SHOWN["modules"]).collect()]
    head = f"{structure.import_modules(graph).count()} modules with {graph.pairs('imports').count()} imports."
    return "\n".join([f"# Imports of `{graph.target}`", "", head, "", f"## {len(cycles)} cycles", "", *_bullets([" → ".join([*p, p[0]]) for p in cycles]), "", "## Imported most", "", *_bullets(top), ""])


def dead_code(graph: PropertyGraph) -> str:
    by = {r.root: r.modules for r in structure.orphans_by_root(graph).collect()}
    own, dead = [f"`{m}`" for m in by.pop("core", [])], _ids(structure.dead_symbols(graph), "id")
    others = [f"{root}: {len(m)}, run directly as a rule" for root, m in sorted(by.items())]
    note = "These may be unused. Dynamic imports, command lines and calls that can't be resolved aren't seen."
    return "\n".join([f"# Unused code in `{graph.target}`?", "", note, "", f"## {len(own)} modules that nothing imports", "", *_bullets(own), "", "## Such modules of other roots", "", *_bullets(others), "", f"## {len(dead)} private functions that nothing calls", "", *_bullets(dead), ""])


def behavior(graph: PropertyGraph) -> str:
    c = structure.coverage(graph).first()
    of = lambda n: f"{n} ({100 * n / (c.n_out or 1):.1f} %)"
    ways = [f"{r.resolution or 'unknown'}: {r.n}" for r in structure.calls_by_resolution(graph).orderBy("resolution").collect()]
    return "\n".join([f"# Calls in `{graph.target}`", "", f"{c.n_out} places of call.", "", *_bullets([f"inside the package: {of(c.n_resolved)}", f"outside of it: {of(c.n_external)}", f"by a string key: {of(c.n_dynamic)}", f"unknown: {of(c.n_unresolved)}"]), "", "## Edges by way of resolution", "", *_bullets(ways), ""])


def architecture_facts(graph: PropertyGraph) -> dict:
    rows = lambda df: [r.asDict() for r in df.collect()]
    hubs, gods = structure.call_hubs(graph), structure.god_classes(graph).orderBy(F.desc("methods"), "class").limit(15)
    pairs = rows(structure.layer_edges(graph).orderBy(F.desc("n"), "source_layer", "target_layer"))
    own: dict[str, list[str]] = {}
    for r in structure.layers(graph).orderBy("layer", "module").collect():
        own.setdefault(r.layer, []).append(r.module)
    coupled = [r | {"instability": round(r["instability"], 2)} for r in rows(structure.coupling(graph).orderBy(F.desc("ca"), "module").limit(20))]
    return {
        "target": graph.target,
        "cycles": [r.path for r in traverse.import_cycles(graph).collect()],
        "layers": {"layers": own, "edges": {f"{r['source_layer']} -> {r['target_layer']}": r["n"] for r in pairs}, "violations": sorted([r.layer_a, r.layer_b] for r in structure.layer_violations(graph).collect())},
        "coupling": coupled,
        "hotspots": {"god_classes": rows(gods), "call_hubs": rows(hubs)},
    }


def architecture(graph: PropertyGraph) -> str:
    a = architecture_facts(graph)
    n = SHOWN["coupling"]
    return "\n".join([
        f"# Architecture of `{a['target']}`", "", f"{len(a['cycles'])} import cycles.", "", "## Layers", "",
        *_bullets([f"`{k}`: {len(v)} modules" for k, v in a["layers"]["layers"].items()]), "", "## Imports between layers", "",
        *_bullets([f"{k}: {v}" for k, v in a["layers"]["edges"].items()]), "", "## Layers that import each other", "", *_bullets([f"{x} and {y}" for x, y in a["layers"]["violations"]]), "",
        "## Coupling", "", "| module | imported by | imports | instability |", "|-|-|-|-|", *[f"| `{r['module']}` | {r['ca']} | {r['ce']} | {r['instability']} |" for r in a["coupling"][:n]], "",
        "## Large classes", "", *_bullets([f"`{r['class']}`: {r['methods']} methods" for r in a["hotspots"]["god_classes"]]), "",
        "## Most connected by calls", "", *_bullets([f"`{r['id']}`: {r['degree']}" + (", a utility by its name" if r["pervasive"] else "") for r in a["hotspots"]["call_hubs"][:n]]), "",
    ])


def impact_facts(graph: PropertyGraph, symbol: str, depth: int = 2) -> list[dict]:
    """For each node that the symbol stands for: its references, their numbers by root and distance, and its risk."""
    spark = graph.nodes.sparkSession
    ids = sorted(r.id for r in lookup.impact_targets(graph, spark.createDataFrame([(symbol,)], "input string")).collect())
    own: dict[str, list[dict]] = {i: [] for i in ids}
    if ids:
        asked = spark.createDataFrame([(i,) for i in ids], "symbol string")
        for r in traverse.impact(graph, asked, depth).orderBy("symbol", "distance", "root", "type", "source", "target").collect():
            row = r.asDict(True)
            own[row.pop("symbol")].append(row)
    out = []
    for i, refs in own.items():
        by_root: dict = {}
        by_distance: dict = {}
        for r in refs:
            kinds = by_root.setdefault(r["root"], {})
            kinds[r["type"]] = kinds.get(r["type"], 0) + 1
            by_distance[r["distance"]] = by_distance.get(r["distance"], 0) + 1
        far, n, roots = max(by_distance, default=0), len(refs), len(by_root)
        risk = "none" if not n else "high" if n >= 30 or roots >= 4 or (n >= 15 and far >= 3) else "medium" if n >= 5 or roots >= 2 or far >= 2 else "low"
        out.append({"symbol": i, "refs": refs, "by_root": by_root, "by_distance": by_distance, "max_distance": far, "risk": risk})
    return out


def impact_of(symbol: str, found: list[dict]) -> str:
    """The same as Markdown."""
    out = [f"# What depends on `{symbol}`", ""]
    for i in found:
        out += [f"## `{i['symbol']}`: risk {i['risk']}", "", f"{len(i['refs'])} references, up to {i['max_distance']} steps away.", ""]
        out += [f"- {root}, {kind}: {n}" for root, kinds in sorted(i["by_root"].items()) for kind, n in sorted(kinds.items())]
        direct = [r for r in i["refs"] if r["distance"] == 1][: SHOWN["references"]]
        out += ["", *[f"- `{r['source']}` {r['type']} `{r['target']}` ({r['root']})" for r in direct], ""]
    return "\n".join(out if found else [*out, "No such symbol.", ""])


def impact(graph: PropertyGraph, symbol: str, depth: int = 2) -> str:
    return impact_of(symbol, impact_facts(graph, symbol, depth))


def review(dossiers: DataFrame, unresolved: DataFrame | None = None) -> str:
    """The dossiers of a change, riskiest first."""
    rows = dossiers.orderBy(F.desc("score"), "symbol").collect()
    out = ["# Review", "", f"{len(rows)} symbols changed, {sum(r.risk == 'high' for r in rows)} of them at high risk.", ""]
    for r in rows:
        facts = [f"score {r.score}", f"{r.n_callers} callers", f"{r.n_contract} places of call to check when its signature changes", f"{r.n_external} references from outside the core"]
        keys = [f"{how} {', '.join(k)}" for how, k in (("reads", r.reads), ("writes", r.writes)) if k]
        out += [f"## `{r.symbol}`: {r.risk}", "", *_bullets(facts + keys), ""]
    lost = [f"{r.file}, lines {r.start} to {r.end}" for r in unresolved.orderBy("file", "start").collect()] if unresolved is not None else []
    return "\n".join(out + (["## Places without a symbol", "", *_bullets(lost), ""] if lost else []))


def subsystems(graph: PropertyGraph) -> str:
    groups = sorted(communities.communities(graph).collect(), key=lambda r: (-r.size, r.modules[0]))
    out = [f"# Subsystems of `{graph.target}`", ""]
    for k, g in enumerate(groups, 1):
        out += [f"## {k}. {g.label}, {g.size} modules", "", *_bullets([f"`{m}`" for m in g.modules[: SHOWN["list"]]]), ""]
    return "\n".join(out if groups else [*out, "No imports to group by.", ""])


def flows(graph: PropertyGraph, depth: int = 5) -> str:
    """Entry points by how much they reach, all searched at once."""
    reach = traverse.flow_reach(traverse.flow(graph, max_depth=depth)).orderBy(F.desc("reached"), F.desc("entry")).limit(SHOWN["list"]).collect()
    return "\n".join([f"# Entry points of `{graph.target}`", "", *_bullets([f"`{r.entry}` reaches {r.reached} in up to {r.max_depth} calls" for r in reach]), ""])


def living_docs(graph: PropertyGraph) -> str:
    surface: dict[str, list] = {}
    doc = lookup.first_line("docstring").alias("summary")
    rows = graph.nodes.where("visibility = 'public'").where(F.col("kind").isin("class", "function")).where(F.coalesce("extras.root", F.lit("core")) == "core")
    for r in rows.select(parent("id").alias("module"), "id", "kind", "signature", doc, "is_deprecated").orderBy("id").collect():
        surface.setdefault(r.module, []).append(f"**`{r.signature or _tail(r.id)}`** ({r.kind}){' deprecated' if r.is_deprecated else ''}: {r.summary or 'no documentation'}")
    groups = sorted(communities.communities(graph).collect(), key=lambda r: (-r.size, r.modules[0]))
    out, done = [f"# {graph.target}", "", f"{sum(map(len, surface.values()))} public symbols.", ""], set()
    for g in groups:
        own = [s for m in g.modules for s in surface.get(m, [])]
        done |= set(g.modules)
        out += [f"## {g.label}, {g.size} modules", "", *_bullets(own[: SHOWN["symbols"]]), *([f"- and {len(own) - SHOWN['symbols']} more"] if len(own) > SHOWN["symbols"] else []), ""]
    modules = {r.id for r in graph.nodes.where("kind = 'module'").select("id").collect()}
    for m in sorted((set(surface) & modules) - done):
        out += [f"## `{m}`", "", *_bullets(surface[m][: SHOWN["symbols"]]), ""]
    reach = traverse.flow_reach(traverse.flow(graph, max_depth=4)).orderBy(F.desc("reached"), F.desc("entry")).limit(SHOWN["entries"]).collect()
    return "\n".join([*out, "## Where it starts", "", *_bullets([f"`{r.entry}` reaches {r.reached}" for r in reach]), "", "Calls that can't be resolved from the source aren't counted.", ""])


def api_surface(graph: PropertyGraph) -> str:
    by: dict[str, list] = {}
    for r in lookup.api_surface(graph).orderBy("module", "id").collect():
        by.setdefault(r.module, []).append(f"**`{r.signature or _tail(r.id)}`** ({r.kind})" + (" deprecated" if r.is_deprecated else "") + (f": {r.summary}" if r.summary else ""))
    return "\n".join([f"# Public names of `{graph.target}`", "", *[x for m in sorted(by) for x in (f"## `{m}`", "", *_bullets(by[m]), "")]])


REPORTS = {"dependencies": dependencies, "dead-code": dead_code, "behavior": behavior, "architecture": architecture, "communities": subsystems, "flows": flows, "api-surface": api_surface}


def _plain(df: DataFrame, *order) -> list[dict]:
    return [r.asDict(True) for r in df.orderBy(*order).collect()]


#: The same as data, for reports that are to be read by programs.
FACTS = {
    "dependencies": lambda g: {"target": g.target, "modules": structure.import_modules(g).count(), "imports": g.pairs("imports").count(), "cycles": sorted((r.path for r in traverse.import_cycles(g).collect()), key=lambda p: (len(p), p)), "most_depended": _plain(structure.most_depended(g), F.desc("n_importers"), "module")},
    "dead-code": lambda g: {"target": g.target, "orphan_modules": {r.root: r.modules for r in structure.orphans_by_root(g).collect()}, "dead_symbols": [r.id for r in structure.dead_symbols(g).orderBy("id").collect()]},
    "behavior": lambda g: {"target": g.target, "coverage": structure.coverage(g).first().asDict(), "by_resolution": {r.resolution: r.n for r in structure.calls_by_resolution(g).collect()}},
    "architecture": architecture_facts,
    "communities": lambda g: sorted((r.asDict(True) for r in communities.communities(g).collect()), key=lambda c: (-c["size"], c["modules"][0])),
    "flows": lambda g: _plain(traverse.flow_reach(traverse.flow(g)), F.desc("reached"), "entry"),
    "api-surface": lambda g: _plain(lookup.api_surface(g), "module", "id"),
}


def answer(found: dict) -> str:
    """The answer to a query as short lines of text."""
    listed = lambda names: ", ".join(names) or "none"
    out = [found["name"], f"  defined at {listed(found['defined_at'])}"]
    out += [f"  {m['kind']} {m['id']}" + (f" in {m['file']}, line {m['lines'][0]}" if m["file"] and m["lines"][0] else "") for m in found["matches"]]
    for i, m in found.get("modules", {}).items():
        out += ["", i, f"  imports {listed(m['dependencies'])}", f"  imported by {listed(m['dependents'])}"]
    for i, c in found.get("classes", {}).items():
        out += ["", i, f"  bases {listed(c['bases'])}", f"  subclasses {listed(c['subclasses'])}"]
        out += [f"  {k} {listed(c[k])}" for k in ("implements", "implementers", "family") if c[k]]
        if c["registered_as"]:
            out.append(f"  registered by {_tail(c['registered_as'].get('decorator') or '?')} as {c['registered_as'].get('key')!r}")
    for i, f in found.get("functions", {}).items():
        out += ["", i, f"  calls {listed(f['callees'])}", f"  called by {listed(f['callers'])}"]
        out += [f"  {how} {', '.join(keys)}" for how, keys in (f["columns"] or {}).items() if keys]
    out += ["", *[f"{i} is used by " + ", ".join(f"{root} ({n})" for root, n in sorted(by.items())) for i, by in found.get("used_by", {}).items()]] if found.get("used_by") else []
    if found.get("column"):
        out += ["", "column", f"  written by {listed(found['column']['writes'])}", f"  read by {listed(found['column']['reads'])}"]
    return "\n".join(out) + "\n"
