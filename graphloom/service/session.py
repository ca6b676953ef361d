"""A session over one graph: a request names an operation and its arguments, the answer is a plain dictionary.

nodes and edges are cached when the session starts; each operation is one plan and a bounded collect.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import SCHEMA_VERSION, PropertyGraph, short
from graphloom.operators import communities, locate, lookup, neighbors, review, traverse
from graphloom.sinks import rag, text
from graphloom.sources.freshness import age

ROWS = 200_000
PARTIAL = {"callers", "callees", "impact", "flows", "call_contract"}
NOTE = "calls are resolved as far as the source tells, so there may be more"


class Session:
    def __init__(self, graph: PropertyGraph, source_root: str | None = None, graph_path: str | None = None) -> None:
        self.graph = PropertyGraph(graph.target, self.held(graph.nodes), self.held(graph.edges))
        self.spark, self.source_root, self.graph_path = graph.nodes.sparkSession, source_root, graph_path
        self.resolution: dict | None = None
        self.ops: dict[str, Callable[[dict], object]] = {n[4:]: getattr(self, n) for n in dir(self) if n.startswith("_op_")}

    def handle(self, request: dict) -> dict:
        """The answer to one request; errors come back as answers too."""
        op = request.get("op")
        if op not in self.ops:
            return {"ok": False, "error": f"there is no operation {op!r}", "ops": sorted(self.ops)}
        self.resolution = None
        try:
            out: dict = {"ok": True, "result": self.ops[op](request.get("args") or {})}
        except Exception as e:  # one bad request doesn't end the session
            return {"ok": False, "error": f"{type(e).__name__}: {e}"}
        if self.resolution and (self.resolution["ambiguous"] or self.resolution["id"] != self.resolution["input"]):
            out["resolved"] = self.resolution
        return out | ({"epistemic": {"epistemic": "partial", "reason": NOTE}} if op in PARTIAL else {})

    def serve(self, lines: IO[str], answers: IO[str]) -> None:
        """One JSON request a line in, one JSON answer a line out."""
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                answer = self.handle(request) if isinstance(request, dict) else {"ok": False, "error": "a request is an object"}
            except ValueError as e:
                answer = {"ok": False, "error": f"no JSON: {e}"}
            answers.write(json.dumps(answer, ensure_ascii=False) + "\n")
            answers.flush()

    # -- helpers

    @staticmethod
    def held(df: DataFrame) -> DataFrame:
        """The rows in memory, in as few partitions as their number needs: a question about one symbol costs a task for each."""
        own = df.cache()
        parts = max(1, -(-own.count() // ROWS))
        if parts >= own.rdd.getNumPartitions():
            return own
        few = own.coalesce(parts).cache()
        few.count()
        own.unpersist()
        return few

    def one(self, value: str, name: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{name} string")

    def resolve(self, name: str) -> dict | None:
        """As ``lookup.resolve``, which only looks at nodes of the same last segment; those are found first."""
        if not self.graph.nodes.where(F.col("id") == name).isEmpty():
            return {"input": name, "id": name, "ambiguous": False, "alternatives": []}
        alike = self.graph.nodes.where(short("id") == name.rpartition(".")[2]).select("id")
        r = lookup.resolve(PropertyGraph(self.graph.target, alike, self.graph.edges), self.one(name, "input")).first()
        return None if r is None else {"input": r.input, "id": r.id, "ambiguous": r.ambiguous, "alternatives": r.alternatives}

    def canonical(self, name: str) -> str:
        self.resolution = self.resolve(name)
        return self.resolution["id"] if self.resolution else name

    @staticmethod
    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(True) for r in df.collect()]

    @staticmethod
    def ids(df: DataFrame, c: str) -> list[str]:
        return sorted({r[0] for r in df.select(c).collect()})

    # -- operations

    def _op_ping(self, args: dict) -> str:
        return "pong"

    def _op_stats(self, args: dict) -> dict:
        kinds = {r.kind: r.n for r in lookup.stats_kinds(self.graph).collect()}
        types = {r.type: r.n for r in lookup.stats_edges(self.graph).collect()}
        out = {"target": self.graph.target, "schema": SCHEMA_VERSION, "nodes": sum(kinds.values()), "edges": sum(types.values()), "node_kinds": kinds, "edge_types": types}
        known = age(self.graph_path)
        return out | ({"freshness": known} if known else {})

    def _op_query(self, args: dict) -> dict:
        g, name = self.graph, args["name"]
        found = lookup.find(g, name).join(g.nodes.select("id", "endlineno", "extras.registry"), "id").orderBy("id").collect()
        out: dict = {"name": name, "defined_at": self.ids(lookup.where_defined(g).where(F.col("name") == name), "id"), "matches": [{"id": r.id, "kind": r.kind, "file": r.file, "lines": [r.lineno, r.endlineno]} for r in found]}
        of = lambda kind: [r for r in found if r.kind == kind]
        pick = lambda df, key, value, i: self.ids(df.where(F.col(key) == i), value)
        if of("module"):
            out["modules"] = {r.id: {"dependencies": pick(neighbors.dependencies(g), "module", "imports", r.id), "dependents": pick(neighbors.dependents(g), "module", "imported_by", r.id)} for r in of("module")}
        if of("class"):
            out["classes"] = {
                r.id: {
                    "bases": pick(neighbors.bases(g), "class", "base", r.id),
                    "subclasses": pick(neighbors.subclasses(g), "class", "subclass", r.id),
                    "implements": pick(neighbors.implementers(g), "implementer", "protocol", r.id),
                    "implementers": pick(neighbors.implementers(g), "protocol", "implementer", r.id),
                    "family": pick(neighbors.family_siblings(g), "class", "sibling", r.id),
                    "registered_as": r.registry.asDict() if r.registry else None,
                }
                for r in of("class")
            }
        if of("function"):
            out["functions"] = {r.id: {"callers": pick(neighbors.callers(g), "symbol", "caller", r.id), "callees": pick(neighbors.callees(g), "symbol", "callee", r.id), "columns": self._touched(r.id, None)} for r in of("function")}
        symbols = [r.id for r in found if r.kind in ("class", "function")]
        if symbols:
            used: dict = {}
            for r in neighbors.used_by_root(g, self.spark.createDataFrame([(i,) for i in symbols], "symbol string")).collect():
                used.setdefault(r.symbol, {})[r.root] = r.n
            if used:
                out["used_by"] = used
        column = self._op_column(args)
        return out | ({"column": column} if column and (column["writes"] or column["reads"]) else {})

    def _touched(self, symbol: str, none: dict | None) -> dict | None:
        r = neighbors.columns_of(self.graph).where(F.col("symbol") == symbol).first()
        return none if r is None else {"reads": r.reads, "writes": r.writes}

    def _op_impact(self, args: dict) -> dict:
        symbol, depth = args["symbol"], int(args.get("depth", 2))
        found = text.impact_facts(self.graph, symbol, depth)
        return {"symbol": symbol, "impact": found, "markdown": text.impact_of(symbol, found)}

    def _op_resolve(self, args: dict) -> dict | None:
        return self.resolve(args["name"])

    def _op_search(self, args: dict) -> list:
        return self.rows(lookup.search(self.graph, args["term"], args.get("kind"), int(args.get("limit", 50))))

    def _op_families(self, args: dict) -> list:
        by: dict = {}
        for r in neighbors.families(self.graph).orderBy("protocol", "class").collect():
            by.setdefault(r.protocol, []).append({"class": r["class"], "key": r.key, "decorator": r.decorator})
        return [{"protocol": p, "members": m} for p, m in by.items()]

    def _op_column(self, args: dict) -> dict | None:
        r = neighbors.column_flow(self.graph).where(F.col("key") == args["name"].removeprefix("column:")).first()
        return None if r is None else {"writes": r.writes, "reads": r.reads}

    def _op_columns(self, args: dict) -> list:
        return self.ids(lookup.columns(self.graph, bool(args.get("all", False))), "key")

    def _op_columns_of(self, args: dict) -> dict:
        return self._touched(self.canonical(args["symbol"]), {"reads": [], "writes": []})

    def _op_callers(self, args: dict) -> list:
        return self.ids(neighbors.callers(self.graph).where(F.col("symbol") == self.canonical(args["symbol"])), "caller")

    def _op_callees(self, args: dict) -> list:
        return self.ids(neighbors.callees(self.graph).where(F.col("symbol") == self.canonical(args["symbol"])), "callee")

    def _op_implementers(self, args: dict) -> list:
        return self.ids(neighbors.implementers(self.graph).where(F.col("protocol") == self.canonical(args["protocol"])), "implementer")

    def _op_family(self, args: dict) -> dict:
        own = self.canonical(args["class"])
        return {"implements": self.ids(neighbors.implementers(self.graph).where(F.col("implementer") == own), "protocol"), "siblings": self.ids(neighbors.family_siblings(self.graph).where(F.col("class") == own), "sibling")}

    def _op_call_contract(self, args: dict) -> list:
        rows = neighbors.call_contract(self.graph).where(F.col("symbol") == self.canonical(args["symbol"]))
        return self.rows(rows.drop("symbol").orderBy("caller", "target"))

    def _op_locate(self, args: dict) -> dict:
        file = args["file"]
        if "line" in args:
            line = int(args["line"])
            r = locate.symbol_at(self.graph, self.spark.createDataFrame([(file, line)], "file string, line int")).first()
            return {"file": file, "line": line, "symbol": r.symbol if r else None}
        low, high = map(int, args["lines"])
        rows = locate.symbols_in_ranges(self.graph, self.spark.createDataFrame([(file, low, high)], "file string, start int, end int"))
        return {"file": file, "lines": [low, high], "symbols": self.ids(rows, "symbol")}

    def _op_review(self, args: dict) -> dict:
        ranges = [(h["file"], int(a), int(b)) for h in args.get("hunks") or [] for a, b in h["ranges"]]
        names = [(s,) for s in args.get("symbols") or []]
        hunks = self.spark.createDataFrame(ranges, "file string, start int, end int") if ranges else None
        symbols = self.spark.createDataFrame(names, "symbol string") if names else None
        if hunks is None and symbols is None:
            return {"changed": [], "summary": {"n_changed": 0, "high_risk": []}, "unresolved_hunks": []}
        changed = self.rows(review.review(self.graph, hunks, symbols).orderBy(F.desc("score"), "symbol"))
        return {"changed": changed, "summary": {"n_changed": len(changed), "high_risk": [c["symbol"] for c in changed if c["risk"] == "high"]}, "unresolved_hunks": self.rows(review.unresolved_hunks(self.graph, hunks)) if hunks is not None else []}

    def _op_architecture(self, args: dict) -> dict:
        return text.architecture_facts(self.graph)

    def _op_communities(self, args: dict) -> list:
        return sorted(self.rows(communities.communities(self.graph)), key=lambda c: (-c["size"], c["modules"][0]))

    def _op_flows(self, args: dict) -> dict:
        if not args.get("symbol"):
            return {"entry_points": self.ids(traverse.entry_points(self.graph), "id")}
        entry = self.canonical(args["symbol"])
        edges = self.rows(traverse.flow(self.graph, self.one(entry, "entry"), int(args.get("depth", 5))).drop("entry").orderBy("distance", "source", "target"))
        return {"entry": entry, "edges": edges, "reached": len({e["target"] for e in edges} - {entry}), "max_depth": max((e["distance"] for e in edges), default=0)}

    def _op_source(self, args: dict) -> dict:
        own = self.canonical(args["symbol"])
        r = self.graph.nodes.where(F.col("id") == own).select("file", "lineno", "endlineno").first()
        if r is None:
            return {"error": f"no such symbol: {args['symbol']!r}"}
        out: dict = {"id": own, "file": r.file, "lines": [r.lineno, r.endlineno], "code": None}
        if not r.file or r.lineno is None:
            return out | {"note": "it has no place in a file"}
        try:
            lines = (Path(self.source_root or ".") / r.file).read_text(encoding="utf-8").splitlines()
        except OSError as e:
            return out | {"note": f"its file can't be read: {e}"}
        return out | {"code": "\n".join(lines[r.lineno - 1 : r.endlineno or r.lineno])}

    def _op_report(self, args: dict) -> dict:
        kind = args["kind"]
        if kind == "impact":
            return {"kind": kind, "markdown": text.impact(self.graph, args["symbol"], int(args.get("depth", 2)))}
        if kind not in text.REPORTS:
            raise ValueError(f"no report of this kind: {kind!r}")
        return {"kind": kind, "markdown": text.REPORTS[kind](self.graph)}

    def _op_export(self, args: dict) -> dict:
        view = args["view"]
        if view == "rag":
            return {"view": view, "chunks": [json.loads(r.value) for r in rag.json_lines(self.graph).orderBy("id").collect()]}
        if view == "mermaid":
            return {"view": view, "diagram": text.diagram(self.graph, args.get("mkind", "class"), args.get("scope"), args.get("root"), int(args.get("depth", 2)))}
        if view == "vault":
            return {"view": view, "files": {r.path: r.content for r in text.vault(self.graph).collect()}}
        if view == "docs":
            return {"view": view, "markdown": text.living_docs(self.graph)}
        raise ValueError(f"no view of this name: {view!r}")
