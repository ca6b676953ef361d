"""python -m graphloom.cli COMMAND: build, scope, query, report, export, review, serve, refresh, route."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract.build import extract, extract_repo, sources
from graphloom.model import PropertyGraph, union
from graphloom.operators import locate, manifest, review
from graphloom.service import integrations
from graphloom.service.mcp import Server
from graphloom.service.session import Session
from graphloom.sinks import rag, symbols, text
from graphloom.sources import canonical
from graphloom.sources.freshness import Recipe
from graphloom.sources.git import git, state, top_level


def _spark() -> SparkSession:
    return SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").getOrCreate()


def _tracked(folder: str, use_git: bool) -> set[str] | None:
    """The files of a folder that git tracks, by paths that begin with the folder's own name; None where git isn't to be asked, or doesn't know the folder."""
    listed = git(folder, "ls-files", "-z") if use_git and "://" not in folder and Path(folder).is_dir() else None
    return None if not listed else {f"{Path(folder).resolve().name}/{p}" for p in listed.split("\0") if p}


def scope(spark: SparkSession, core: str, consumers: tuple[str, ...] = (), docs: tuple[str, ...] = (), use_git: bool = True, include: tuple[str, ...] = ("*.py", "*.md")) -> dict:
    """The manifest of the files that a build reads: id, profile, commit, and files; as git lists them, or as they lie in the folders."""
    parts: list[DataFrame] = []
    for folder, role in [(core, "core"), *[(c, Path(c).name) for c in consumers], *[(d, "docs") for d in docs]]:
        only = _tracked(folder, use_git)
        parts += [sources(spark, folder, g, only).where("text is not null").withColumn("role", F.lit(role)) for g in include]
    files = manifest.manifest(union(parts)).dropDuplicates(["path"]).cache()
    here = state(core, (".",)) if use_git else None
    return {
        "scope_id": manifest.scope_id(files).first().scope_id,
        "root": (top_level(core) if here else None) or str(Path(core).resolve().parent),
        "mode": "git" if here else "files",
        "profile": [r.asDict() for r in manifest.profile(files).collect()],
        "largest": [r.asDict() for r in manifest.largest(files).collect()],
        "git": here,
        "files": [r.asDict() for r in files.orderBy("path").collect()],
    }


def _manifest(path: str) -> dict:
    """A manifest from its own file, from a graph's recipe, or from that of the graph named."""
    read = Path(path)
    if Recipe(path).path.exists():
        read = Recipe(path).path
    doc = json.loads(read.read_text(encoding="utf-8"))
    return doc.get("scope", doc)


def _changes(spark: SparkSession, old: dict, new: dict) -> list:
    rows = [spark.createDataFrame([(f["path"], f["sha"]) for f in m["files"]], "path string, sha string") for m in (old, new)]
    return manifest.diff(*rows).orderBy("path").collect()


def _summary(found: dict) -> str:
    total = next(r for r in found["profile"] if r["role"] is None and r["ext"] is None)
    by = lambda key: ", ".join(f"{r[key]} {r['files']}" for r in sorted(found["profile"], key=lambda r: r[key] or "") if r[key])
    known = found["git"]
    at = f"{known['ref']} at {known['commit'][:10]}, {len(known['dirty_files'])} files changed" if known else "files as they lie in the folders"
    return "\n".join([f"scope {found['scope_id']}", f"root {found['root']}", f"{total['files']} files, {total['bytes']} bytes, {total['loc']} lines", at, f"by role: {by('role')}", f"by extension: {by('ext')}", ""])


def _graph(spark: SparkSession, args: argparse.Namespace) -> PropertyGraph:
    """From sources where --build is given, else from a stored document."""
    if args.build:
        return _said(extract(spark, args.build, args.deep))
    if not args.graph:
        raise ValueError("--graph or --build is needed")
    return canonical.load(spark, args.graph)


def _said(graph: PropertyGraph) -> PropertyGraph:
    """The graph, having named the files that it lacks."""
    for r in graph.skipped.orderBy("path").collect():
        print(f"left out {r.path}: {r.reason}", file=sys.stderr)
    return graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *, graph: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if graph:
            c.add_argument("--graph")
            c.add_argument("--build", metavar="PACKAGE")
            c.add_argument("--deep", action="store_true")
        return c

    for name in ("build", "scope"):
        c = command(name, graph=False)
        c.add_argument("package", **({"nargs": "?"} if name == "scope" else {}))
        c.add_argument("--consumers", nargs="*", default=[])
        c.add_argument("--docs", nargs="*", default=[])
        c.add_argument("-o", "--output")
    c.add_argument("--diff", nargs="+", metavar="MANIFEST", help="one to compare the package with, or two")
    c.add_argument("--no-git", action="store_true")
    c.add_argument("--include", nargs="*", default=["*.py", "*.md"])
    c.add_argument("--summary", action="store_true")
    c = sub.choices["build"]
    c.add_argument("--mode", choices=["thin", "full"], default="thin")
    c.add_argument("--full", dest="mode", action="store_const", const="full")
    c.add_argument("--deep", action="store_true")
    c = command("query")
    c.add_argument("name")
    c.add_argument("--format", choices=["json", "text"], default="json")
    c = command("report")
    c.add_argument("kind", choices=[*text.REPORTS, "impact"])
    c.add_argument("--symbol")
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--format", choices=["markdown", "md", "json"], default="markdown")
    c = command("export")
    c.add_argument("view", choices=["rag", "mermaid", "vault", "docs", "symbols", "index"])
    c.add_argument("-o", "--output")
    c.add_argument("--kind", default="class")
    c.add_argument("--scope")
    c.add_argument("--root")
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--project-root")
    c.add_argument("--package")
    c.add_argument("--package-version", default=".")
    c = command("review")
    c.add_argument("diff", nargs="?", default="-")
    c.add_argument("--format", choices=["markdown", "md", "json"], default="markdown")
    c = command("serve")
    c.add_argument("--source-root")
    c.add_argument("--mcp", action="store_true")
    command("refresh", graph=False).add_argument("graph")
    c = command("route", graph=False)
    c.add_argument("capability")
    c.add_argument("question")
    c.add_argument("--root", default=".")
    return p


def _emit(content: str, output: str | None) -> None:
    if output:
        Path(output).write_text(content, encoding="utf-8")
    else:
        sys.stdout.write(content)


def run(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.command == "refresh":
        known = Recipe(args.graph).facts()
        if not known.get("argv"):
            raise ValueError(f"nothing is recorded of how {args.graph} was built")
        os.chdir(known.get("cwd") or ".")
        return run(known["argv"])
    if args.command == "route":
        settings = integrations.config(args.root)
        tool = integrations.REGISTRY.resolve(args.capability, settings)
        if tool is None:
            raise ValueError(f"no tool that is switched on and installed offers {args.capability!r}")
        if tool.notice() and tool.name not in settings.acknowledged:
            print(tool.notice(), file=sys.stderr)
        _emit(json.dumps(tool.route(args.capability, args.question), ensure_ascii=False, indent=2) + "\n", None)
        return 0
    spark = _spark()
    if args.command == "scope":
        given = args.diff or []
        if len(given) > 2 or (len(given) < 2 and not args.package):
            raise ValueError("a package is needed, or two manifests to compare")
        found = None if len(given) == 2 else scope(spark, args.package, tuple(args.consumers), tuple(args.docs), not args.no_git, tuple(args.include))
        if given:
            rows = _changes(spark, _manifest(given[0]), found or _manifest(given[1]))
            _emit("".join(f"{r.change}\t{r.path}\n" for r in rows), args.output)
            return int(bool(rows))
        _emit(_summary(found) if args.summary else json.dumps(found, indent=2) + "\n", args.output)
        return 0
    if args.command == "build":
        consumers, docs = tuple(args.consumers), tuple(args.docs)
        graph = _said(extract_repo(spark, args.package, consumers, docs, args.mode, args.deep) if consumers or docs else extract(spark, args.package, args.deep))
        if args.output:
            canonical.save(graph, args.output)
            Recipe(args.output).keep(argv=argv, cwd=os.getcwd(), target=graph.target, scope=scope(spark, args.package, consumers, docs))
        else:
            sys.stdout.write(canonical.dumps(graph) + "\n")
        return 0
    graph = _graph(spark, args)
    if args.command == "query":
        out = Session(graph).handle({"op": "query", "args": {"name": args.name}})
        if not out["ok"]:
            raise ValueError(out["error"])
        _emit(text.answer(out["result"]) if args.format == "text" else json.dumps(out["result"], indent=2, ensure_ascii=False) + "\n", None)
        return int(not out["result"]["matches"] and not out["result"]["defined_at"] and "column" not in out["result"])
    if args.command == "report":
        if args.kind == "impact" and not args.symbol:
            raise ValueError("a report of impact needs --symbol")
        if args.format == "json":
            _emit(json.dumps(text.impact_facts(graph, args.symbol, args.depth) if args.kind == "impact" else text.FACTS[args.kind](graph), indent=2, ensure_ascii=False) + "\n", None)
        else:
            _emit(text.impact(graph, args.symbol, args.depth) if args.kind == "impact" else text.REPORTS[args.kind](graph), None)
    elif args.command == "export":
        if args.view == "mermaid":
            _emit(text.diagram(graph, args.kind, args.scope, args.root, args.depth), args.output)
        elif args.view == "docs":
            _emit(text.living_docs(graph), args.output)
        elif args.view == "vault":
            for r in text.vault(graph).toLocalIterator():
                path = Path(args.output or "vault") / r.path
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(r.content, encoding="utf-8")
        elif args.view == "index":
            symbols.write_index(graph, args.output or "index.scip", args.project_root or os.getcwd(), args.package, args.package_version)
        else:
            rows = rag.json_lines(graph).orderBy("id").select("value") if args.view == "rag" else symbols.index(graph, args.package, args.package_version).orderBy("file", "symbol").select(F.to_json(F.struct("*")).alias("value"))
            _emit("".join(r.value + "\n" for r in rows.toLocalIterator()), args.output)
    elif args.command == "review":
        diff = sys.stdin.read() if args.diff == "-" else Path(args.diff).read_text(encoding="utf-8")
        lines = spark.createDataFrame([("-", i, x) for i, x in enumerate(diff.splitlines())], "diff string, n int, line string")
        hunks = locate.diff_hunks(lines).select("file", "start", "end")
        found = review.review(graph, hunks)
        if args.format == "json":
            rows = found.orderBy(F.desc("score"), "symbol").collect()
            _emit("".join(json.dumps(r.asDict(True), ensure_ascii=False) + "\n" for r in rows), None)
        else:
            _emit(text.review(found, review.unresolved_hunks(graph, hunks)), None)
    else:
        session = Session(graph, args.source_root, args.graph)
        (Server(session) if args.mcp else session).serve(sys.stdin, sys.stdout)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
