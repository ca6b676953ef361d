"""Operators on small graphs written by hand, and traversals against plain Python on random ones."""

import io
import json
import random
from datetime import UTC, datetime

import pytest

from graphloom.model import EDGES, NODES, PropertyGraph, conform
from graphloom.operators import communities, locate, lookup, manifest, neighbors, review, structure, traverse
from graphloom.operators.communities import greedy_modularity
from graphloom.service.session import Session
from graphloom.sinks import rag, symbols, text
from graphloom.sources import canonical, freshness


def build(spark, nodes, edges, target="p"):
    """nodes: id -> kind or dict; edges: (type, source, target[, extras])."""
    rows = [{"id": i, **({"kind": n} if isinstance(n, str) else n)} for i, n in nodes.items()]
    doc = {"graph_schema": "0.9", "target": target, "nodes": rows, "edges": [{"type": e[0], "source": e[1], "target": e[2], "extras": e[3] if len(e) > 3 else {}} for e in edges]}
    ns = spark.createDataFrame([(json.dumps(r),) for r in doc["nodes"]], "v string")
    es = spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(doc["edges"])], "v string, ord long")
    from pyspark.sql import functions as F

    n = ns.select(F.from_json("v", NODES.replace(" not null", "")).alias("r")).select("r.*")
    e = es.select(F.from_json("v", EDGES.replace(" not null", "")).alias("r"), F.col("ord").alias("o")).select("r.*", "o").drop("ord").withColumnRenamed("o", "ord")
    return PropertyGraph(target, conform(n, NODES).cache(), conform(e, EDGES).cache())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def names(spark, *values, column="input"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_chain_of_callers(spark):
    g = build(spark, {f"p.{x}": "function" for x in "ABCD"}, [("calls", "p.B", "p.A"), ("calls", "p.C", "p.B"), ("calls", "p.D", "p.C")])
    far = traverse.impact(g, names(spark, "p.A", column="symbol"), depth=3)
    assert rows(traverse.impact_by_distance(far), "distance", "n") == [(1, 1), (2, 1), (3, 1)]
    assert traverse.impact(g, names(spark, "p.A", column="symbol"), depth=2).count() == 2
    assert rows(traverse.flow(g, names(spark, "p.D", column="entry"), 5), "target", "distance") == [("p.A", 3), ("p.B", 2), ("p.C", 1)]
    assert rows(traverse.entry_points(g), "id") == [("p.D",)]


def test_risk(spark):
    cases = {(0, 0, 0): "none", (1, 1, 1): "low", (5, 1, 1): "medium", (1, 2, 1): "medium", (1, 1, 2): "medium", (30, 1, 1): "high", (2, 1, 4): "high", (15, 3, 1): "high", (15, 2, 1): "medium"}
    df = spark.createDataFrame(list(cases), "b int, r int, o int")
    assert {(x.b, x.r, x.o): x.risk for x in df.withColumn("risk", traverse.risk("b", "r", "o")).collect()} == cases


def test_two_triangles(spark):
    edges = [("p.a.x", "p.a.y"), ("p.a.y", "p.a.z"), ("p.a.z", "p.a.x"), ("p.b.x", "p.b.y"), ("p.b.y", "p.b.z"), ("p.b.z", "p.b.x"), ("p.a.x", "p.b.x")]
    g = build(spark, {m: "module" for e in edges for m in e}, [("imports", *e) for e in edges])
    assert rows(communities.communities(g), "label", "size", "modules") == [("a", 3, ["p.a.x", "p.a.y", "p.a.z"]), ("b", 3, ["p.b.x", "p.b.y", "p.b.z"])]
    assert rows(traverse.import_cycles(g), "path") == [(["p.a.x", "p.a.y", "p.a.z"],), (["p.b.x", "p.b.y", "p.b.z"],)]
    assert rows(structure.layer_edges(g), "source_layer", "target_layer", "n") == [("a", "b", 1)] and structure.layer_violations(g).count() == 0
    assert greedy_modularity(["q"], []) == [["q"]]
    assert communities.communities(build(spark, {"p.m": "module"}, [])).count() == 0


def test_layers_that_import_each_other(spark):
    g = build(spark, {"p": "module", "p.a": "module", "p.a.x": "module", "p.b": "module"}, [("imports", "p.a.x", "p.b"), ("imports", "p.b", "p.a"), ("imports", "p.b", "p.a")])
    assert rows(structure.layer_violations(g), "layer_a", "layer_b") == [("a", "b")]
    assert rows(structure.coupling(g), "module", "ca", "ce", "instability") == [("p", 0, 0, 0.0), ("p.a", 1, 0, 0.0), ("p.a.x", 0, 1, 1.0), ("p.b", 1, 1, 0.5)]
    assert rows(structure.orphan_modules(g), "module") == [("p.a.x",)]


def test_prefixes_are_no_wildcards(spark):
    g = build(spark, {i: "class" for i in ("p.a_b", "p.a_b.c", "p.axb.c", "p.a_bc", "u.m")}, [("calls", "u.m", "p.a_b.c"), ("calls", "u.m", "p.axb.c"), ("calls", "u.m", "p.a_bc"), ("calls", "p.a_b.c", "p.a_b")])
    assert rows(neighbors.references_to(g, names(spark, "p.a_b", column="symbol")), "source", "target") == [("u.m", "p.a_b.c")]
    assert rows(lookup.members(g).where("symbol = 'p.a_b'"), "member") == [("p.a_b",), ("p.a_b.c",)]


def test_ambiguous_names(spark):
    g = build(spark, {i: "function" for i in ("p.a.f", "p.b.f", "p.longer.f", "p.a.only")}, [("export", "p", "p.b.f", {"as": "g"})])
    got = {r.input: (r.id, r.ambiguous, r.alternatives) for r in lookup.resolve(g, names(spark, "f", "p.b.f", "p.b.x.f", "z.only", "none")).collect()}
    assert got == {"f": ("p.a.f", True, ["p.b.f", "p.longer.f"]), "p.b.f": ("p.b.f", False, []), "p.b.x.f": ("p.b.f", False, ["p.a.f", "p.longer.f"]), "z.only": ("p.a.only", False, [])}
    assert rows(lookup.impact_targets(g, names(spark, "f", "g", "z.only")), "input", "id") == [("f", "p.a.f"), ("f", "p.b.f"), ("f", "p.longer.f"), ("g", "p.b.f"), ("z.only", "p.a.only")]


def test_first_hit_counts_farther_out(spark):
    """At distance 1 every reference counts; farther out a source counts once, by the smallest target and type."""
    edges = [("calls", "b", "a"), ("references", "b", "a"), ("calls", "c", "a"), ("inherits", "d", "c"), ("calls", "d", "b"), ("references", "d", "b"), ("calls", "b", "c")]
    g = build(spark, {x: "function" for x in "abcd"}, edges)
    assert rows(traverse.impact(g, names(spark, "a", column="symbol")), "source", "type", "target", "distance") == [("b", "calls", "a", 1), ("b", "references", "a", 1), ("c", "calls", "a", 1), ("d", "calls", "b", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals_of_random_graphs(spark, seed):
    random.seed(seed)
    ids = [f"p.m{i % 4}.f{i}" for i in range(30)]
    edges = sorted({(random.choice(["calls", "references"]), random.choice(ids), random.choice(ids)) for _ in range(70)})
    g = build(spark, {i: "function" for i in ids}, edges)
    got = {}
    for r in traverse.impact(g, depth=3).collect():
        got.setdefault(r.symbol, []).append((r.source, r.type, r.target, r.distance))
    for s in ids:
        own = [e for e in edges if e[2] == s and e[1] != s]
        want, seen, level = [(a, t, b, 1) for t, a, b in own], {s} | {e[1] for e in own}, {e[1] for e in own}
        for d in (2, 3):
            new = set()
            for node in sorted(level):
                for t, a, b in edges:
                    if b == node and a not in seen:
                        seen.add(a)
                        new.add(a)
                        want.append((a, t, b, d))
            level = new
        assert sorted(got.get(s, [])) == sorted(want)
    calls = {(a, b) for t, a, b in edges if t == "calls"}
    starts = ids[:6]
    flows = {}
    for r in traverse.flow(g, names(spark, *starts, column="entry"), 4).collect():
        flows.setdefault(r.entry, set()).add((r.source, r.target, r.distance))
    for s in starts:
        seen, level, want = {s}, {s}, set()
        for d in range(1, 5):
            step = {(a, b) for a, b in calls if a in level}
            want |= {(a, b, d) for a, b in step}
            level = {b for _, b in step} - seen
            seen |= level
        assert flows.get(s, set()) == want
    arcs = {(a, b) for a, b in calls if a != b}
    imports = build(spark, {i: "module" for i in ids}, [("imports", *e) for e in arcs])
    circuits = set()

    def walk(path):
        for a, b in arcs:
            if a == path[-1]:
                if b == path[0]:
                    circuits.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 5:
                    walk([*path, b])

    for i in ids:
        walk([i])
    assert {tuple(r.path) for r in traverse.import_cycles(imports, 5).collect()} == circuits


def test_places(spark):
    at = lambda kind, low=None, high=None: {"kind": kind, "file": "f.py", "lineno": low, "endlineno": high}
    g = build(spark, {"p.f": at("module"), "p.f.C": at("class", 10, 900), "p.f.C.m": at("function", 20, 30), "p.f.C.n": at("function", 700, 720), "p.f.x": at("attribute", 5)}, [])
    asked = spark.createDataFrame([("f.py", n) for n in (1, 5, 10, 25, 31, 705, 901)] + [("g.py", 1)], "file string, line int")
    assert {r.line: r.symbol for r in locate.symbol_at(g, asked).collect()} == {1: "p.f", 5: "p.f.x", 10: "p.f.C", 25: "p.f.C.m", 31: "p.f.C", 705: "p.f.C.n", 901: "p.f"}
    hunks = spark.createDataFrame([("f.py", 29, 32), ("h.py", 1, 2)], "file string, start int, end int")
    assert rows(locate.symbols_in_ranges(g, hunks), "symbol") == [("p.f.C",), ("p.f.C.m",)]
    assert rows(review.unresolved_hunks(g, hunks), "file") == [("h.py",)]


def test_unified_diffs(spark):
    diff = "--- a/x.py\n+++ b/x.py\t2020\n@@ -1,2 +3,4 @@ def f\n+a\n@@ -9 +20 @@\n@@ -30,2 +31,0 @@\n--- a/y.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n+++ b/d/z.py\n@@ -0,0 +1,2 @@\nnoise\n"
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(diff.split("\n"))], "diff string, n int, line string")
    assert rows(locate.diff_hunks(lines), "file", "start", "end") == [("d/z.py", 1, 2), ("x.py", 3, 6), ("x.py", 20, 20), ("x.py", 31, 31)]


def test_contracts_columns_families(spark):
    nodes = {"p.C": "class", "p.C.m": "function", "p.f": "function", "column:a": {"kind": "column", "extras": {"key": "a", "subscripted": True}}, "column:b": {"kind": "column", "extras": {"key": "b", "subscripted": False}}, "p.I": {"kind": "class", "extras": {"registry": {"decorator": "R.register", "key": "i"}}}}
    edges = [("calls", "p.f", "p.C.m", {"callsites": 2, "posargs": [1], "kwargs": ["k"]}), ("calls", "p.g", "p.C", {"resolution": "registry"}), ("writes", "p.f", "column:a"), ("reads", "p.C.m", "column:a"), ("implements", "p.I", "P"), ("implements", "q.J", "P")]
    g = build(spark, nodes, edges)
    assert rows(neighbors.call_contract(g), "symbol", "caller", "target", "callsites", "posargs", "kwargs", "splat") == [("p.C", "p.f", "p.C.m", 2, [1], ["k"], False), ("p.C.m", "p.f", "p.C.m", 2, [1], ["k"], False)]
    assert rows(neighbors.column_flow(g), "key", "writes", "reads") == [("a", ["p.f"], ["p.C.m"]), ("b", [], [])]
    assert rows(lookup.columns(g), "key") == [("a",)] and rows(lookup.columns(g, True), "key") == [("a",), ("b",)]
    assert rows(neighbors.families(g).fillna(""), "protocol", "class", "key") == [("P", "p.I", "i"), ("P", "q.J", "")]
    assert rows(neighbors.family_siblings(g), "class", "sibling") == [("p.I", "q.J"), ("q.J", "p.I")]


def test_symbol_descriptors(spark):
    g = build(spark, {"p": "module", "p.m": "module", "p.m.C": "class", "p.m.C.f": "function", "p.m.C.x": "attribute", "p.m.odd-name": "function", "q.gone.f": "function"}, [("inherits", "p.m.C", "p.m.C")])
    assert dict(rows(symbols.descriptors(g), "id", "descriptor")) == {"p": "p/", "p.m": "p/m/", "p.m.C": "p/m/C#", "p.m.C.f": "p/m/C#f().", "p.m.C.x": "p/m/C#x.", "p.m.odd-name": "p/m/`odd-name`().", "q.gone.f": "q/gone/f()."}
    assert dict(rows(symbols.symbol_kind(g), "id", "symbol_kind"))["p.m.C.f"] == "Method"


def test_manifests(spark):
    files = spark.createDataFrame([("a/x.py", "1\n2"), ("a/y.md", ""), ("b/z", "q\n")], "path string, text string")
    m = manifest.manifest(files)
    assert rows(m, "path", "ext", "bytes", "loc") == [("a/x.py", ".py", 3, 2), ("a/y.md", ".md", 0, 0), ("b/z", "—", 2, 1)]
    import hashlib

    text_ = "\n".join(f"{r.path}\t{r.sha}" for r in sorted(m.collect()))
    assert manifest.scope_id(m).first().scope_id == "sha256:" + hashlib.sha256(text_.encode()).hexdigest()
    other = manifest.manifest(spark.createDataFrame([("a/x.py", "1\n3"), ("b/z", "q\n"), ("n", "")], "path string, text string"))
    assert rows(manifest.diff(m, other), "path", "change") == [("a/x.py", "changed"), ("a/y.md", "removed"), ("n", "added")]
    roots = spark.createDataFrame([("a", "one"), ("a/x.py", "exact")], "prefix string, role string")
    assert rows(manifest.assign_roles(files, roots), "path", "role") == [("a/x.py", "exact"), ("a/y.md", "one"), ("b/z", "core")]


@pytest.fixture(scope="module")
def small(spark):
    nodes = {
        "p": {"kind": "module", "file": "p/__init__.py"},
        "p.m": {"kind": "module", "file": "p/m.py"},
        "p.m.C": {"kind": "class", "file": "p/m.py", "lineno": 1, "endlineno": 9, "docstring": "A class.\nMore."},
        "p.m.C.f": {"kind": "function", "file": "p/m.py", "lineno": 2, "endlineno": 4, "signature": "f(self)", "extras": {"odd": {"x": 1}, "returns": "List[Q]"}},
        "p.m.g": {"kind": "function", "visibility": "private", "decorators": ["d.e"]},
        "t.x": {"kind": "module", "extras": {"root": "tests"}},
    }
    edges = [("contains", "p.m", "p.m.C"), ("contains", "p.m.C", "p.m.C.f"), ("calls", "p.m.C.f", "p.m.g", {"callsites": 1, "resolution": "module"}), ("calls", "t.x", "p.m.C", {"callsites": 1}), ("imports", "t.x", "p.m"), ("inherits", "p.m.C", "abc.ABC", {"external": True}), ("imports", "p", "p.m"), ("calls", "t.x", "p.m.C", {"callsites": 3})]
    return build(spark, nodes, edges)


def test_canonical_document(spark, tmp_path):
    doc = {"other_schema": "0.9", "target": "p", "nodes": [{"id": "p.b", "kind": "function", "extras": {"returns": "int", "odd": {"x": [1]}}}, {"id": "p.a", "kind": "class"}, {"id": "p.a", "kind": "module", "docstring": "é"}], "edges": [{"type": "calls", "source": "p.b", "target": "z", "extras": {"callsites": 2, "new": "v"}}, {"type": "calls", "source": "p.b", "target": "z", "extras": {}}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(doc))
    g = canonical.load(spark, str(path))
    once = canonical.dumps(g)
    out = json.loads(once)
    assert [n["id"] for n in out["nodes"]] == ["p.a", "p.b"] and out["nodes"][0]["kind"] == "module" and out["nodes"][1]["extras"] == {"returns": "int", "odd": {"x": [1]}}
    assert [e["extras"] for e in out["edges"]] == [{"callsites": 2, "new": "v"}, {}] and "é" in once
    canonical.save(g, str(path))
    assert path.read_text() == once + "\n" and canonical.dumps(canonical.load(spark, str(path))) == once
    canonical.write_tables(g, str(tmp_path / "tables"))
    assert canonical.dumps(canonical.read_tables(spark, str(tmp_path / "tables"))) == once
    path.write_text(json.dumps(doc | {"other_schema": "7.0"}))
    with pytest.raises(ValueError):
        canonical.load(spark, str(path))
    assert freshness.age(str(tmp_path / "none")) is None and freshness.age(str(path), now=datetime.fromtimestamp(0, UTC))["age_seconds"] == 0 and freshness.age(None) is None
    assert freshness.Recipe(str(path)).keep(argv=["build"], cwd="/", target="p") and not freshness.Recipe(str(tmp_path / "no" / "folder")).keep(argv=[])
    assert freshness.age(str(path))["rebuild"] == {"argv": ["build"], "cwd": "/"}


def test_session(small, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/m.py").write_text("class C:\n    def f(self):\n        return g()\n    #\n")
    s = Session(small, str(tmp_path))
    ask = lambda op, **args: s.handle({"op": op, "args": args})
    assert ask("ping")["result"] == "pong" and ask("nothing")["ok"] is False and "impact" in ask("nothing")["ops"] and len(s.ops) == 23
    assert ask("stats")["result"]["edge_types"]["calls"] == 3
    assert ask("callers", symbol="C")["result"] == ["t.x"] and ask("callers", symbol="C")["resolved"]["id"] == "p.m.C" and "epistemic" in ask("callers", symbol="C")
    impact = ask("impact", symbol="p.m")["result"]["impact"][0]
    assert impact["by_root"] == {"core": {"imports": 1}, "tests": {"calls": 2, "imports": 1}} and impact["risk"] == "medium"
    assert ask("query", name="C")["result"]["used_by"] == {"p.m.C": {"tests": 2}} and ask("query", name="f")["result"]["functions"]["p.m.C.f"]["callees"] == ["p.m.g"]
    assert ask("locate", file="p/m.py", line=3)["result"]["symbol"] == "p.m.C.f" and ask("locate", file="p/m.py", lines=[4, 5])["result"]["symbols"] == ["p.m.C", "p.m.C.f"]
    assert ask("source", symbol="f")["result"]["code"].startswith("    def f(self):")
    assert ask("flows")["result"] == {"entry_points": ["p.m.C.f"]} and ask("flows", symbol="p.m.C.f")["result"]["reached"] == 1
    assert ask("review", symbols=["p.m.g"])["result"]["changed"][0]["n_callers"] == 1 and ask("review")["result"]["changed"] == []
    assert ask("search", term="M.c")["result"][0]["id"] == "p.m.C" and ask("search", term="x", limit=-1)["ok"] is False
    assert ask("families")["result"] == [] and ask("column", name="k")["result"] is None and ask("columns")["result"] == [] and ask("columns_of", symbol="p.m.g")["result"] == {"reads": [], "writes": []}
    assert ask("call_contract", symbol="p.m.C")["result"][0]["callsites"] in (1, 3) and ask("family", **{"class": "p.m.C"})["result"] == {"implements": [], "siblings": []}
    assert ask("architecture")["result"]["coupling"][0]["module"] == "p.m" and ask("communities")["ok"] and ask("implementers", protocol="x")["result"] == []
    assert ask("callees", symbol="f")["result"] == ["p.m.g"] and ask("resolve", name="none")["result"] is None
    for kind in text.REPORTS:
        assert ask("report", kind=kind)["result"]["markdown"].startswith("#")
    assert "tests" in ask("report", kind="impact", symbol="p.m.C")["result"]["markdown"] and ask("report", kind="?")["ok"] is False
    for view in ("rag", "mermaid", "vault", "docs"):
        assert ask("export", view=view)["ok"]
    assert ask("export", view="?")["ok"] is False and ask("callers")["ok"] is False
    out = io.StringIO()
    s.serve(io.StringIO('{"op": "ping"}\n\nno json\n[1]\n'), out)
    assert [json.loads(x)["ok"] for x in out.getvalue().splitlines()] == [True, False, False]


def test_exports(small):
    chunks = {json.loads(r.value)["id"]: json.loads(r.value) for r in rag.json_lines(small).collect()}
    assert set(chunks) == {"p.m.C", "p.m.C.f", "p.m.g"}
    assert chunks["p.m.C"]["text"] == "class C in p.m. A class. Inherits: ABC. Called by: x. Methods call: g (via f)." and chunks["p.m.C"]["lines"] == [1, 9] and "signature" not in chunks["p.m.C"]
    notes = {r.path: r.content for r in text.vault(small).collect()}
    assert "- [[p.m.C|C]]" in notes["p.m.md"] and "- `abc.ABC`" in notes["p.m.C.md"] and "[[t.x|x]] _(tests)_" in notes["p.m.C.md"] and "index.md" in notes
    assert "abc_ABC <|-- p_m_C" in text.diagram(small) and "p --> p_m" in text.diagram(small, "deps") and "p_m_C_f --> p_m_g" in text.diagram(small, "calls", root="f")
    for bad in (lambda: text.diagram(small, "?"), lambda: text.diagram(small, "calls")):
        with pytest.raises(ValueError):
            bad()
    found = {r.symbol.split(" ")[-1]: (r.start, r.end, r.language) for r in symbols.index(small).collect()}
    assert found["p/m/C#"] == (0, 8, "Python") and found["p/m/C#f()."] == (1, 3, "Python")


def test_index_in_protocol_buffers(small, tmp_path):
    symbols.write_index(small, str(tmp_path / "i"), "/x")

    def fields(raw):
        i, out = 0, []
        while i < len(raw):
            key, i = number(raw, i)
            value, i = number(raw, i)
            if key & 7 == 2:
                value, i = raw[i : i + value], i + value
            out.append((key >> 3, value))
        return out

    def number(raw, i):
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return n, i

    top = fields((tmp_path / "i").read_bytes())
    docs = [fields(v) for f, v in top if f == 2]
    assert [dict(d)[1] for d in docs] == [b"p/__init__.py", b"p/m.py"] and dict(docs[1])[4] == b"Python"
    own = [dict(fields(v)) for f, v in docs[1] if f == 3]
    assert {o[1].split()[-1]: o.get(5) for o in own} == {b"p/m/": 29, b"p/m/C#": 7, b"p/m/C#f().": 26}
    places = {dict(fields(v))[2].split()[-1]: dict(fields(v)) for f, v in docs[1] if f == 2}
    assert dict(fields(places[b"p/m/C#f()."][8])) == {1: 1} and dict(fields(places[b"p/m/C#f()."][11])) == {1: 1, 3: 3}


def test_git_lists_files(spark, tmp_path):
    from graphloom.sources import git

    if git.git(str(tmp_path), "init") is None:
        pytest.skip("no git here")
    (tmp_path / "a b.py").write_text("x")
    git.git(str(tmp_path), "add", ".")
    assert [r.path for r in git.tracked(spark, str(tmp_path)).collect()] == ["a b.py"] and len(git.tracked(spark, str(tmp_path)).first().blob) == 40
    assert git.state(str(tmp_path)) is None or git.state(str(tmp_path))["dirty"]
