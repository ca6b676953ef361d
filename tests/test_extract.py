"""Extraction from small packages written here."""

import textwrap

import pytest

from graphloom.extract.build import extract, extract_files, extract_repo
from graphloom.extract.facts import python_facts

FILES = {
    "shop/__init__.py": '''
        """A shop."""
        from shop.engine import Engine as Motor, _hidden
        from .registry import Registry
        import json
        __all__ = ["Motor"]
    ''',
    "shop/engine.py": '''
        """Engines."""
        from typing import List, Optional
        import os.path as osp
        from shop.util import helper

        LIMIT: int = 3

        def deprecated(f):
            return f

        class Base:
            def shared(self):
                return 1

        class Engine(Base):
            """An engine.

            It runs.
            """
            size = 1

            def __init__(self, name: str, *args, key: Optional[int] = None, **more):
                self.name = name

            @property
            def title(self) -> str:
                return self.name

            async def run(self, rows: List[int]) -> Optional["Engine"]:
                try:
                    for r in rows:
                        if r:
                            helper(r, 2, flag=True)
                            helper(*rows)
                finally:
                    self._step()
                self.shared()
                self.missing()
                print(osp.join("a", "b"))
                unknown()

                def inner():
                    other()
                yield 1

            def _step(self):
                helper(1)
                table = {}
                table["out"] = table["in"]
                return {"total": 1}

        @deprecated
        def _old():
            pass

        def _hidden():
            return Engine("x")
    ''',
    "shop/util.py": '''
        def helper(x, y=1, flag=False):
            return x
    ''',
    "shop/registry.py": '''
        from typing import Protocol

        class PartStrategy(Protocol):
            def work(self) -> int: ...

        class Registry:
            @classmethod
            def register_part_strategy(cls, name):
                return lambda c: c

            @classmethod
            def get_part(cls, name):
                return None
    ''',
    "shop/parts.py": '''
        from shop.registry import Registry

        @Registry.register_part_strategy('one')
        class One:
            def work(self): return 1

        @Registry.register_part_strategy('two')
        class Two:
            def work(self): return 2
    ''',
    "shop/user.py": '''
        from shop.registry import Registry

        def create_part(name):
            return Registry.get_part(name)

        class User:
            def __init__(self, name):
                self.part = create_part(name)

            def go(self):
                return self.part.work()

        def exact():
            return Registry.get_part('one')
    ''',
    "shop/broken.py": "def (",
    "shop/__pycache__/x.py": "def ignored(): pass",
    "use/run.py": '''
        from shop import Motor
        import shop.util as u

        def main():
            Motor("a")
            u.helper(1, flag=2)

        x = Motor
    ''',
    "docs/guide.md": "# Guide\n\nfrom shop import Motor, Registry as R\n\nSee shop.engine.Engine and shop.nothing.Here.\n",
    "docs/empty.md": "nothing",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(textwrap.dedent(text).lstrip("\n"))
    return root


@pytest.fixture(scope="module")
def shop(spark, folder):
    g = extract(spark, str(folder / "shop"))
    return g.target, {r.id: r for r in g.nodes.collect()}, g.edges.orderBy("ord").collect()


def pairs(edges, kind):
    return sorted((e.source, e.target) for e in edges if e.type == kind)


def test_definitions(shop):
    target, nodes, edges = shop
    assert target == "shop" and not any("ignored" in n or "broken" in n for n in nodes)
    run, engine = nodes["shop.engine.Engine.run"], nodes["shop.engine.Engine"]
    assert run.signature == "run(self, rows: List[int]) -> Optional['Engine']" and run.file == "shop/engine.py"
    assert [(p.name, p.type) for p in run.extras.params] == [("rows", "List[int]")] and run.extras.returns == "Optional['Engine']"
    assert nodes["shop.engine.Engine.__init__"].signature == "__init__(self, name: str, args = (), key: Optional[int] = None, more = {})"
    assert engine.docstring == "An engine.\n\nIt runs." and engine.visibility == "public"
    assert nodes["shop.engine.Engine.title"].kind == nodes["shop.engine.Engine.name"].kind == nodes["shop.engine.Engine.size"].kind == nodes["shop.engine.LIMIT"].kind == "attribute"
    assert nodes["shop.engine.LIMIT"].extras.annotation == "int"
    assert nodes["shop.engine._old"].is_deprecated and nodes["shop.engine._old"].visibility == "private"
    assert "shop.engine.Engine.run.inner" not in nodes
    c = run.extras.control
    assert (c.branches, c.loops, c["try"], c.generator, c["async"]) == (1, 1, True, True, True)
    assert {("shop", "shop.engine"), ("shop.engine", "shop.engine.Engine"), ("shop.engine.Engine", "shop.engine.Engine.name")} <= set(pairs(edges, "contains"))


def test_names_are_resolved(shop):
    _, _, edges = shop
    assert pairs(edges, "imports") == [("shop", "shop.engine"), ("shop", "shop.registry"), ("shop.engine", "shop.util"), ("shop.parts", "shop.registry"), ("shop.user", "shop.registry")]
    assert [(e.source, e.target, e.extras["as"], e.extras.public) for e in edges if e.type == "export" and e.source == "shop"] == [("shop", "shop.engine.Engine", "Motor", True), ("shop", "shop.engine._hidden", "_hidden", False), ("shop", "shop.registry.Registry", "Registry", False)]
    assert pairs(edges, "inherits") == [("shop.engine.Engine", "shop.engine.Base"), ("shop.registry.PartStrategy", "typing.Protocol")]
    assert [e.extras.external for e in edges if e.type == "inherits"] == [None, True]
    assert ("shop.engine._old", "shop.engine.deprecated") in pairs(edges, "decorated_by")


def test_calls_and_contracts(shop):
    _, nodes, edges = shop
    by = {(e.source, e.target): e.extras for e in edges if e.type == "calls"}
    helper = by["shop.engine.Engine.run", "shop.util.helper"]
    assert (helper.resolution, helper.callsites, helper.posargs, helper.kwargs, helper.splat) == ("imported", 2, [2], ["flag"], True)
    assert by["shop.engine.Engine.run", "shop.engine.Engine._step"].resolution == "self"
    assert by["shop.engine.Engine.run", "shop.engine.Engine.shared"].resolution == "self"  # a member of the base class
    assert by["shop.engine._hidden", "shop.engine.Engine"].resolution == "module"
    calls = nodes["shop.engine.Engine.run"].extras.calls
    assert (calls.out, calls.resolved, calls.external, calls.unresolved, calls.dynamic) == (8, 4, 2, 2, 0)


def test_string_keys(shop):
    _, nodes, edges = shop
    assert pairs(edges, "writes") == [("shop.engine.Engine._step", "column:out"), ("shop.engine.Engine._step", "column:total")]
    assert pairs(edges, "reads") == [("shop.engine.Engine._step", "column:in"), ("shop.engine.Engine.run", "column:Engine")]  # a quoted type counts
    assert nodes["column:out"].extras.subscripted and not nodes["column:total"].extras.subscripted


def test_registries(shop):
    _, nodes, edges = shop
    assert nodes["shop.parts.One"].extras.registry == ("shop.registry.Registry.register_part_strategy", "one")
    assert pairs(edges, "implements") == [("shop.parts.One", "shop.registry.PartStrategy"), ("shop.parts.Two", "shop.registry.PartStrategy")]
    by = {(e.source, e.target): e.extras.resolution for e in edges if e.type == "calls" and (e.extras.resolution or "").startswith("registry")}
    assert by["shop.user.exact", "shop.parts.One"] == "registry" and ("shop.user.exact", "shop.parts.Two") not in by
    assert by["shop.user.User.go", "shop.parts.One.work"] == by["shop.user.create_part", "shop.parts.Two"] == "registry-candidate"


def test_order_is_canonical(shop):
    _, _, edges = shop
    keys = [(e.type, e.source, e.target) for e in edges]
    assert keys == sorted(keys) and [e.ord for e in edges] == list(range(1, len(edges) + 1))


def test_consumers_and_documents(spark, folder):
    args = dict(consumers=(str(folder / "use"),), docs=(str(folder / "docs"), str(folder / "none")))
    g = extract_repo(spark, str(folder / "shop"), **args)
    nodes, edges = {r.id: r for r in g.nodes.collect()}, g.edges.collect()
    assert nodes["use.run"].extras.root == "use" and nodes["docs/guide.md"].extras.root == "docs" and "docs/empty.md" not in nodes
    assert [(t, s) for s, t in pairs(edges, "imports") if s == "use.run"] == [("shop", "use.run"), ("shop.util", "use.run")]
    calls = {e.target: e.extras for e in edges if e.type == "calls" and e.source == "use.run"}
    assert set(calls) == {"shop.engine.Engine", "shop.util.helper"} and calls["shop.util.helper"].kwargs == ["flag"]
    assert pairs(edges, "references") == [("docs/guide.md", "shop.engine.Engine"), ("docs/guide.md", "shop.registry.Registry")]
    full = extract_repo(spark, str(folder / "shop"), mode="full", **args)
    edges = full.edges.collect()
    assert ("use.run.main", "shop.engine.Engine") in pairs(edges, "calls") and ("use.run", "shop.engine.Engine") in pairs(edges, "references") and ("use.run", "use.run.main") in pairs(edges, "contains")


def test_errors(spark, folder):
    with pytest.raises(ValueError):
        extract_repo(spark, str(folder / "shop"), mode="other")
    with pytest.raises(NotADirectoryError):
        extract(spark, str(folder / "nowhere"))
    assert [r[:2] for r in python_facts("a", "def (", False, "a.py")] == [("skipped", "a.py")]


DEEP = {
    "pk/__init__.py": "from pk.core import Engine\n",
    "pk/core.py": "class Base:\n    def stop(self): ...\n\nclass Engine(Base):\n    def run(self):\n        return self._step()\n    def _step(self): ...\n\ndef make():\n    return Engine()\n",
    "pk/app.py": "import pk\nfrom pk.core import Engine, make\n\ndef local():\n    e = Engine()\n    e.run()\n    e.fly()\n\ndef given(e: Engine, f: 'Engine', g: int):\n    e.stop()\n    f.run()\n    g.run()\n\ndef chain():\n    pk.Engine().run()\n    with Engine() as x:\n        x.stop()\n\ndef lost():\n    e = Engine()\n    e = other()\n    e.run()\n    m = make()\n    m.run()\n\nclass Car:\n    def __init__(self):\n        self.engine = Engine()\n    def go(self):\n        self.engine.run()\n",
    "pk/deep.py": "x = " + "+".join(["1"] * 5000) + "\n",
}


def test_calls_by_type(spark):
    files = spark.createDataFrame(list(DEEP.items()), "path string, text string")
    fast, deep = ({(e.source, e.target, e.extras.resolution) for e in extract_files(files, "pk", how).of("calls").collect()} for how in (False, True))
    assert not any(t == "pk.core.Engine.run" for _, t, _ in fast) and {r for _, _, r in deep} == {"deep"}
    assert {(s, t) for s, t, _ in deep} - {(s, t) for s, t, _ in fast} == {
        ("pk.app.local", "pk.core.Engine.run"), ("pk.app.given", "pk.core.Engine.stop"), ("pk.app.given", "pk.core.Engine.run"), ("pk.app.chain", "pk.core.Engine.run"), ("pk.app.chain", "pk.core.Engine.stop"), ("pk.app.Car.go", "pk.core.Engine.run"),
    }
    assert {(s, t) for s, t, _ in fast} <= {(s, t) for s, t, _ in deep} and ("pk.core.Engine.run", "pk.core.Engine._step", "deep") in deep


def test_files_left_out_are_named(spark):
    files = spark.createDataFrame([*DEEP.items(), ("pk/bad.py", "def (:"), ("pk/none.py", None)], "path string, text string")
    graph = extract_files(files, "pk")
    assert {r.path: r.reason.split(":")[0] for r in graph.skipped.collect()} == {"pk/deep.py": "RecursionError", "pk/bad.py": "SyntaxError", "pk/none.py": "not UTF-8"}
