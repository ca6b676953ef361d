"""Tools, integrations and the command line."""

import io
import json
import subprocess

import pytest

from graphloom import cli
from graphloom.service import integrations, mcp, tools


class Fake:
    def handle(self, request):
        if request["op"] == "impact":
            return {"ok": True, "result": {"symbol": "x", "markdown": "long", "impact": [{"symbol": "x", "refs": list(range(90))}]}}
        return {"ok": True, "result": list(range(90))}


def test_tools_are_short():
    assert len(tools.TOOLS) == 20 and tools.call(Fake(), "?")["ok"] is False
    short = tools.call(Fake(), "impact")["result"]
    assert len(short["impact"][0]["refs"]) == 40 and short["impact"][0]["refs_total"] == 90 and "markdown" not in short
    assert tools.call(Fake(), "call_contract", limit=2)["result"] == {"rows": [0, 1], "total": 90}
    assert len(tools.call(Fake(), "call_contract", full=True)["result"]) == 90 and len(tools.call(Fake(), "callers")["result"]) == 90


def test_integrations(tmp_path):
    r = integrations.Registry()
    tool = integrations.Integration("py", "adapter", "MIT", frozenset({"x"}), "python")
    r.add(tool)
    with pytest.raises(ValueError):
        r.add(integrations.Integration("nc", "adapter", "noncommercial", frozenset({"x"}), "python"))
    assert r.resolve("x", integrations.config(str(tmp_path))) is None
    (tmp_path / "graphloom.toml").write_text('[integrations]\nenabled = ["py"]\n')
    assert r.resolve("x", integrations.config(str(tmp_path))) == tool and r.resolve("y", integrations.config(str(tmp_path))) is None
    (tmp_path / "graphloom.toml").write_text("[integrations\n")
    assert integrations.config(str(tmp_path)) == integrations.Config()
    assert integrations.ask(["echo", "[1]"]) == [1] and integrations.ask(["echo", "{"]) is None and integrations.ask(["no-such-program"]) is None and integrations.ask([]) is None


def test_router(tmp_path, monkeypatch, capsys):
    tool = integrations.REGISTRY.known["gitnexus"]
    assert tool.mode == "router" and not tool.permissive and "non-commercial" in tool.notice()
    assert tool.command("semantic-search", "where is it") == ["gitnexus", "search", "where is it", "--json"] and tool.command("community-clusters", "") == ["gitnexus", "check", "--clusters", "--json"]
    with pytest.raises(ValueError):
        tool.route("call-contract", "x")
    assert tool.route("semantic-search", "x")["payload"] is None  # not installed
    assert cli.main(["route", "semantic-search", "x", "--root", str(tmp_path)]) == 1
    monkeypatch.setattr(integrations.shutil, "which", lambda program: f"/bin/{program}")
    monkeypatch.setattr(integrations, "ask", lambda command, timeout: {"asked": command})
    (tmp_path / "graphloom.toml").write_text('[integrations]\nenabled = ["gitnexus"]\n')
    capsys.readouterr()
    assert cli.main(["route", "semantic-search", "x", "--root", str(tmp_path)]) == 0
    out, err = capsys.readouterr()
    assert json.loads(out) == {"source": "gitnexus", "passthrough": True, "disclaimer": tool.notice(), "payload": {"asked": ["gitnexus", "search", "x", "--json"]}} and "non-commercial" in err
    (tmp_path / "graphloom.toml").write_text('[integrations]\nenabled = ["gitnexus"]\nacknowledged = ["gitnexus"]\n')
    assert cli.main(["route", "semantic-search", "x", "--root", str(tmp_path)]) == 0 and capsys.readouterr().err == ""


def test_external_rows_are_kept_apart(spark, tmp_path):
    integrations.write_external(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b")], "source string, target string"), "other", str(tmp_path / "x"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "x/edges")).collect()] == [("a", "b", "external", "other")]
    assert json.loads(spark.read.text(str(tmp_path / "x/about")).first().value) == {"resolver": "other", "deterministic": False, "canonical": False}


class Asked:
    def __init__(self):
        self.requests = []

    def handle(self, request):
        self.requests.append(request)
        return Fake().handle(request) if request["op"] != "source" else {"ok": False, "error": "none"}


def test_protocol_messages():
    assert set(mcp.TOOLS) == set(tools.TOOLS)
    session = Asked()
    server = mcp.Server(session)
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26", "capabilities": {}, "clientInfo": {"name": "t", "version": "0"}}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": "c", "method": "tools/call", "params": {"name": "impact", "arguments": {"symbol": "x", "limit": 3}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "impact", "arguments": {"symbol": "x", "full": True}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "locate", "arguments": {"file": "f", "start": 2, "end": 4}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "source", "arguments": {"symbol": "x"}}},
        {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "?"}},
        {"jsonrpc": "2.0", "id": 8, "method": "?"},
        {"id": 9},
        {"jsonrpc": "2.0", "id": 10, "method": "ping"},
    ]
    answers = io.StringIO()
    server.serve([*map(json.dumps, lines), "", "{"], answers)
    got = [json.loads(x) for x in answers.getvalue().splitlines()]
    by = {a["id"]: a for a in got}
    assert len(got) == 11 and got[-1]["error"]["code"] == -32700
    assert by[1]["result"]["protocolVersion"] == "2025-03-26" and "tools" in by[1]["result"]["capabilities"]
    assert len(by[2]["result"]["tools"]) == 20 and all(t["description"] and t["inputSchema"]["type"] == "object" for t in by[2]["result"]["tools"])
    short = by["c"]["result"]["structuredContent"]["result"]
    assert len(short["impact"][0]["refs"]) == 3 and "markdown" not in short and json.loads(by["c"]["result"]["content"][0]["text"]) == by["c"]["result"]["structuredContent"]
    assert by[4]["result"]["structuredContent"]["result"]["markdown"] == "long" and not by[4]["result"]["isError"]
    assert session.requests[2] == {"op": "locate", "args": {"file": "f", "lines": [2, 4]}} and by[6]["result"]["isError"]
    assert by[7]["error"]["code"] == -32602 and by[8]["error"]["code"] == -32601 and by[9]["error"]["code"] == -32600 and by[10]["result"] == {}


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    (tmp_path / "pk").mkdir()
    (tmp_path / "pk/__init__.py").write_text("from pk.a import f\n")
    (tmp_path / "pk/a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    out, package = str(tmp_path / "g.json"), str(tmp_path / "pk")
    assert cli.main(["build", package, "-o", out]) == 0
    doc = json.loads((tmp_path / "g.json").read_text())
    assert {n["id"] for n in doc["nodes"]} == {"pk", "pk.a", "pk.a.f", "pk.a.g"} and json.loads((tmp_path / "g.json.meta.json").read_text())["scope"]["scope_id"].startswith("sha256:")
    first = (tmp_path / "g.json").read_text()
    monkeypatch.chdir(tmp_path)
    assert cli.main(["refresh", out]) == 0 and (tmp_path / "g.json").read_text() == first
    capsys.readouterr()
    assert cli.main(["query", "g", "--graph", out]) == 0 and '"callers": [\n        "pk.a.f"' in capsys.readouterr().out
    assert cli.main(["query", "none", "--graph", out]) == 1
    assert cli.main(["report", "dependencies", "--graph", out]) == 0 and "Imports of `pk`" in capsys.readouterr().out
    assert cli.main(["export", "mermaid", "--kind", "deps", "--build", package]) == 0 and "pk --> pk_a" in capsys.readouterr().out
    assert cli.main(["export", "vault", "--graph", out, "-o", str(tmp_path / "v")]) == 0 and (tmp_path / "v/pk.a.md").exists()
    (tmp_path / "d.diff").write_text("+++ b/pk/a.py\n@@ -1 +5,1 @@\n")
    capsys.readouterr()
    assert cli.main(["review", str(tmp_path / "d.diff"), "--graph", out]) == 0 and "## `pk.a.g`: " in capsys.readouterr().out
    assert cli.main(["review", str(tmp_path / "d.diff"), "--graph", out, "--format", "json"]) == 0 and json.loads(capsys.readouterr().out)["symbol"] == "pk.a.g"
    assert cli.main(["scope", package, "-o", str(tmp_path / "s.json")]) == 0 and cli.main(["scope", package, "--diff", str(tmp_path / "s.json")]) == 0
    (tmp_path / "pk/a.py").write_text("x = 1\n")
    capsys.readouterr()
    assert cli.main(["scope", package, "--diff", str(tmp_path / "s.json")]) == 1 and "changed\tpk/a.py" in capsys.readouterr().out
    assert cli.main(["report", "impact", "--graph", out]) == 1


def test_command_line_in_full(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    (tmp_path / "pk").mkdir()
    (tmp_path / "pk/__init__.py").write_text("")
    (tmp_path / "pk/core.py").write_text("class Engine:\n    def run(self):\n        return 1\n")
    (tmp_path / "pk/app.py").write_text("from pk.core import Engine\n\ndef main():\n    e = Engine()\n    return e.run()\n")
    (tmp_path / "pk/broken.py").write_text("def (:\n")
    (tmp_path / "pk/latin.py").write_bytes(b"x = '\xe9'\n")
    package, out = str(tmp_path / "pk"), str(tmp_path / "g.json")
    say = lambda *argv: (cli.main(list(argv)), capsys.readouterr())
    code, said = say("build", package, "--deep", "-o", out)
    assert code == 0 and "pk/broken.py: SyntaxError" in said.err and "pk/latin.py: not UTF-8" in said.err
    edges = json.loads((tmp_path / "g.json").read_text())["edges"]
    assert ("pk.app.main", "pk.core.Engine.run", "deep") in {(e["source"], e["target"], e["extras"].get("resolution")) for e in edges if e["type"] == "calls"}
    assert "called by pk.app.main" in say("query", "run", "--graph", out, "--format", "text")[1].out
    facts = json.loads(say("report", "dependencies", "--graph", out, "--format", "json")[1].out)
    assert facts["imports"] == 1 and json.loads(say("report", "impact", "--symbol", "run", "--graph", out, "--format", "json")[1].out)[0]["risk"] == "low"
    for kind in ("dead-code", "behavior", "architecture", "communities", "flows", "api-surface"):
        assert say("report", kind, "--graph", out, "--format", "json")[0] == 0
    assert '"symbol":"graphloom python other 1.2 ' in say("export", "symbols", "--graph", out, "--package", "other", "--package-version", "1.2")[1].out
    assert say("export", "index", "--graph", out, "--project-root", "/src", "-o", str(tmp_path / "i"))[0] == 0 and b"file:///src" in (tmp_path / "i").read_bytes()
    run = lambda *c: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *c], check=True, capture_output=True)
    run("init", "-q")
    run("add", "pk/app.py", "pk/core.py")
    run("commit", "-qm", "x")
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    assert say("scope", package, "-o", a)[0] == 0 and say("scope", package, "--no-git", "-o", b)[0] == 0
    one, two = json.loads((tmp_path / "a.json").read_text()), json.loads((tmp_path / "b.json").read_text())
    assert [f["path"] for f in one["files"]] == ["pk/app.py", "pk/core.py"] and one["mode"] == "git" and len(two["files"]) == 4 and two["git"] is None
    code, said = say("scope", "--diff", a, b)
    assert code == 1 and said.out == "added\tpk/__init__.py\nadded\tpk/broken.py\n" and say("scope", "--diff", a, a)[0] == 0
    assert say("scope", "--diff", out, out)[0] == 0  # the recipes beside graphs
    assert "2 files" in say("scope", package, "--summary")[1].out and say("scope")[0] == 1
    request = io.StringIO('{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "callers", "arguments": {"symbol": "run"}}}\n')
    monkeypatch.setattr(cli.sys, "stdin", request)
    assert json.loads(say("serve", "--mcp", "--graph", out)[1].out)["result"]["structuredContent"]["result"] == ["pk.app.main"]
