"""The session's tools over the Model Context Protocol: JSON-RPC 2.0, one message a line, on standard input and output."""

from __future__ import annotations

import json
from typing import IO

from graphloom.service.session import Session
from graphloom.service.tools import LIMITS, call

PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
_SYMBOL = {"symbol": TEXT}
_RANGES = {"type": "array", "items": {"type": "array", "items": NUMBER}}
_SHORT = {"limit": {**NUMBER, "description": "how many rows to list"}, "full": {**FLAG, "description": "everything, uncut"}}
#: tool: (what it answers, its arguments, those it needs)
TOOLS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "stats": ("What the graph holds: nodes by kind, edges by type, its age.", {}, ()),
    "query": ("Everything about a name: its definitions, and for each what it depends on and what depends on it.", {"name": TEXT}, ("name",)),
    "impact": ("What a change of a symbol reaches, by distance and by where it comes from, with its risk.", {**_SYMBOL, "depth": NUMBER, **_SHORT}, ("symbol",)),
    "resolve": ("The id that a short or former name stands for, and the others it may mean.", {"name": TEXT}, ("name",)),
    "search": ("Ids that contain a term, whatever the case; begin here.", {"term": TEXT, "kind": TEXT, "limit": NUMBER}, ("term",)),
    "families": ("Protocols with the classes registered for them, and how those are registered.", {}, ()),
    "column": ("Which functions write and read a string key.", {"name": TEXT}, ("name",)),
    "columns_of": ("Which string keys a function writes and reads.", _SYMBOL, ("symbol",)),
    "callers": ("What calls a symbol, as far as calls are resolved.", _SYMBOL, ("symbol",)),
    "callees": ("What a symbol calls.", _SYMBOL, ("symbol",)),
    "implementers": ("Classes that implement a protocol.", {"protocol": TEXT}, ("protocol",)),
    "family": ("The protocols of a class, and the other classes that implement them.", {"class": TEXT}, ("class",)),
    "call_contract": ("How each caller passes arguments to a symbol: read it before changing a signature.", {**_SYMBOL, **_SHORT}, ("symbol",)),
    "locate": ("The symbol at a line of a file, or those in a range of lines.", {"file": TEXT, "line": NUMBER, "start": NUMBER, "end": NUMBER}, ("file",)),
    "review": ("What a change touches, riskiest first, from places in files or from names.", {"hunks": {"type": "array", "items": {"type": "object", "properties": {"file": TEXT, "ranges": _RANGES}}}, "symbols": {"type": "array", "items": TEXT}}, ()),
    "architecture": ("Layers, coupling, cycles, large classes and hubs.", {}, ()),
    "communities": ("Modules in groups that import each other more than the rest.", {}, ()),
    "flows": ("The calls that a symbol sets in motion; without one, where calls begin.", {**_SYMBOL, "depth": NUMBER}, ()),
    "source": ("The source text of a symbol.", _SYMBOL, ("symbol",)),
    "report": ("A report as Markdown.", {"kind": TEXT, "symbol": TEXT, "depth": NUMBER}, ("kind",)),
}


class Server:
    def __init__(self, session: Session, name: str = "graphloom", version: str = "0.1") -> None:
        self.session, self.name, self.version = session, name, version

    def tools(self) -> list[dict]:
        return [{"name": n, "description": about, "inputSchema": {"type": "object", "properties": args, "required": list(needs)}} for n, (about, args, needs) in TOOLS.items()]

    def call(self, name: str, args: dict) -> dict:
        """A tool's answer; ``limit`` and ``full`` shorten or lengthen long ones."""
        args = dict(args)
        full, limit = (bool(args.pop("full", False)), args.pop("limit", None)) if name in LIMITS else (False, None)
        if name == "locate" and "line" not in args:
            args["lines"] = [args.pop("start", None), args.pop("end", None)]
        return call(self.session, name, args, full=full, limit=limit)

    def handle(self, message) -> dict | None:
        """The response to one message; None to a notification."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return self._error(message.get("id") if isinstance(message, dict) else None, -32600, "no request of JSON-RPC 2.0")
        if "id" not in message:
            return None
        method, params = message["method"], message.get("params") or {}
        if method == "initialize":
            asked = params.get("protocolVersion")
            result: dict = {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": self.name, "version": self.version}, "instructions": "Questions about a graph of code. Find ids with search, then ask about them."}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": self.tools()}
        elif method == "tools/call":
            if params.get("name") not in TOOLS:
                return self._error(message["id"], -32602, f"there is no tool {params.get('name')!r}")
            try:
                answer = self.call(params["name"], params.get("arguments") or {})
            except (TypeError, ValueError) as e:
                answer = {"ok": False, "error": f"{type(e).__name__}: {e}"}
            result = {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False, default=str)}], "structuredContent": answer, "isError": not answer.get("ok", False)}
        else:
            return self._error(message["id"], -32601, f"there is no method {method!r}")
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    @staticmethod
    def _error(id_, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}

    def serve(self, lines: IO[str], answers: IO[str]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError as e:
                answer = self._error(None, -32700, f"no JSON: {e}")
            if answer is not None:
                answers.write(json.dumps(answer, ensure_ascii=False, default=str) + "\n")
                answers.flush()
