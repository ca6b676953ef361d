"""The session's operations as tools for an assistant: short answers, with totals of what was left out."""

from __future__ import annotations

from graphloom.service.session import Session

#: Tools by name; ping, columns and export stay with the session.
TOOLS = ("stats", "query", "impact", "resolve", "search", "families", "column", "columns_of", "callers", "callees", "implementers", "family", "call_contract", "locate", "review", "architecture", "communities", "flows", "source", "report")
LIMITS = {"impact": 40, "call_contract": 30}


def compact(op: str, answer: dict, limit: int | None = None) -> dict:
    """An answer whose long lists are cut, each with its total; a report that repeats them is left out."""
    if not answer.get("ok") or op not in LIMITS:
        return answer
    most = LIMITS[op] if limit is None else limit
    if most < 0:
        raise ValueError("limit must not be negative")
    if op == "call_contract":
        rows = answer["result"]
        return answer | {"result": {"rows": rows[:most], "total": len(rows)}}
    result = {k: v for k, v in answer["result"].items() if k != "markdown"}
    result["impact"] = [i | {"refs": i["refs"][:most], "refs_total": len(i["refs"])} for i in result["impact"]]
    return answer | {"result": result}


def call(session: Session, tool: str, args: dict | None = None, *, full: bool = False, limit: int | None = None) -> dict:
    if tool not in TOOLS:
        return {"ok": False, "error": f"there is no tool {tool!r}", "tools": list(TOOLS)}
    answer = session.handle({"op": tool, "args": args or {}})
    return answer if full else compact(tool, answer, limit)
