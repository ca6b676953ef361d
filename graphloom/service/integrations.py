"""Other analysers beside this one: which may be used, and how they are asked.

An adapter turns another tool's output into rows of its own tables, marked with where they come from and never joined to the core; its
license must permit that. A router hands an answer through as it is. Either is used only if it offers what is asked, is switched on, and
is installed.
"""

from __future__ import annotations

import dataclasses
import json
import shutil
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERMISSIVE = {"mit", "isc", "apache", "apache 2.0", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "0bsd", "psf", "unlicense"}


@dataclasses.dataclass(frozen=True)
class Integration:
    name: str
    mode: str  # adapter or router
    license: str
    capabilities: frozenset[str]
    program: str
    #: of a router: how it is asked for a capability; "{question}" stands for the question.
    arguments: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def available(self) -> bool:
        return shutil.which(self.program) is not None

    @property
    def permissive(self) -> bool:
        return self.license.strip().lower() in PERMISSIVE

    def notice(self) -> str | None:
        """What a user must know before asking a tool whose license restricts its use."""
        if self.permissive:
            return None
        return f"{self.name} has the license {self.license}. Its answers are for non-commercial use only, unless its author has licensed other use: don't switch it on for commercial work."

    def command(self, capability: str, question: str) -> list[str]:
        own = dict(self.arguments)
        if self.mode != "router" or capability not in own:
            raise ValueError(f"{self.name} can't be asked for {capability!r}")
        return [self.program, *(question if a == "{question}" else a for a in own[capability])]

    def route(self, capability: str, question: str, timeout: float = 120) -> dict:
        """The tool's own answer as it is, null if it fails, with where it comes from. It never becomes part of a graph."""
        return {"source": self.name, "passthrough": True, "disclaimer": self.notice(), "payload": ask(self.command(capability, question), timeout)}


@dataclasses.dataclass(frozen=True)
class Config:
    enabled: frozenset[str] = frozenset()
    acknowledged: frozenset[str] = frozenset()


def config(root: str, file: str = "graphloom.toml") -> Config:
    """The section ``integrations`` of a TOML file; a missing or broken file switches nothing on."""
    try:
        own = tomllib.loads((Path(root) / file).read_text(encoding="utf-8")).get("integrations", {})
        return Config(*(frozenset(own.get(k) or ()) for k in ("enabled", "acknowledged")))
    except (OSError, ValueError, AttributeError, TypeError):
        return Config()


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Integration] = {}

    def add(self, tool: Integration) -> None:
        if tool.mode not in ("adapter", "router"):
            raise ValueError(f"no such mode: {tool.mode}")
        if tool.mode == "adapter" and not tool.permissive:
            raise ValueError(f"{tool.name} can only be a router under the license {tool.license!r}")
        self.known[tool.name] = tool

    def resolve(self, capability: str, settings: Config) -> Integration | None:
        """The first by name that offers it, is switched on and is installed."""
        fits = (t for _, t in sorted(self.known.items()) if capability in t.capabilities and t.name in settings.enabled)
        return next((t for t in fits if t.available()), None)


def ask(command: list[str], timeout: float = 120, text: str | None = None):
    """A program's JSON answer, or None if it fails in any way."""
    try:
        done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout, check=True)
        return json.loads(done.stdout)
    except (OSError, ValueError, IndexError, subprocess.SubprocessError):
        return None


def external(rows: DataFrame, resolver: str) -> DataFrame:
    """Rows of another tool, marked as such, to be stored beside the graph."""
    return rows.withColumn("provenance", F.lit("external")).withColumn("resolver", F.lit(resolver))


def write_external(nodes: DataFrame, edges: DataFrame, resolver: str, path: str, deterministic: bool = False) -> None:
    """Another tool's nodes and edges as Parquet beside a graph, marked row by row, with a description that says that they aren't canonical."""
    external(nodes, resolver).write.mode("overwrite").parquet(f"{path}/nodes")
    external(edges, resolver).write.mode("overwrite").parquet(f"{path}/edges")
    about = {"resolver": resolver, "deterministic": deterministic, "canonical": False}
    nodes.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


#: The tools that this package knows of; none is switched on unless the configuration names it.
REGISTRY = Registry()
REGISTRY.add(
    Integration(
        "gitnexus", "router", "PolyForm-Noncommercial-1.0.0", frozenset({"semantic-search", "flow-narrative", "community-clusters"}), "gitnexus",
        (("semantic-search", ("search", "{question}", "--json")), ("flow-narrative", ("trace", "{question}", "--json")), ("community-clusters", ("check", "--clusters", "--json"))),
    )
)
