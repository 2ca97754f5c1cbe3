"""Seven tools for agents over an index, as plain functions and as a tool server.

The server speaks the Model Context Protocol over standard input and output: JSON-RPC 2.0, a message
a line, with ``initialize``, ``ping``, ``tools/list`` and ``tools/call``.
"""

from __future__ import annotations

import functools
import inspect
import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from lodestrata.engine import CodeIndex
from lodestrata.sources.index import build_index
from lodestrata.storage import scratch


def _scoped(tool: Callable) -> Callable:
    """A call's intermediate tables go with it."""

    @functools.wraps(tool)
    def run(self: AgentTools, *args: object, **options: object) -> object:
        with scratch(self._spark):
            return tool(self, *args, **options)

    return run


class AgentTools:
    """An index is opened on first use, kept, and opened anew after ``reindex``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root, self._open = spark, root, None

    def _index(self) -> CodeIndex:
        self._open = self._open or CodeIndex(self._spark, self._root)
        return self._open

    @_scoped
    def search_code(self, query: str, k: int = 8, language: str = "", kind: str = "") -> list[dict]:
        """Hybrid keyword, vector and graph search; hits with file, lines and related symbols."""
        return self._index().search(query, k=k, language=language or None, kind=kind or None)

    @_scoped
    def find_symbol(self, name: str) -> list[dict]:
        """Definitions of a symbol, by exact name or else by part of it."""
        return [r.asDict() for r in self._index().find_symbol(name).drop("ord").collect()]

    @_scoped
    def find_callers(self, name: str) -> list[dict]:
        """Symbols that call the named one."""
        return [r.asDict() for r in self._index().callers(name).collect()]

    @_scoped
    def impact_analysis(self, name: str, max_depth: int = 4) -> list[dict]:
        """All that depends on a symbol through calls, inheritance and imports."""
        return [r.asDict() for r in self._index().impact(name, max_depth).collect()]

    @_scoped
    def file_outline(self, file_path: str) -> list[dict]:
        """Symbols of a file in order of line."""
        return [r.asDict() for r in self._index().outline(file_path).collect()]

    def reindex(self, full: bool = False) -> dict:
        """Refresh the index after changes; full: build it anew."""
        stats = build_index(self._spark, self._root, full=full)
        self._open = None
        return stats

    @_scoped
    def index_stats(self) -> dict:
        """Counts, languages and embedder of the index."""
        return self._index().stats()

    def tool(self, name: str):
        if name not in TOOLS:
            raise ValueError(f"no tool named {name!r}")
        return getattr(self, name)

    def call(self, name: str, args: dict) -> object:
        return self.tool(name)(**args)

    def described(self) -> list[dict]:
        """Each tool's name, purpose and arguments, read from its signature."""
        found = []
        for name in TOOLS:
            tool = self.tool(name)
            arguments = inspect.signature(tool).parameters.values()
            schema = {"type": "object", "properties": {p.name: {"type": _JSON_TYPES[p.annotation]} for p in arguments}, "required": [p.name for p in arguments if p.default is p.empty]}
            found.append({"name": name, "description": tool.__doc__, "inputSchema": schema})
        return found


TOOLS = ("search_code", "find_symbol", "find_callers", "impact_analysis", "file_outline", "reindex", "index_stats")
PROTOCOL = "2024-11-05"
_JSON_TYPES = {"str": "string", "int": "integer", "bool": "boolean"}


class _Refused(Exception):
    """A request that gets an error reply of this code."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def _answer(tools: AgentTools, method: str, params: dict) -> dict:
    match method:
        case "initialize":
            return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestrata", "version": "1"}}
        case "ping":
            return {}
        case "tools/list":
            return {"tools": tools.described()}
        case "tools/call":
            if params.get("name") not in TOOLS:
                raise _Refused(-32602, f"no tool named {params.get('name')!r}")
            try:
                text, failed = json.dumps(tools.call(params["name"], params.get("arguments") or {}), indent=2), False
            except Exception as e:  # noqa: BLE001  the service outlives a failed call
                text, failed = str(e), True
            return {"content": [{"type": "text", "text": text}], "isError": failed}
    raise _Refused(-32601, f"no method named {method!r}")


def serve_stdio(spark: SparkSession, root: str, requests: TextIO = sys.stdin, replies: TextIO = sys.stdout) -> None:
    """Answer requests until the input ends; notifications, which have no id, get no reply."""
    tools = AgentTools(spark, root)
    for line in filter(str.strip, requests):
        reply = {"jsonrpc": "2.0", "id": None}
        try:
            asked = json.loads(line)
            if not isinstance(asked, dict) or not isinstance(asked.get("method"), str):
                raise _Refused(-32600, "not a request")
            if "id" not in asked:
                continue
            reply["id"] = asked["id"]
            reply["result"] = _answer(tools, asked["method"], asked.get("params") or {})
        except json.JSONDecodeError as e:
            reply["error"] = {"code": -32700, "message": str(e)}
        except _Refused as e:
            reply["error"] = {"code": e.code, "message": str(e)}
        print(json.dumps(reply), file=replies, flush=True)
