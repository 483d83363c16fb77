"""A tool server: JSON-RPC 2.0, one message a line, over standard input and output."""

from __future__ import annotations

import inspect
import json
import sys
import typing
from typing import IO

from pyspark.sql import SparkSession

from sieveline.errors import EngineError
from sieveline.service import Service

PROTOCOL = "2024-11-05"
TOOLS = {
    "semantic_search": "Chunks that answer a question, with path, lines, score and tier.",
    "get_file_skeleton": "The outline of a file or of a range of its lines: signatures and docstrings, no bodies.",
    "get_impact_radius": "What depends on a symbol, by calls, imports and inheritance.",
    "index_status": "Whether there is an index, and of what.",
}
_KINDS = {str: "string", int: "integer", bool: "boolean"}


def _schema(f) -> dict:
    """The arguments of a function as a JSON schema."""
    kinds = typing.get_type_hints(f)
    properties, required = {}, []
    for name, p in inspect.signature(f).parameters.items():
        of = [k for k in typing.get_args(kinds[name]) or (kinds[name],) if k is not type(None)][0]
        properties[name] = {"type": _KINDS[of]} if of in _KINDS else {"type": "array", "items": {"type": "string"}}
        if p.default is inspect.Parameter.empty:
            required.append(name)
    return {"type": "object", "properties": properties, "required": required}


class Server:
    def __init__(self, service: Service):
        self.tools = {name: getattr(service, name) for name in TOOLS}

    def call(self, name: str, arguments: dict) -> dict:
        """What a tool returns as text; an error of the engine is told in its place."""
        try:
            found = self.tools[name](**arguments)
        except (EngineError, ValueError, KeyError, TypeError, OSError) as e:
            return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
        text = found if isinstance(found, str) else json.dumps(found)
        return {"content": [{"type": "text", "text": text}], "isError": False}

    def answer(self, message: dict) -> dict | None:
        """The answer to one message; none to a notification."""
        method, params = message.get("method"), message.get("params") or {}
        if "id" not in message:
            return None
        if method == "initialize":
            found = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "sieveline", "version": "1"}}
        elif method == "ping":
            found = {}
        elif method == "tools/list":
            found = {"tools": [{"name": n, "description": d, "inputSchema": _schema(self.tools[n])} for n, d in TOOLS.items()]}
        elif method == "tools/call":
            found = self.call(params.get("name"), params.get("arguments") or {})
        else:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": found}

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
                answer = self.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if answer is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()


def main() -> None:
    Server(Service(SparkSession.builder.getOrCreate())).serve(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
