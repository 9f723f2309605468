"""The five tools for model clients: JSON-RPC 2.0 messages of the Model Context Protocol, over standard streams or HTTP."""

from __future__ import annotations

import json
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from typing import TextIO

from lodestone.service import Service

VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
TEXT, COUNT, LIST = {"type": "string"}, {"type": "integer", "minimum": 1}, {"type": "array", "items": {"type": "string"}}
SEARCH = {"query": TEXT, "k": COUNT, "tags": LIST, "paths": LIST}
TOOLS = {
    "status": ("How many notes and chunks are indexed, and when.", {}, []),
    "reindex": ("Brings the index up to date with the notes.", {}, []),
    "search_knowledge": ("Passages that answer a query, best first.", SEARCH, ["query"]),
    "search_sources": ("Notes that answer a query, with snippets.", SEARCH, ["query"]),
    "get_note": ("A note's title and text.", {"path": TEXT}, ["path"]),
}


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def tool_list() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]


def called(service: Service, name: object, arguments: dict) -> dict:
    """A tool's result; what goes wrong within a tool is a result, too, which the model can read."""
    if name not in TOOLS:
        raise RpcError(-32602, f"no tool {name!r}")
    _, known, required = TOOLS[name]
    wrong = [f"{k!r} is missing" for k in required if k not in arguments] + [f"{k!r} isn't known" for k in arguments if k not in known]
    if wrong:
        raise RpcError(-32602, "; ".join(wrong))
    try:
        text = service.call(name, arguments)
        return {"content": [{"type": "text", "text": text}], "structuredContent": json.loads(text), "isError": False}
    except Exception as error:  # noqa: BLE001
        return {"content": [{"type": "text", "text": str(error)}], "isError": True}


def result_of(service: Service, method: str, params: dict) -> dict:
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": tool_list()}
    if method == "tools/call":
        return called(service, params.get("name"), params.get("arguments") or {})
    raise RpcError(-32601, f"no method {method!r}")


def answer(service: Service, text: str) -> str | None:
    """The reply to a message; None to a notification."""
    key = None
    try:
        try:
            message = json.loads(text)
        except ValueError as error:
            raise RpcError(-32700, f"not JSON: {error}") from error
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            raise RpcError(-32600, "not a request")
        key = message.get("id")
        if "id" not in message:
            return None
        body = {"result": result_of(service, message["method"], message.get("params") or {})}
    except RpcError as error:
        body = {"error": {"code": error.code, "message": str(error)}}
    return json.dumps({"jsonrpc": "2.0", "id": key} | body, ensure_ascii=False)


def serve_lines(service: Service, lines: Iterable[str], out: TextIO) -> None:
    """One message a line."""
    for line in lines:
        if line.strip() and (reply := answer(service, line)) is not None:
            print(reply, file=out, flush=True)


def http_server(service: Service, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server whose serve_forever answers messages posted to /mcp, one at a time."""
    turn = Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            text = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if self.path.rstrip("/") != "/mcp":
                return self.reply(404, "")
            with turn:
                got = answer(service, text)
            self.reply(202 if got is None else 200, got or "")

        def reply(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
