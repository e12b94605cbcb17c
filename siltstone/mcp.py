"""Tools over standard input and output: JSON-RPC messages framed by Content-Length."""

from __future__ import annotations

import json
from typing import BinaryIO

PROTOCOL = "2024-11-05"
_PATH = {"path": {"type": "string"}}
TOOLS = {
    "index_codebase": (_PATH | {"force": {"type": "boolean"}}, ["path"]),
    "search_code": (_PATH | {"query": {"type": "string"}, "limit": {"type": "integer"}, "extensionFilter": {"type": "array"}, "domainFilter": {"type": "array"}}, ["path", "query"]),
    "clear_index": (_PATH, ["path"]),
    "get_indexing_status": (_PATH, ["path"]),
}


def read_message(stream: BinaryIO) -> dict | None:
    length = None
    while True:
        line = stream.readline()
        if not line:
            return None
        line = line.strip()
        if not line:
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    if length is None:
        raise ValueError("no Content-Length")
    return json.loads(stream.read(length))


def write_message(stream: BinaryIO, message: dict) -> None:
    body = json.dumps(message, ensure_ascii=False, default=str).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


class Server:
    def __init__(self, engine):
        self.engine = engine

    def serve(self, source: BinaryIO, sink: BinaryIO) -> None:
        while True:
            try:
                message = read_message(source)
            except json.JSONDecodeError as e:
                write_message(sink, self._error(None, -32700, str(e)))
                continue
            if message is None:
                return
            answer = self.handle(message)
            if answer is not None:
                write_message(sink, answer)

    @staticmethod
    def _error(identifier, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": identifier, "error": {"code": code, "message": text}}

    def handle(self, m: dict) -> dict | None:
        """An answer, or nothing for a notification."""
        if "id" not in m or m["id"] is None:
            return None
        method, params = m.get("method"), m.get("params") or {}
        if method == "initialize":
            result: dict = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "siltstone", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (p, r) in TOOLS.items()]}
        elif method == "tools/call":
            name, args = params.get("name"), params.get("arguments") or {}
            if name not in TOOLS:
                return self._error(m["id"], -32602, f"unknown tool {name!r}")
            known, required = TOOLS[name]
            if set(args) - set(known) or any(not args.get(r) for r in required):
                return self._error(m["id"], -32602, "unknown or missing argument")
            try:
                result = {"content": [{"type": "text", "text": json.dumps(self.call(name, args), ensure_ascii=False, default=str)}]}
            except Exception as e:  # noqa: BLE001  a tool's failure is its result
                result = {"content": [{"type": "text", "text": str(e)[:2000]}], "isError": True}
        else:
            return self._error(m["id"], -32601, f"unknown method {method!r}")
        return {"jsonrpc": "2.0", "id": m["id"], "result": result}

    def call(self, name: str, args: dict):
        if name == "index_codebase":
            if args.get("force"):
                self.engine.clear(args["path"])
            return self.engine.index(args["path"])
        if name == "clear_index":
            self.engine.clear(args["path"])
            return {"status": "cleared"}
        if name == "get_indexing_status":
            return self.engine.status(args["path"])
        return self.search_code(args)

    def search_code(self, args: dict) -> list[dict]:
        """Code alone, by reciprocal ranks, no session; given domain filters replace the inferred ones."""
        from pyspark.sql import functions as F

        from siltstone.functions.scoring import strategy_for
        from siltstone.operators import domain, search

        e, s = self.engine, strategy_for("codebase", self.engine.config.weights)
        domains = args.get("domainFilter") or domain.domain_filters(e.spark, args["query"])
        options = search.SearchOptions(query=args["query"], limit=args.get("limit") or e.config.limit, extensions=tuple(args.get("extensionFilter") or ()), filters={"domain_path": tuple(domains)}, semantic=s.semantic, keyword=s.keyword, profile=s.profile, fusion=s.fusion)
        namespace = e.namespace(args["path"])
        hits = search.search_namespace(e.chunks.read([namespace]), namespace, e._query_vectors([args["query"]])[0], options)
        cols = ["relative_path", "start_line", "end_line", "language", "content", "score"]
        return [r.asDict() for r in hits.select(*cols, F.col("metadata")["domain_path"].alias("domain_path")).collect()]
