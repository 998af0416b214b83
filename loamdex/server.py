"""A JSON-RPC tool server over lines of text: thin, on the driver."""

from __future__ import annotations

import json
import sys

from loamdex import views

# The tools and their arguments.
TOOLS = {
    "memory_search": {"query": "string", "kb": "string?", "limit": "integer?", "mode": "string?", "exact": "boolean?", "smart": "boolean?", "doc_score": "boolean?"},
    "retrieve_chunk": {"chunk_id": "integer", "lines_before": "integer?", "lines_after": "integer?", "chunks_before": "integer?", "chunks_after": "integer?"},
    "memory_sync": {"kb": "string?", "force": "boolean?", "dry_run": "boolean?"},
    "memory_status": {"kb": "string?"},
    "memory_list": {},
}
_MODES = {"all": ("fuzzy", "graph", "vector"), "fuzzy": ("fuzzy",), "text": ("text",), "graph": ("graph",), "vector": ("vector",), "local": ("local",)}


def call(engine, name: str, args: dict) -> str:
    """A tool's rows as text: a search's in sections by engine, the others' as JSON."""
    if name == "memory_search":
        return search(engine, args)
    if name == "retrieve_chunk":
        df = engine.retrieve(int(args["chunk_id"]), *(int(args.get(k, 0)) for k in ("lines_before", "lines_after", "chunks_before", "chunks_after")))
    elif name == "memory_sync":
        df = engine.sync(args.get("kb"), args.get("force", False), args.get("dry_run", False))
    elif name == "memory_status":
        df = engine.status(args.get("kb"))
    elif name == "memory_list":
        df = engine.list_kbs()
    else:
        raise KeyError(f"unknown tool: {name}")
    return json.dumps([json.loads(x) for x in df.toJSON().collect()], ensure_ascii=False)


def search(engine, args: dict) -> str:
    """Fused results first, then each engine's own list."""
    kb, k, engines = args.get("kb"), args.get("limit", 5), _MODES[args.get("mode", "all")]
    engines = ("local",) if args.get("exact") else engines
    asked = engine.sub_queries(args["query"]) if args.get("smart") else [args["query"]]
    fused = [r.asDict(True) for r in engine.search(args["query"], kb, k, engines, args.get("exact", False), args.get("doc_score", False), args.get("smart", False)).collect()]
    lists: dict[str, list[dict]] = {}
    for q in asked if len(engines) > 1 else ():
        for r in engine.hits(q, q, kb, k, engines, args.get("exact", False)).collect():
            lists.setdefault(r.engine, []).append(r.asDict())
    told = views.sections(lists, asked if args.get("smart") else ()) if lists else ""
    return views.results(fused) + (f"\n\n{told}" if told else "")


def handle(engine, request: dict) -> dict | None:
    """The reply to one request; None for a notification."""
    method, params, key = request.get("method"), request.get("params") or {}, request.get("id")
    reply = {"jsonrpc": "2.0", "id": key}
    try:
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "loamdex", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t.rstrip("?")} for k, t in p.items()}, "required": [k for k, t in p.items() if not t.endswith("?")]}} for n, p in TOOLS.items()]}
        elif method == "tools/call":
            try:
                result = {"content": [{"type": "text", "text": call(engine, params["name"], params.get("arguments") or {})}]}
            except Exception as e:  # noqa: BLE001 - a tool's error is a result
                result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        elif key is None:
            return None
        else:
            raise ValueError(f"unknown method: {method}")
    except Exception as e:  # noqa: BLE001
        return reply | {"error": {"code": -32603, "message": str(e)}}
    return None if key is None else reply | {"result": result}


def serve(engine, source=sys.stdin, sink=sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = handle(engine, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
