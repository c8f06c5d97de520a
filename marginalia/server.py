"""The six tools over lines of JSON (JSON-RPC 2.0: initialize, ping, tools/list, tools/call)."""

from __future__ import annotations

import inspect
import json
from typing import TextIO

from marginalia.service import KnowledgeService

TOOLS = {
    "list_sources": "The documents and workbooks that are there.",
    "search_knowledge": "Passages for a query, with their source and page.",
    "ingest_documents": "Index documents and store workbooks.",
    "excel_list_sheets": "The sheets of a workbook with their sizes.",
    "excel_read": "Rows of a sheet as objects by header; at most 500 rows beyond the first.",
    "excel_search": "Cells of a workbook that hold a text.",
}
_TYPES = {"str": "string", "int": "integer", "list": "array", "bool": "boolean"}


def describe() -> list[dict]:
    """Name, description and parameters of each tool, from the functions themselves."""
    out = []
    for name, text in TOOLS.items():
        given = [p for p in inspect.signature(getattr(KnowledgeService, name)).parameters.values() if p.name != "self"]
        kinds = {p.name: {"type": _TYPES[str(p.annotation).split("[")[0].split(" ")[0]]} for p in given}
        out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": kinds, "required": [p.name for p in given if p.default is p.empty]}})
    return out


def handle(service: KnowledgeService, request: dict) -> dict | None:
    """The reply to one request; None for a notification."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "marginalia", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": describe()}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    if params.get("name") not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"unknown tool: {params.get('name')}"}}
    try:
        got = getattr(service, params["name"])(**(params.get("arguments") or {}))
    except Exception as e:  # noqa: BLE001  a tool's failure is its result
        return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, default=str)}], "structuredContent": got, "isError": False}}


def serve(service: KnowledgeService, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            answer: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            answer = handle(service, request)
        if answer is not None:
            out.write(json.dumps(answer, ensure_ascii=False, default=str) + "\n")
            out.flush()
