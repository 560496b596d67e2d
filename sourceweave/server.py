"""JSON-RPC 2.0 over lines of text: seven tools over one graph."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analytics, ask, graph, lookup, traverse

# fixed values of the protocol
PROTOCOL, PARSE, METHOD, PARAMS = "2024-11-05", -32700, -32601, -32602
TOOLS = {
    "query_graph": ("Answer a question with the part of the graph around it.", {"question": "string", "mode": "string", "depth": "integer", "token_budget": "integer"}, ["question"]),
    "get_node": ("Details of one symbol.", {"label": "string"}, ["label"]),
    "get_neighbors": ("Links of one symbol.", {"label": "string", "relation_filter": "string"}, ["label"]),
    "get_community": ("Members of a community.", {"community_id": "integer"}, ["community_id"]),
    "god_nodes": ("The most connected symbols.", {"top_n": "integer"}, []),
    "graph_stats": ("Size and certainty of the graph.", {}, []),
    "shortest_path": ("The shortest way between two symbols.", {"source": "string", "target": "string", "max_hops": "integer"}, ["source", "target"]),
}


class ToolError(ValueError):
    pass


class Server:
    def __init__(self, nodes: DataFrame, edges: DataFrame, name: str = "sourceweave"):
        self.nodes, self.edges, self.name = nodes.persist(), edges.persist(), name

    def run(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if line.strip() and (reply := self.handle(line)) is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()

    def handle(self, line: str) -> dict | None:
        try:
            call = json.loads(line)
        except ValueError:
            return self._fail(None, PARSE, "parse error")
        id_, method, params = call.get("id"), call.get("method"), call.get("params") or {}
        if id_ is None:
            return None
        if method == "initialize":
            return self._reply(id_, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}})
        if method == "tools/list":
            schema = lambda props, need: {"type": "object", "properties": {k: {"type": t} for k, t in props.items()}, "required": need}
            return self._reply(id_, {"tools": [{"name": n, "description": d, "inputSchema": schema(p, r)} for n, (d, p, r) in TOOLS.items()]})
        if method != "tools/call":
            return self._fail(id_, METHOD, f"no method {method}")
        tool: Callable | None = getattr(self, params.get("name", ""), None) if params.get("name") in TOOLS else None
        if tool is None:
            return self._fail(id_, PARAMS, f"no tool {params.get('name')}")
        args = {k: v for k, v in (params.get("arguments") or {}).items() if k in TOOLS[params["name"]][1]}
        try:
            missing = [k for k in TOOLS[params["name"]][2] if k not in args]
            if missing:
                raise ToolError(f"missing {', '.join(missing)}")
            text, bad = tool(**args), False
        except (ToolError, traverse.SameNodeError, traverse.MaxHopsError) as e:
            text, bad = str(e), True
        return self._reply(id_, {"content": [{"type": "text", "text": text}], "isError": bad})

    @staticmethod
    def _reply(id_, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    @staticmethod
    def _fail(id_, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    def _find(self, label: str) -> str:
        row = lookup.resolve_symbol(self.nodes, label).first()
        if row is None:
            raise ToolError(f"no node matches {label!r}")
        return row.id

    def query_graph(self, question: str, mode: str = "bfs", depth: int = 3, token_budget: int = 2000) -> str:
        return ask.ask(self.nodes, self.edges, question, "dfs" if mode == "dfs" else "bfs", min(6, max(1, int(depth))), int(token_budget))

    def get_node(self, label: str) -> str:
        id_ = self._find(label)
        r = graph.with_degree(self.nodes.where(F.col("id") == id_), self.edges).first()
        return "\n".join([f"Node: {r.label or r.id}", f"  ID: {r.id}", f"  Source: {r.source_file}", f"  Type: {r.file_type}", f"  Community: {'' if r.community is None else r.community}", f"  Degree: {r.degree}"])

    def get_neighbors(self, label: str, relation_filter: str = "") -> str:
        rows = lookup.neighbours(self.nodes, self.edges, self._find(label), relation_filter).collect()
        return "\n".join([f"Neighbors of {label}:"] + [f"  {r.dir} {r.label} [{r.relation}] [{r.confidence}]" for r in rows])

    def get_community(self, community_id: int) -> str:
        rows = lookup.community(self.nodes, int(community_id)).collect()
        if not rows:
            raise ToolError(f"no community {community_id}")
        return "\n".join([f"Community {community_id} ({len(rows)} nodes):"] + [f"  {r.label} [{r.source_file}]" for r in rows])

    def god_nodes(self, top_n: int = 10) -> str:
        return "\n".join(["God nodes (most connected):"] + [f"  {i}. {r.label} - {r.degree} edges" for i, r in enumerate(analytics.god_nodes(self.nodes, self.edges, int(top_n)).collect(), 1)])

    def graph_stats(self) -> str:
        r = analytics.graph_stats(self.nodes, self.edges).first()
        return f"Nodes: {r.nodes}\nEdges: {r.edges}\nCommunities: {r.communities}\nEXTRACTED: {r.extracted}%\nINFERRED: {r.inferred}%\nAMBIGUOUS: {r.ambiguous}%"

    def shortest_path(self, source: str, target: str, max_hops: int = 8) -> str:
        a, b = self._find(source), self._find(target)
        hops = traverse.path_edges(self.edges, a, b, int(max_hops))
        if not hops:
            raise ToolError("no path")
        names = {r.id: r.label or r.id for r in self.nodes.where(F.col("id").isin([a, *[h["target"] for h in hops]])).collect()}
        parts = [names.get(a, a)] + [f"--{h['relation']} [{h['confidence']}]--> {names.get(h['target'], h['target'])}" if h["forward"] else f"<--{h['relation']} [{h['confidence']}]-- {names.get(h['target'], h['target'])}" for h in hops]
        return f"Shortest path ({len(hops)} hops):\n  " + " ".join(parts)
