"""Questions about one library, as dictionaries: over Python, HTTP, JSON-RPC and a command line.

The tables are DataFrames; each question filters them to one key, so partition pruning and pushed filters apply. What
comes back to the driver is one answer.
"""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers as I
from .operators import graph, search, upsert

RESULT = ("key", "version", "local", "taxon", "number", "title", "aliases", "page")
TEXT = ("statement", "proof")
WORK = ("key", "ids", "title", "authors", "year", "msc", "arxiv_category", "depth", "provenance", "citekeys")
EDGE = ("src", "dst", "origin", "confidence", "evidence")


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _edge(e: dict) -> dict:
    return {"src": e["src"], "to": e["dst"], **{k: e[k] for k in EDGE[2:]}}


class Library:
    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    def work(self, key: str) -> dict | None:
        """By key, else by any identifier the index holds; the argument is taken as it is."""
        found = _rows(self.t["works"].where(F.col("key") == key).limit(1))
        if not found:
            found = _rows(self.t["works"].join(self.t["work_ids"].where(F.col("id") == key).select(F.col("work").alias("key")), "key", "left_semi").limit(1))
        return found[0] if found else None

    def versions_of(self, work: str) -> list[dict]:
        held = self.work(work)
        return _rows(self.t["versions"].where(F.col("work") == (held["key"] if held else work)).orderBy("id"))

    def search(self, text: str, limit: int = 25) -> dict:
        hits = search.ranked(self.t["works"], text, limit)
        of = self.t["versions"].groupBy(F.col("work").alias("key")).agg(F.array_sort(F.collect_list("id")).alias("versions"))
        rows = _rows(hits.join(self.t["works"], "key").join(of, "key", "left").orderBy(F.desc("score"), "key").select(*WORK, F.coalesce("versions", F.array()).alias("versions")))
        return {"query": text, "works": rows}

    def get(self, key: str, text: bool = True) -> dict | None:
        found = _rows(self.t["results"].where(F.col("key") == key).select(*RESULT, *TEXT * text))
        if not found:
            return None
        edges = self.t["edges"]
        return {**found[0], "uses": [_edge(e) for e in _rows(edges.where(F.col("src") == key).orderBy("dst", "origin"))], "used_by": [_edge(e) for e in _rows(edges.where(F.col("dst") == key).orderBy("src", "origin"))]}

    def closure(self, key: str, depth: int = graph.MAX_DEPTH, text: bool = False) -> dict:
        spark = self.t["edges"].sparkSession
        roots = spark.createDataFrame([(key,)], "root string")
        reached = graph.closure(roots, self.t["edges"], depth)
        held = _rows(reached.join(self.t["results"].select(*RESULT, *TEXT * text), "key", "left").orderBy("hops", "key"))
        ends = graph.unresolved(roots, reached, self.t["edges"], depth).select("src", "dst")
        unresolved = _rows(self.t["edges"].where("origin = 'unspecified'").join(ends, ["src", "dst"], "left_semi").orderBy("src", "dst"))
        return {"key": key, "depth": depth, "closure": [{k: r[k] for k in (*RESULT, *TEXT * text)} for r in held if r["version"] is not None], "missing": [r["key"] for r in held if r["version"] is None], "unresolved": [_edge(e) for e in unresolved]}

    def dependents(self, key: str, text: bool = False) -> dict:
        edges = self.t["edges"].where(F.col("dst") == key)
        joined = edges.join(self.t["results"].select(F.col("key").alias("src"), F.struct(*RESULT, *TEXT * text).alias("result")), "src", "left").orderBy("src", "origin")
        return {"key": key, "used_by": [{"edge": _edge(r), "result": r["result"]} for r in _rows(joined)]}

    def neighbourhood(self, key: str) -> dict:
        work = self.work(key)
        if work is None:
            return {"key": key, "found": False}
        versions = self.t["versions"].where(F.col("work") == work["key"])
        results = self.t["results"].join(versions.select(F.col("id").alias("version")), "version", "left_semi")
        cited = graph.cited_works(self.t["edges"], results, self.t["versions"])
        refs = self.t["refs"].join(versions.select(F.col("id").alias("version")), "version", "left_semi").orderBy("version", "citekey", "text")
        return {
            "found": True, "work": {k: work[k] for k in WORK},
            "versions": [{**{k: v[k] for k in ("id", "method", "numbering")}, "results": 0} for v in _rows(versions.orderBy("id"))],
            "results": _rows(results.select(*RESULT).orderBy("key")), "cites": [r["cited"] for r in _rows(cited.orderBy("cited"))],
            "references": _rows(refs.select("work", "citekey", "text", "identified_by")),
        }

    def versions(self, key: str) -> dict:
        work = self.work(key)
        if work is None:
            return {"key": key, "found": False}
        listed = self.t["results"].groupBy(F.col("version").alias("id")).agg(F.array_sort(F.collect_list(F.struct("local", "taxon", "number"))).alias("results"))
        rows = self.t["versions"].where(F.col("work") == work["key"]).join(listed, "id", "left").orderBy("id")
        return {"found": True, "key": work["key"], "versions": [{**{k: r[k] for k in ("id", "method", "numbering", "extracted_at")}, "results": r["results"] or []} for r in _rows(rows)]}

    def bib(self, key: str) -> str | None:
        work = self.work(key)
        if work is None:
            return None
        one = self.t["works"].where(F.col("key") == work["key"])
        return one.select(I.bibtex_entry(*[F.col(c) for c in ("key", "ids", "title", "authors", "year")])).first()[0]

    def counts(self) -> dict[str, int]:
        from .schemas import COUNTED

        return {shown: self.t[t].count() for t, shown in COUNTED.items()}


def _flag(q: dict, name: str) -> bool:
    return q.get(name, ["0"])[0].lower() in ("1", "true", "yes")


def answer(lib: Library, url: str) -> tuple[int, Any]:
    """Status and body for a GET."""
    at = urlsplit(url)
    q = parse_qs(at.query, keep_blank_values=True)
    one = lambda n, d="": q.get(n, [d])[0]
    routes = {
        "/search": lambda: lib.search(one("q"), int(one("limit", "25"))),
        "/result": lambda: lib.get(one("key"), not _flag(q, "no_text")),
        "/closure": lambda: lib.closure(one("key"), int(one("depth", str(graph.MAX_DEPTH))), _flag(q, "text")),
        "/dependents": lambda: lib.dependents(one("key"), _flag(q, "text")),
        "/work": lambda: lib.neighbourhood(one("id")),
        "/versions": lambda: lib.versions(one("id")),
        "/bib": lambda: lib.bib(one("id")),
        "/counts": lib.counts,
    }
    if at.path not in routes:
        return 404, {"error": f"no such route: {at.path}"}
    try:
        out = routes[at.path]()
    except Exception as e:  # a bad request must not end the server
        return 400, {"error": str(e)}
    if out is None or isinstance(out, dict) and out.get("found") is False:
        return 404, out or {"error": "not found"}
    return 200, out


def make_server(lib: Library, host: str = "127.0.0.1", port: int = 8791) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: Any) -> None:
            data = json.dumps(body, sort_keys=True).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, OPTIONS")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send(*answer(lib, self.path))

        def do_OPTIONS(self) -> None:
            self._send(200, {})

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


#: Tools offered over JSON-RPC: name, description, arguments.
TOOLS = {
    "search": ("Search works by words of title and authors.", {"text": "string", "limit": "integer"}),
    "get": ("One result with what it uses and what uses it.", {"key": "string"}),
    "closure": ("Everything a result depends on.", {"key": "string", "depth": "integer", "text": "boolean"}),
    "dependents": ("What uses a result.", {"key": "string"}),
    "neighbourhood": ("A work and the works around it.", {"key": "string"}),
    "versions": ("The versions of a work and their results.", {"key": "string"}),
    "bib": ("A bibliography entry for a work.", {"key": "string"}),
    "counts": ("Rows of each table.", {}),
}
PROTOCOL = "2024-11-05"


def dispatch(lib: Library, request: Any) -> dict | None:
    """The response to one JSON-RPC message; None for a notification."""
    if not isinstance(request, dict) or "method" not in request:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
    method, ident, params = request["method"], request.get("id"), request.get("params") or {}
    if ident is None:
        return None
    ok = lambda result: {"jsonrpc": "2.0", "id": ident, "result": result}
    fixed = {"initialize": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lemmagraph", "version": "1"}}, "ping": {}, "resources/list": {"resources": []}, "prompts/list": {"prompts": []}}
    if method in fixed:
        return ok(fixed[method])
    if method == "tools/list":
        return ok({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in a.items()}, "required": [k for k in a if k in ("key", "text") and not (n == "closure" and k == "text")]}} for n, (d, a) in TOOLS.items()]})
    if method == "tools/call":
        name = params.get("name")
        if name not in TOOLS:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32602, "message": f"unknown tool: {name}"}}
        try:
            out = getattr(lib, name)(**(params.get("arguments") or {}))
        except Exception as e:  # reported to the caller
            return ok({"content": [{"type": "text", "text": str(e)}], "isError": True})
        return ok({"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, sort_keys=True)}], "isError": out is None})
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve_stdio(lib: Library, stdin: IO[str] | None = None, stdout: IO[str] | None = None) -> None:
    """One JSON message a line; torn lines are ignored."""
    for line in stdin or sys.stdin:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if (response := dispatch(lib, request)) is not None:
            print(json.dumps(response), file=stdout or sys.stdout, flush=True)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lemmagraph")
    p.add_argument("--index", default="index")
    sub = p.add_subparsers(dest="command", required=True)
    rebuild = sub.add_parser("rebuild")
    rebuild.add_argument("works")
    for name, (_, arguments) in TOOLS.items():
        c = sub.add_parser(name)
        for a, kind in arguments.items():
            positional = a == "key" or (name == "search" and a == "text")
            c.add_argument(a if positional else f"--{a}", **({} if positional else {"action": "store_true"} if kind == "boolean" else {"type": int}))
    sub.add_parser("serve").add_argument("--port", type=int, default=8791)
    sub.add_parser("rpc")
    a = vars(p.parse_args(argv))
    spark = SparkSession.builder.appName("lemmagraph").getOrCreate()
    from .session import ship
    from .sources import records

    ship(spark)
    command, path = a.pop("command"), a.pop("index")
    if command == "rebuild":
        index = records.rebuild(spark, a["works"])
        index.save(path)
        print(json.dumps({"written": index.written, "set_aside": index.quarantine.count()}, sort_keys=True))
        return 0
    lib = Library(records.open_index(spark, path))
    if command == "serve":
        make_server(lib, port=a["port"]).serve_forever()
    elif command == "rpc":
        serve_stdio(lib)
    else:
        out = getattr(lib, command)(**{k: v for k, v in a.items() if v is not None})
        print(out if isinstance(out, str) else json.dumps(out, indent=2, sort_keys=True))
        return int(out is None)
    return 0


def upserted(lib: Library, table: str, rows: DataFrame, seq: str) -> Library:
    """The library after rows were upserted into a table."""
    from .schemas import KEYS

    return Library({**lib.t, table: upsert.upsert(lib.t[table], rows, KEYS[table], [seq])})


if __name__ == "__main__":
    raise SystemExit(main())
