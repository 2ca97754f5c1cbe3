"""A small JSON interface over an index, by the standard library's server."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from lodestrata.answer import ModelUnavailable, ask
from lodestrata.storage import scratch

MOST_HITS = 50
PAGE = """<!doctype html><meta charset="utf-8"><title>Lodestrata</title>
<form onsubmit="fetch('/api/search?q='+encodeURIComponent(q.value)).then(r=>r.json()).then(x=>out.textContent=JSON.stringify(x,null,1));return false">
<input id="q" size="60" autofocus> <button>Search</button></form><pre id="out"></pre>"""


class _BadRequest(ValueError):
    pass


def handler_of(index) -> type[BaseHTTPRequestHandler]:
    def search(args: dict) -> object:
        if not (query := args.get("q", "")):
            raise _BadRequest("q is missing")
        try:
            k = min(int(args.get("k", 10)), MOST_HITS)
        except ValueError as e:
            raise _BadRequest("k must be a number") from e
        return {"results": index.search(query, k=k, language=args.get("lang") or None, kind=args.get("kind") or None)}

    def outline(args: dict) -> object:
        if not (file := args.get("file", "")):
            raise _BadRequest("file is missing")
        return {"outline": [r.asDict() for r in index.outline(file).collect()]}

    def answer(body: dict) -> object:
        if not (question := str(body.get("question", "")).strip()):
            raise _BadRequest("question is missing")
        return ask(index, question, provider=body.get("provider", "auto"))

    reads = {"/api/search": search, "/api/stats": lambda _: index.stats(), "/api/outline": outline}
    writes = {"/api/ask": answer}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            """Quiet."""

        def reply(self, status: int, body: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def run(self, routes: dict, args) -> None:
            route = routes.get(urlparse(self.path).path)
            try:
                # A request's intermediate tables go with it.
                with scratch(index.spark):
                    status, value = (200, route(args())) if route else (404, {"error": "not found"})
            except (_BadRequest, json.JSONDecodeError) as e:
                status, value = 400, {"error": str(e)}
            except ModelUnavailable as e:
                status, value = 502, {"error": str(e)}
            except Exception as e:  # noqa: BLE001  the server outlives a failed query
                status, value = 500, {"error": str(e)}
            self.reply(status, json.dumps(value).encode(), "application/json")

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/":
                self.reply(200, PAGE.encode(), "text/html; charset=utf-8")
            else:
                self.run(reads, lambda: {k: v[-1] for k, v in parse_qs(url.query).items()})

        def do_POST(self) -> None:
            self.run(writes, lambda: json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}"))

    return Handler


def serve(index, port: int, background: bool = False) -> ThreadingHTTPServer:
    server = ThreadingHTTPServer(("127.0.0.1", port), handler_of(index))
    if background:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    else:
        server.serve_forever()
    return server
