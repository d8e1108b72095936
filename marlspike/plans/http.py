"""The engine's routes over HTTP: one handler for all of them, and a server that runs a bounded number of requests at a time."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from marlspike.plans.engine import OPS, Engine, dispatch, openapi

#: Requests that run at a time unless another number is given.
WORKERS = 4
TYPES = {"integer": int, "string": str}


def handle(engine: Engine, method: str, target: str, body: str = "", now: str = "") -> tuple[int, object]:
    """Status and answer of a request: the operations by their paths, /openapi.json, and /mcp for JSON-RPC."""
    url = urlsplit(target)
    try:
        if (method, url.path) == ("GET", "/openapi.json"):
            return 200, openapi()
        if (method, url.path) == ("POST", "/mcp"):
            return 200, dispatch(engine, json.loads(body))
        name = next((k for k, (m, path, *_) in OPS.items() if path == url.path and m == method), None)
        if name is None:
            return (405 if any(path == url.path for _, path, *_ in OPS.values()) else 404), {"error": f"no route {method} {url.path}"}
        if name == "health":
            return 200, {"status": "ok"}
        if name == "ingest":
            sent = json.loads(body)
            sent = sent if isinstance(sent, list) else sent.get("leafs", [sent])
            return 200, engine.ingest(sent, now)
        known = OPS[name][2]
        given = {k: TYPES[known[k]](v) for k, v in parse_qsl(url.query) if k in known}
        missing = [k for k in ("q", "id") if k in known and not given.get(k, "").strip()]
        if missing:
            return 400, {"error": f"{missing[0]} is needed"}
        if name == "get":
            found = engine.get(given["id"])
            return (200, found) if found else (404, {"error": "no such leaf"})
        return 200, getattr(engine, name)(**given)
    except (ValueError, TypeError, KeyError) as e:
        return 400, {"error": str(e)}


def server(engine: Engine, port: int = 0, workers: int = WORKERS, clock=None) -> ThreadingHTTPServer:
    """A server on localhost that isn't started yet (serve_forever); further requests wait until one of `workers` has ended."""
    from datetime import datetime, timezone

    room = threading.BoundedSemaphore(max(1, workers))
    clock = clock or (lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            with room:
                try:
                    status, out = handle(engine, self.command, self.path, body, clock())
                except Exception as e:  # noqa: BLE001  one failed request mustn't end the server
                    status, out = 500, {"error": str(e)}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
