"""The service over HTTP with the standard library: health, search, lineage, staleness, routing and metrics as JSON."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from strataloom.api import Service


def make_server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is not started yet; port 0 picks a free one."""
    policy = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, code: int, body, kind: str = "application/json") -> None:
            raw = body.encode() if isinstance(body, str) else json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _body(self) -> dict:
            size = int(self.headers.get("Content-Length") or 0)
            got = json.loads(self.rfile.read(size) or b"{}")
            if not isinstance(got, dict):
                raise ValueError("the body must be an object")
            return got

        def do_GET(self) -> None:
            path = self.path.split("?")[0]
            if path == "/health":
                self._send(200, service.health())
            elif path == "/metrics":
                self._send(200, service.metrics() + "\n", "text/plain; version=0.0.4")
            elif path == "/v1/catalog/staleness":
                self._send(200, service.staleness())
            elif path.startswith("/v1/catalog/lineage/"):
                try:
                    self._send(200, service.lineage(unquote(path.rpartition("/")[2])))
                except KeyError as error:
                    self._send(404, {"error": error.args[0]})
            else:
                self._send(404, {"error": "no such path"})

        def do_POST(self) -> None:
            try:
                body = self._body()
                if self.path == "/v1/search":
                    self._send(200, {"results": service.search(str(body["query"]), int(body.get("top_k", 10)))})
                elif self.path == "/v1/admin/routing":
                    with policy:
                        self._send(200, service.routing(**body))
                else:
                    self._send(404, {"error": "no such path"})
            except (KeyError, ValueError, TypeError) as error:
                self._send(400, {"error": str(error)})

    return ThreadingHTTPServer((host, port), Handler)
