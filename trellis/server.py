"""HTTP gateway: /sparql, /ontology, /status and, if opened, /sql."""

from __future__ import annotations

import json
import threading
import urllib.parse
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from trellis.engine import Engine
from trellis.errors import TrellisError, status_of

CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type, Accept, Authorization"}


def _json_array(rows: DataFrame, size: int = 1000) -> Iterator[str]:
    """All rows as a JSON array, a partition at a time on the driver."""
    page, mark = [], "["
    for row in rows.toLocalIterator(prefetchPartitions=True):
        page.append(json.dumps(row.asDict(recursive=True), default=str))
        if len(page) == size:
            yield mark + ",\n".join(page)
            page, mark = [], ",\n"
    yield mark + ",\n".join(page) + "]" if page else ("[]" if mark == "[" else "]")


class Gateway:
    """A threaded server around an engine; at most ``workers`` queries run at a time."""

    def __init__(self, engine: Engine, port: int = 5820, workers: int = 4, host: str = "127.0.0.1", allow_sql: bool = False):
        if not 1 <= workers <= 64:
            raise ValueError("workers: 1 to 64")
        self.engine, self.workers, self.allow_sql, self.running = engine, workers, allow_sql, 0
        self.slots, self.lock = threading.Semaphore(workers), threading.Lock()
        self.server = ThreadingHTTPServer((host, port), self._handler())
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]
        self.thread: threading.Thread | None = None

    def start(self) -> Gateway:
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()

    def status(self) -> dict:
        return {"port": self.port, "workers": self.workers, "running": self.running, "alive": bool(self.thread and self.thread.is_alive())}

    def _handler(self):
        gateway = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *args) -> None:
                pass

            def reply(self, status: int, body, kind: str = "application/json") -> None:
                data = body if isinstance(body, bytes) else json.dumps(body, default=str).encode()
                self.send_response(status)
                for name, value in {**CORS, "Content-Type": kind, "Content-Length": str(len(data))}.items():
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(data)

            def chunked(self, parts, kind: str = "application/sparql-results+json") -> None:
                first = next(parts)  # an error in planning still gets its own status
                self.send_response(200)
                for name, value in {**CORS, "Content-Type": kind, "Transfer-Encoding": "chunked"}.items():
                    self.send_header(name, value)
                self.end_headers()
                for part in (x for y in ([first], parts) for x in y):
                    if data := part.encode():
                        self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
                self.wfile.write(b"0\r\n\r\n")

            def do_OPTIONS(self) -> None:  # noqa: N802
                self.send_response(204)
                for name, value in {**CORS, "Content-Length": "0"}.items():
                    self.send_header(name, value)
                self.end_headers()

            def do_GET(self) -> None:  # noqa: N802
                self.serve("")

            def do_POST(self) -> None:  # noqa: N802
                self.serve(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace"))

            def text_of(self, url, body: str) -> str:
                form = urllib.parse.parse_qs(body) if "x-www-form-urlencoded" in self.headers.get("Content-Type", "") else {}
                return form["query"][0] if "query" in form else body or urllib.parse.parse_qs(url.query).get("query", [""])[0]

            def serve(self, body: str) -> None:
                url = urllib.parse.urlsplit(self.path)
                try:
                    with gateway.slots:
                        with gateway.lock:
                            gateway.running += 1
                        try:
                            self.route(url, body)
                        finally:
                            with gateway.lock:
                                gateway.running -= 1
                except Exception as e:
                    message = str(e) if isinstance(e, (TrellisError, ValueError)) else f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
                    self.reply(status_of(e), {"error": message})

            def route(self, url, body: str) -> None:
                engine = gateway.engine
                if url.path == "/sparql":
                    text = self.text_of(url, body)
                    if engine.parse(text).form == "ASK":
                        self.reply(200, engine.sparql_json(text), "application/sparql-results+json")
                    else:
                        self.chunked(engine.stream_json(text))
                elif url.path == "/ontology":
                    self.reply(200, engine.inspect_ontology(), "application/ld+json")
                elif url.path == "/status":
                    self.reply(200, gateway.status() | engine.cache_stats())
                elif url.path == "/sql" and gateway.allow_sql:
                    self.chunked(_json_array(engine.spark.sql(self.text_of(url, body))), "application/json")
                else:
                    self.reply(404, {"error": "no such path"})

        return Handler
