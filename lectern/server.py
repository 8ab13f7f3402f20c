"""HTTP service in front of a collection: /mcp (JSON-RPC tools), /health and /hooks/reindex.

The service is the driver of a Spark session; searches are Spark jobs. Everything a request does is in
`App.handle`, which knows no sockets; `serve` puts the standard library's threaded server around it and ends it
gracefully on SIGTERM or SIGINT: no new requests, running ones and a running index run are waited for.
"""

from __future__ import annotations

import contextlib
import json
import logging
import math
import os
import signal
import socket
import threading
import time
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lectern import __version__
from lectern.config import Config
from lectern.operators import documents, search, service, webhook
from lectern.operators.embedding import Embedder
from lectern.plans import indexer
from lectern.sources import spool, store
from lectern.streaming.reindex import Instructions, on_deliveries

log = logging.getLogger(__name__)

PROTOCOL = "2025-03-26"
IDLE_SECONDS = 60.0
CONNECTION_SECONDS = 30.0  # that a connection may keep silent
# Fixed values of JSON-RPC 2.0.
INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL = -32600, -32601, -32602, -32603


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Limiter:
    """Token bucket for each client, as theoretical arrival times: `burst` requests at once, one more every `interval` seconds. Idle clients are forgotten."""

    def __init__(self, interval: float, burst: int, clock=time.monotonic):
        self.step, self.burst, self.clock = float(interval), burst, clock
        self.tat: dict[str, float] = {}
        self.swept, self.lock = clock(), threading.Lock()

    def check(self, client: str) -> tuple[bool, int, float]:
        """Whether a request is admitted, how many more would be now, and the seconds until the next is if none would."""
        now = self.clock()
        with self.lock:
            if now - self.swept > IDLE_SECONDS:
                self.tat = {k: v for k, v in self.tat.items() if v > now}
                self.swept = now
            after = max(self.tat.get(client, now), now) + self.step
            over = after - now - self.burst * self.step
            if over > 1e-9:
                return False, 0, over
            self.tat[client] = after
            left = int((self.burst * self.step - (after - now)) / self.step + 1e-9)
            return True, left, 0.0 if left else after + self.step - now - self.burst * self.step

    def admit(self, client: str) -> bool:
        return self.check(client)[0]


class App:
    """The rules of the service. Secrets are read once; without a webhook secret there is no webhook."""

    def __init__(self, spark, config: Config, embedder: Embedder, env: Mapping[str, str] = os.environ, collection: store.VectorStore | None = None):
        self.spark, self.config, self.embedder = spark, config, embedder
        self.collection = collection or store.Collection(spark, config.qdrant.url, config.qdrant.collection)
        self.token = service.bearer_token(env, config.mcp.bearer_token_env, config.mcp.allow_unauthenticated)
        self.secret = env.get(config.webhook.secret_env) or None
        git = config.source
        self.update = webhook.GitUpdate(git.data_path, git.git_url, git.branch, env.get(git.git_token_env) or None) if git.git_url else None
        self.spool = spool.Spool(config.webhook.spool) if config.webhook.spool and self.secret else None
        self.limiter = Limiter(config.rate_limit.per_second, config.rate_limit.burst_size)
        self.collection.ensure(config.embedding.vector_size, config.indexed_fields())
        self.instructions = Instructions(self._instructions())
        self.stopping = threading.Event()
        self.wanted, self.idle = threading.Event(), threading.Event()
        self.idle.set()
        self.threads = [threading.Thread(target=f, daemon=True) for f in (self._refresh, self._reindex)]
        for t in self.threads:
            t.start()
        self.deliveries = self._follow(config) if self.spool else None

    def _follow(self, config: Config):
        """Runs driven by the spool: what was accepted and not run when the service went down is run now."""
        folder = self.spool.folder
        return on_deliveries(spool.stream(self.spark, folder), self._run, config.webhook.provider, self.secret, config.source.branch, f"file://{folder}/_checkpoint", self.update)

    def _run(self) -> None:
        indexer.run_index(self.spark, self.config, self.embedder, collection=self.collection)

    def _instructions(self) -> str:
        return search.instructions_text(self.collection.facet, self.config.indexed_fields(), self.config.mcp.instructions or search.BASE_INSTRUCTIONS)

    def _refresh(self) -> None:
        while not self.stopping.wait(self.config.mcp.metadata_refresh_secs):
            self.instructions.refresh(self._instructions)

    def _reindex(self) -> None:
        """Runs follow each other; triggers that come during a run cause one more."""
        while True:
            self.wanted.wait()
            if self.stopping.is_set():
                return
            self.wanted.clear()
            try:
                self._run()
            except Exception:
                log.exception("reindex failed")
            if not self.wanted.is_set():
                self.idle.set()

    def trigger(self) -> None:
        self.idle.clear()
        self.wanted.set()

    def stop(self) -> None:
        """Waits for a running index run."""
        self.idle.wait(600)
        if self.deliveries:
            self.deliveries.processAllAvailable()
            self.deliveries.stop()
        self.stopping.set()
        self.wanted.set()
        for t in self.threads:
            t.join(10)

    # -- requests ----------------------------------------------------------------------------------

    def handle(self, method: str, path: str, headers: Mapping[str, str], body: bytes, client: str) -> tuple[int, str, bytes]:
        """(status, content type, body) of one request; header names are lower-case."""
        return self.respond(method, path, headers, body, client)[:3]

    def respond(self, method: str, path: str, headers: Mapping[str, str], body: bytes, client: str) -> tuple[int, str, bytes, dict[str, str]]:
        """As `handle`, with the headers that tell the client its limit."""
        forwarded = headers.get("x-forwarded-for", "").split(",")[0].strip() or headers.get("x-real-ip")
        admitted, left, wait = self.limiter.check(forwarded or client)
        said = {"x-ratelimit-limit": str(self.limiter.burst), "x-ratelimit-remaining": str(left)}
        if not admitted:
            seconds = str(math.ceil(wait))
            return 429, "text/plain", b"Too Many Requests", said | {"x-ratelimit-after": seconds, "retry-after": seconds}
        return *self._route(method, path, headers, body), said

    def _route(self, method: str, path: str, headers: Mapping[str, str], body: bytes) -> tuple[int, str, bytes]:
        route = (method, path.split("?")[0].rstrip("/"))
        if route == ("GET", "/health"):
            h = service.health({"qdrant": self.collection.indexed, "embeddings": lambda: self.embedder.embed(["health"])}, log.warning)
            return h.http_status, "application/json", json.dumps(h.body()).encode()
        if route == ("POST", "/hooks/reindex") and self.secret:
            provider = self.config.webhook.provider
            signature = headers.get(webhook.HEADERS[provider])
            if self.spool:  # what is answered with 200 is on disk; the source is updated by the run
                status, said = webhook.respond(body, signature, provider, self.secret, self.config.source.branch, None, lambda: self.spool.append(body.decode("utf-8", "replace"), signature))
            else:
                status, said = webhook.respond(body, signature, provider, self.secret, self.config.source.branch, self.update, self.trigger)
            return status, "text/plain", said.encode()
        if route == ("POST", "/mcp"):
            if not webhook.same_token(self.token, headers.get("authorization")):
                return 401, "text/plain", b"Unauthorized"
            return self._rpc(body)
        return 404, "text/plain", b"Not Found"

    def _rpc(self, body: bytes) -> tuple[int, str, bytes]:
        number = None
        try:
            request = json.loads(body)
            if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                raise RpcError(INVALID_REQUEST, "not a JSON-RPC request")
            if "id" not in request:  # a notification
                return 202, "application/json", b""
            number = request["id"]
            answer = {"result": self._call(request["method"], request.get("params") or {})}
        except ValueError:
            answer = {"error": {"code": -32700, "message": "not JSON"}}
        except RpcError as e:
            answer = {"error": {"code": e.code, "message": str(e)}}
        except Exception:
            log.exception("request failed")
            answer = {"error": {"code": INTERNAL, "message": "Search query failed"}}
        return 200, "application/json", json.dumps({"jsonrpc": "2.0", "id": number, **answer}, ensure_ascii=False).encode()

    def _call(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lectern", "version": __version__}, "instructions": self.instructions.text}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": list(service.TOOLS)}
        if method != "tools/call":
            raise RpcError(NO_METHOD, f"no method {method}")
        name, given = params.get("name"), params.get("arguments") or {}
        try:
            if name == "search":
                kinds = {"query": str, "domain": str, "type": str, "tags": list, "limit": int}
                if not isinstance(given.get("query"), str) or any(v is not None and (not isinstance(v, kinds.get(k, object)) or isinstance(v, bool)) for k, v in given.items()) or (given.get("limit") or 0) < 0 or not all(isinstance(t, str) for t in given.get("tags") or []):
                    raise search.RequestError("arguments of the wrong type")
                said = search.find(self.collection, self.embedder, search.SearchRequest(**{k: v for k, v in given.items() if k in kinds}))
            elif name == "get_document":
                if not isinstance(given.get("path"), str):
                    raise documents.DocumentError("arguments of the wrong type")
                said = documents.get_document(self.config.source.data_path, given["path"], self.config.indexing.include, self.spark)
            else:
                raise RpcError(INVALID_PARAMS, f"no tool {name}")
        except (search.RequestError, documents.DocumentError) as e:
            raise RpcError(INVALID_PARAMS, str(e)) from None
        return {"content": [{"type": "text", "text": said}], "isError": False}


class Server(ThreadingHTTPServer):
    """Closing waits for the requests that are being answered, and for no others: connections that only wait are closed."""

    daemon_threads = False

    def __init__(self, *args):
        self.guard, self.waiting, self.stopping = threading.Lock(), set(), False
        super().__init__(*args)

    def waits(self, connection) -> bool:
        """Notes that a connection waits for a request; not any more once the server stops."""
        with self.guard:
            if not self.stopping:
                self.waiting.add(connection)
            return not self.stopping

    def works(self, connection) -> None:
        with self.guard:
            self.waiting.discard(connection)

    def server_close(self) -> None:
        with self.guard:
            self.stopping = True
            for c in self.waiting:
                with contextlib.suppress(OSError):
                    c.shutdown(socket.SHUT_RD)  # its thread reads the end of the stream
        super().server_close()


def http_server(app: App, host: str = "0.0.0.0", port: int | None = None) -> Server:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = CONNECTION_SECONDS

        def handle_one_request(self):
            if not self.server.waits(self.connection):
                self.close_connection = True
                return
            try:
                super().handle_one_request()
            finally:
                self.server.works(self.connection)

        def answer(self):
            self.server.works(self.connection)
            length, more = self.headers.get("content-length") or "0", {}
            if not length.strip().isdecimal():
                status, kind, body = 400, "text/plain", b"bad content length"
                self.close_connection = True
            elif (size := int(length)) > webhook.MOST_BODY:
                status, kind, body = 413, "text/plain", b"body too large"
                self.close_connection = True
                for _ in range(min(size, 8 * webhook.MOST_BODY) >> 16):  # so that the client reads the answer
                    self.rfile.read(1 << 16)
                self.rfile.read(min(size, 8 * webhook.MOST_BODY) & 0xFFFF)
            else:
                status, kind, body, more = app.respond(self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(size), self.client_address[0])
            self.send_response(status)
            for name, value in {"Content-Type": kind, "Content-Length": str(len(body)), **more}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = answer

        def log_message(self, form, *args):
            log.debug(form, *args)

    return Server((host, app.config.mcp.port if port is None else port), Handler)


def serve(spark, config: Config, embedder: Embedder) -> int:
    app = App(spark, config, embedder)
    server = http_server(app)
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: threading.Thread(target=server.shutdown).start())
    log.info("serving on port %s", server.server_address[1])
    server.serve_forever()
    server.server_close()
    app.stop()
    return 0
