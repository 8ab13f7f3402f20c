"""The service: tools, health, webhook, limits, shutdown."""

import hashlib
import hmac
import json
import socket
import threading
import time
import urllib.error
import urllib.request
from dataclasses import replace

import pytest

from lectern import config as settings
from lectern import server
from lectern.operators.embedding import HashingEmbedder
from lectern.plans import indexer


@pytest.fixture
def app(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.md").write_text("---\ntitle: A\ndomain: eng\n---\n# A\nalpha beta")
    config = settings.Config(
        source=settings.Source(data_path=str(data), branch="main"), frontmatter=settings.Frontmatter(indexed_fields=("domain",)), embedding=settings.Embedding("hashing:", "m", vector_size=8),
        qdrant=settings.Qdrant(f"file://{tmp_path}/store", "kb"), webhook=settings.Webhook(provider="github"), rate_limit=settings.RateLimit(per_second=1000, burst_size=1000),
    )
    indexer.run_index(spark, config, HashingEmbedder(8))
    app = server.App(spark, config, HashingEmbedder(8), {"MCP_BEARER_TOKEN": "t", "WEBHOOK_SECRET": "s"})
    yield app
    app.stop()


def rpc(app, method, params=None, token="t"):
    status, _, body = app.handle("POST", "/mcp", {"authorization": f"Bearer {token}"}, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode(), "c")
    return status, json.loads(body) if status == 200 else body


def call(app, name, **arguments):
    return rpc(app, "tools/call", {"name": name, "arguments": arguments})[1]


def test_tools(app):
    assert rpc(app, "ping", token="x")[0] == 401
    first = rpc(app, "initialize")[1]["result"]
    assert first["instructions"].endswith("Available domain: eng")
    assert [t["name"] for t in rpc(app, "tools/list")[1]["result"]["tools"]] == ["search", "get_document"]
    assert "**Title**: A" in call(app, "search", query="alpha", domain="eng")["result"]["content"][0]["text"]
    assert call(app, "search", query="alpha", limit=0)["result"]["content"][0]["text"] == "No results found."
    assert call(app, "get_document", path="a.md")["result"]["content"][0]["text"].startswith("---")
    for bad in (("search", {"query": "q" * 4097}), ("search", {"query": 5}), ("search", {"query": "q", "limit": -1}), ("get_document", {"path": "../x"}), ("other", {})):
        assert call(app, bad[0], **bad[1])["error"]["code"] == server.INVALID_PARAMS
    assert rpc(app, "nothing")[1]["error"]["code"] == server.NO_METHOD
    assert json.loads(app.handle("POST", "/mcp", {"authorization": "Bearer t"}, b"{", "c")[2])["error"]["code"] == -32700


def test_health_and_other_paths(app):
    status, _, body = app.handle("GET", "/health", {}, b"", "c")
    assert (status, json.loads(body)) == (200, {"status": "healthy", "qdrant": {"status": "ok"}, "embeddings": {"status": "ok"}})
    app.collection.drop()
    status, _, body = app.handle("GET", "/health", {}, b"", "c")
    assert (status, json.loads(body)["qdrant"]) == (503, {"status": "unavailable"})
    assert app.handle("GET", "/nowhere", {}, b"", "c")[0] == 404


def test_webhook_runs_an_index_run(app, tmp_path):
    (tmp_path / "data/b.md").write_text("# B")
    body = b'{"ref":"refs/heads/main"}'
    good = {"x-hub-signature-256": "sha256=" + hmac.new(b"s", body, hashlib.sha256).hexdigest()}
    assert app.handle("POST", "/hooks/reindex", {}, body, "c")[0] == 401
    assert app.handle("POST", "/hooks/reindex", good, body, "c")[::2] == (200, b"Reindex triggered")
    assert app.idle.wait(60) and app.collection.count() == 2
    app.secret = None
    assert app.handle("POST", "/hooks/reindex", good, body, "c")[0] == 404


def test_limiter():
    now = [0.0]
    limiter = server.Limiter(0.5, 3, lambda: now[0])
    assert [limiter.admit("a") for _ in range(4)] == [True, True, True, False] and limiter.admit("b")
    now[0] = 0.5
    assert [limiter.admit("a") for _ in range(2)] == [True, False]
    now[0] = 100.0
    limiter.admit("b")
    assert set(limiter.tat) == {"b"}


def test_limits_are_told(app):
    """One request more every `per_second` seconds, and headers that say so."""
    now = [0.0]
    app.limiter = server.Limiter(settings.RateLimit().per_second, 2, lambda: now[0])
    said = [app.respond("GET", "/nowhere", {}, b"", "c") for _ in range(3)]
    assert [(s[0], s[3]["x-ratelimit-limit"], s[3]["x-ratelimit-remaining"]) for s in said] == [(404, "2", "1"), (404, "2", "0"), (429, "2", "0")]
    assert said[2][3]["retry-after"] == said[2][3]["x-ratelimit-after"] == "2" and "retry-after" not in said[0][3]
    now[0] = 1.5
    assert app.respond("GET", "/nowhere", {}, b"", "c")[3]["retry-after"] == "1"
    now[0] = 2.0
    assert app.respond("GET", "/nowhere", {}, b"", "c")[0] == 404


def test_deliveries_that_come_while_the_service_is_down(app, tmp_path):
    body = b'{"ref":"refs/heads/main"}'
    good = {"x-hub-signature-256": "sha256=" + hmac.new(b"s", body, hashlib.sha256).hexdigest()}
    spooled = replace(app.config, webhook=replace(app.config.webhook, spool=f"file://{tmp_path}/spool"))
    env = {"MCP_BEARER_TOKEN": "t", "WEBHOOK_SECRET": "s"}
    first = server.App(app.spark, spooled, app.embedder, env)
    first.deliveries.stop()  # what follows is accepted and on disk, but not run
    (tmp_path / "data/b.md").write_text("# B")
    assert first.handle("POST", "/hooks/reindex", {}, body, "c")[0] == 401
    for _ in range(2):
        assert first.handle("POST", "/hooks/reindex", good, body, "c")[::2] == (200, b"Reindex triggered")
    assert app.collection.count() == 1
    first.deliveries = None
    first.stop()
    second = server.App(app.spark, spooled, app.embedder, env)
    second.deliveries.processAllAvailable()
    assert app.collection.count() == 2
    version = app.collection.versions.latest()["version"]
    (tmp_path / "data/c.md").write_text("# C")
    second.stop()
    third = server.App(app.spark, spooled, app.embedder, env)
    third.deliveries.processAllAvailable()  # nothing new: nothing is run again
    assert app.collection.versions.latest()["version"] == version
    assert third.handle("POST", "/hooks/reindex", good, body, "c")[0] == 200
    third.stop()  # waits for the run
    assert app.collection.count() == 3 and max(third.spool.numbers()) == 3


def test_a_token_is_needed(app):
    with pytest.raises(RuntimeError):
        server.App(app.spark, app.config, app.embedder, {})
    open_ = server.App(app.spark, replace(app.config, mcp=settings.Mcp(allow_unauthenticated=True)), app.embedder, {})
    assert open_.token is None and open_.secret is None
    open_.stop()


def test_graceful_shutdown(app):
    s = server.http_server(app, "127.0.0.1", 0)
    t = threading.Thread(target=s.serve_forever, daemon=True)
    t.start()
    at = ("127.0.0.1", s.server_address[1])
    base = f"http://{at[0]}:{at[1]}"
    with urllib.request.urlopen(f"{base}/health", timeout=60) as answer:
        assert json.load(answer)["status"] == "healthy" and answer.headers["x-ratelimit-limit"] == "1000"
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(f"{base}/mcp", b"x" * ((1 << 20) + 1)), timeout=60)
    assert e.value.code == 413
    for size in ("-5", "many"):
        with socket.create_connection(at, timeout=20) as c:
            c.sendall(f"POST /mcp HTTP/1.1\r\nHost: x\r\nContent-Length: {size}\r\n\r\n".encode())
            assert c.recv(100).startswith(b"HTTP/1.1 400")
    idle = socket.create_connection(at, timeout=20)  # kept alive, and silent
    idle.sendall(b"GET /nowhere HTTP/1.1\r\nHost: x\r\n\r\n")
    assert idle.recv(100).startswith(b"HTTP/1.1 404")
    silent = socket.create_connection(at, timeout=20)
    busy = []
    started = threading.Event()
    handle = app.respond

    def slow(*request):
        started.set()
        time.sleep(1)
        return handle(*request)

    app.respond = slow
    r = threading.Thread(target=lambda: busy.append(urllib.request.urlopen(f"{base}/health", timeout=60).status))
    r.start()
    assert started.wait(20)
    begun = time.monotonic()
    s.shutdown()
    t.join(10)
    s.server_close()
    r.join(20)
    assert not t.is_alive() and busy == [200] and time.monotonic() - begun < 20
    idle.close()
    silent.close()
