"""Health, server info and start-up rules of a service around a collection."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from lectern import __version__


_TEXT = {"type": "string"}
TOOLS = (
    {
        "name": "search",
        "description": "Search by meaning. Gives ranked chunks with title, score, place, a snippet and metadata; domain, type and tags narrow the search.",
        "inputSchema": {"type": "object", "properties": {"query": _TEXT, "domain": _TEXT, "type": _TEXT, "tags": {"type": "array", "items": _TEXT}, "limit": {"type": "integer", "minimum": 0}}, "required": ["query"]},
    },
    {"name": "get_document", "description": "The whole text of a file, frontmatter included, by a path that search gave.", "inputSchema": {"type": "object", "properties": {"path": _TEXT}, "required": ["path"]}},
)


@dataclass(frozen=True)
class Component:
    """`ok` or `unavailable`. What failed is in the log; a client gets no error text."""

    status: str


@dataclass(frozen=True)
class Health:
    status: str
    components: Mapping[str, Component]

    @property
    def http_status(self) -> int:
        return 200 if self.status == "healthy" else 503

    def body(self) -> dict:
        return {"status": self.status} | {name: {"status": c.status} for name, c in self.components.items()}


def health(checks: Mapping[str, Callable[[], object]], log: Callable[[str], object] = print) -> Health:
    """All checks at once; healthy if all pass. Errors are logged, not shown."""

    def run(item):
        name, check = item
        try:
            check()
            return name, Component("ok")
        except Exception as e:
            log(f"health check of {name} failed: {e}")
            return name, Component("unavailable")

    with ThreadPoolExecutor(max(1, len(checks))) as pool:
        parts = dict(pool.map(run, checks.items()))
    return Health("healthy" if all(c.status == "ok" for c in parts.values()) else "degraded", parts)


def server_info(instructions: str) -> dict:
    return {"name": "lectern", "version": __version__, "instructions": instructions, "tools": [t["name"] for t in TOOLS]}


def bearer_token(env: Mapping[str, str], name: str, allow_unauthenticated: bool) -> str | None:
    """The token, or None where running without one is allowed; else a refusal to start."""
    token = env.get(name) or None
    if token is None and not allow_unauthenticated:
        raise RuntimeError(f"{name} is not set and unauthenticated access is not allowed")
    return token
