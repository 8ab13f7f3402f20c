"""Configuration: YAML file, environment over file, file over defaults, one error for all that is missing."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any, get_type_hints

import yaml


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    git_url: str | None = None
    branch: str = "master"
    data_path: str = "/data"
    git_token_env: str = "GIT_PULL_TOKEN"


@dataclass(frozen=True)
class Indexing:
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = (".git/**", ".claude/**", ".tools/**", "node_modules/**")
    exclude_files: tuple[str, ...] = ("CLAUDE.md", "README.md")


@dataclass(frozen=True)
class Frontmatter:
    required: tuple[str, ...] = ()
    indexed_fields: tuple[str, ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Chunking:
    max_chunk_size: int = 1500
    target_chunk_size: int | None = 1000
    prepend_description: bool = True

    @property
    def target(self) -> int:
        return self.max_chunk_size if self.target_chunk_size is None else self.target_chunk_size


@dataclass(frozen=True)
class Embedding:
    base_url: str | None = None
    model: str | None = None
    api_key: str | None = field(default=None, repr=False)
    vector_size: int = 768
    batch_size: int = 32


@dataclass(frozen=True)
class Qdrant:
    """Where points live; the URL is the root folder of the snapshots."""

    url: str | None = None
    collection: str = "knowledge-base"
    graph: bool = False  # single searches by a graph of the points, which runs keep up


@dataclass(frozen=True)
class Validation:
    enabled: bool = True
    strict: bool = False
    lint_command: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Webhook:
    secret_env: str = "WEBHOOK_SECRET"
    provider: str = "gitea"
    spool: str | None = None  # a folder for accepted deliveries; with it none is lost when the service goes down


@dataclass(frozen=True)
class Mcp:
    port: int = 8001
    bearer_token_env: str = "MCP_BEARER_TOKEN"
    allow_unauthenticated: bool = False
    instructions: str | None = None
    metadata_refresh_secs: int = 300


@dataclass(frozen=True)
class RateLimit:
    """`per_second` is the number of seconds after which a client gains one request, whatever its name says: the key is read as it has always worked."""

    per_second: int = 2
    burst_size: int = 10


@dataclass(frozen=True)
class Config:
    source: Source = Source()
    indexing: Indexing = Indexing()
    frontmatter: Frontmatter = Frontmatter()
    chunking: Chunking = Chunking()
    embedding: Embedding = Embedding()
    qdrant: Qdrant = Qdrant()
    validation: Validation = Validation()
    webhook: Webhook = Webhook()
    mcp: Mcp = Mcp()
    rate_limit: RateLimit = RateLimit()

    @property
    def state_path(self) -> str:
        return f"{self.source.data_path.rstrip('/')}/state"

    def indexed_fields(self) -> list[str]:
        """The user's fields and file_path, which is never listed twice."""
        own = list(self.frontmatter.indexed_fields)
        return own if "file_path" in own else [*own, "file_path"]


def _build(kind: type, raw: Any, where: str):
    """An instance of a config dataclass; unknown keys and wrong types are errors at every level."""
    if raw is None:
        raw = {}
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{where or 'config'}: expected a mapping")
    hints = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    if odd := sorted(set(map(str, raw)) - known):
        raise ConfigError(f"{where or 'config'}: unknown key {', '.join(odd)}")
    return kind(**{k: _value(hints[k], v, f"{where}.{k}".strip(".")) for k, v in raw.items()})


def _value(kind: Any, raw: Any, where: str):
    if is_dataclass(kind):
        return _build(kind, raw, where)
    text = str(kind)
    if raw is None and "None" in text:
        return None
    if "tuple" in text:
        if not isinstance(raw, list) or not all(isinstance(x, str) for x in raw):
            raise ConfigError(f"{where}: expected a list of strings")
        return tuple(raw)
    if "Mapping" in text:
        if not isinstance(raw, Mapping) or not all(isinstance(x, str) for p in raw.items() for x in p):
            raise ConfigError(f"{where}: expected a mapping of strings")
        return dict(raw)
    want = bool if "bool" in text else int if "int" in text else str
    if not isinstance(raw, want) or (want is int and isinstance(raw, bool)) or (want is int and raw < 0):
        raise ConfigError(f"{where}: expected {want.__name__}")
    return raw


def resolve(config: Config, env: Mapping[str, str] | None = None) -> Config:
    """Environment applied and bounds checked."""
    env = os.environ if env is None else env
    emb, store = config.embedding, config.qdrant
    if "EMBEDDING_BASE_URL" in env:
        emb = replace(emb, base_url=env["EMBEDDING_BASE_URL"])
    if "EMBEDDING_MODEL" in env:
        emb = replace(emb, model=env["EMBEDDING_MODEL"])
    if "EMBEDDING_API_KEY" in env:
        emb = replace(emb, api_key=env["EMBEDDING_API_KEY"])
    if "EMBEDDING_VECTOR_SIZE" in env:
        try:
            emb = replace(emb, vector_size=int(env["EMBEDDING_VECTOR_SIZE"]))
        except ValueError:
            raise ConfigError("EMBEDDING_VECTOR_SIZE must be an integer") from None
    if "QDRANT_URL" in env:
        store = replace(store, url=env["QDRANT_URL"])
    out = replace(config, embedding=emb, qdrant=store)
    c = out.chunking
    if c.max_chunk_size < 1:
        raise ConfigError("chunking.max_chunk_size must be at least 1")
    if c.target < 1 or c.target > c.max_chunk_size:
        raise ConfigError("chunking.target_chunk_size must be between 1 and max_chunk_size")
    for name, value, least in (("embedding.vector_size", emb.vector_size, 1), ("embedding.batch_size", emb.batch_size, 1), ("rate_limit.per_second", out.rate_limit.per_second, 1), ("rate_limit.burst_size", out.rate_limit.burst_size, 1), ("mcp.metadata_refresh_secs", out.mcp.metadata_refresh_secs, 10)):
        if value < least:
            raise ConfigError(f"{name} must be at least {least}")
    if out.webhook.provider not in ("gitea", "github", "gitlab"):
        raise ConfigError("webhook.provider must be gitea, github or gitlab")
    missing = [n for n, v in (("embedding.base_url (EMBEDDING_BASE_URL)", emb.base_url), ("embedding.model (EMBEDDING_MODEL)", emb.model), ("qdrant.url (QDRANT_URL)", store.url)) if not v]
    if missing:
        raise ConfigError("missing required settings: " + "; ".join(missing))
    return out


def parse(text: str) -> Config:
    return _build(Config, yaml.safe_load(text), "")


def load(path: str | Path, env: Mapping[str, str] | None = None) -> Config:
    """Resolved configuration; a missing file means defaults."""
    p = Path(path)
    return resolve(parse(p.read_text()) if p.exists() else Config(), env)
