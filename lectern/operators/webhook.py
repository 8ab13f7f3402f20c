"""Webhook deliveries as rows: signature, branch, outcome; the git update as an interface."""

from __future__ import annotations

import hashlib
import hmac
import json
import logging
import re
import secrets
import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.identity import hmac_sha256
from lectern.functions.text import json_string

log = logging.getLogger(__name__)

# The header that carries the signature or token of each provider.
HEADERS = {"github": "x-hub-signature-256", "gitea": "x-gitea-signature", "gitlab": "x-gitlab-token"}
MOST_BODY = 1 << 20


def _equal(a: Column, b: Column) -> Column:
    """Equality that takes the same time whatever agrees: digests under a fresh random key are compared."""
    key = F.lit(secrets.token_hex(32))
    return F.sha2(F.concat(key, a), 256) == F.sha2(F.concat(key, b), 256)


def verified(body: Column, signature: Column, provider: str, secret: str) -> Column:
    """Whether the header value proves the secret: hex HMAC-SHA256 of the body (a sha256= prefix may stand before), or the shared token."""
    if provider == "gitlab":
        return F.coalesce(_equal(signature, F.lit(secret)), F.lit(False))
    if provider not in HEADERS:
        raise ValueError(f"unknown provider {provider}")
    return F.coalesce(_equal(F.regexp_replace(signature, "^sha256=", ""), hmac_sha256(secret, body)), F.lit(False))


def branch(body: Column) -> Column:
    """Branch of a push, null where the body has no string `ref`."""
    return F.regexp_replace(json_string(body.cast("string"), "$.ref"), "^refs/heads/", "")


def outcomes(deliveries: DataFrame, provider: str, secret: str, expected_branch: str, body: str = "body", signature: str = "signature") -> DataFrame:
    """deliveries plus `branch`, `status`, `message` and `triggered`: 401 for a bad signature, 200 otherwise, ignored or triggered."""
    # Columns of their own, so that each is evaluated once.
    known = deliveries.withColumn("branch", branch(F.col(body))).withColumn("_good", verified(F.col(body), F.col(signature), provider, secret))
    ref, good = F.col("branch"), F.col("_good")
    on = F.coalesce(ref == expected_branch, F.lit(False))
    too_large = F.octet_length(F.col(body)) > MOST_BODY
    ignored = F.when(ref.isNull(), "No ref in payload, ignored").otherwise(F.concat(F.lit("Branch ignored: '"), ref, F.lit(f"' (expected '{expected_branch}')")))
    return (
        known.withColumn("status", F.when(too_large, 413).when(~good, 401).otherwise(200).cast("bigint"))
        .withColumn("message", F.when(too_large, "body too large").when(~good, "Invalid signature").when(~on, ignored).otherwise("Reindex triggered"))
        .withColumn("triggered", ~too_large & good & on)
        .drop("_good")
    )


def respond(body: bytes, header: str | None, provider: str, secret: str, expected_branch: str, update=None, trigger=None) -> tuple[int, str]:
    """Status and message of one delivery, as `outcomes` has them; a failing update of the source is a 500, else `trigger` is called."""
    if len(body) > MOST_BODY:
        return 413, "body too large"
    if provider == "gitlab":
        good = hmac.compare_digest((header or "").encode(), secret.encode())
    else:
        good = hmac.compare_digest((header or "").removeprefix("sha256=").encode(), hmac.new(secret.encode(), body, hashlib.sha256).hexdigest().encode())
    if not good:
        return 401, "Invalid signature"
    try:
        found = json.loads(body)
        ref = found.get("ref") if isinstance(found, dict) else None
    except ValueError:
        ref = None
    if not isinstance(ref, str):
        return 200, "No ref in payload, ignored"
    name = ref.removeprefix("refs/heads/")
    if name != expected_branch:
        return 200, f"Branch ignored: '{name}' (expected '{expected_branch}')"
    try:
        if update:
            update()
    except GitError as e:
        log.error("%s", e)
        return 500, e.said
    if trigger:
        trigger()
    return 200, "Reindex triggered"


def same_token(expected: str | None, header: str | None) -> bool:
    """Bearer check in constant time; no expected token admits all."""
    if expected is None:
        return True
    return bool(header and header.startswith("Bearer ")) and hmac.compare_digest(header[7:].encode(), expected.encode())


class GitError(RuntimeError):
    """`said` is what a client may read."""

    def __init__(self, said: str, detail: str = ""):
        super().__init__(f"{said}: {detail}" if detail else said)
        self.said = said


class GitUpdate:
    """Brings an existing checkout to the head of a branch, forward only."""

    def __init__(self, folder: str, url: str, branch: str, token: str | None = None, run=subprocess.run):
        self.folder, self.url, self.branch, self.token, self.run = folder, url, branch, token, run

    def __call__(self) -> None:
        url = re.sub("^(https?://)", lambda m: f"{m[1]}{self.token}@", self.url) if self.token else self.url
        for args in (["fetch", "--no-tags", url, self.branch], ["merge", "--ff-only", "FETCH_HEAD"]):
            try:
                done = self.run(["git", "-c", f"safe.directory={self.folder}", "-C", self.folder, *args], capture_output=True, text=True)
            except OSError as e:
                raise GitError("Failed to run git", str(e)) from None
            if done.returncode:
                raise GitError(f"Git {args[0]} failed", re.sub("(https?://)[^/@]+@", r"\1***@", done.stderr.strip()))
