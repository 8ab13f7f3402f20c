"""Hashes, point ids and message authentication as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of the point ids: the X.500 one of RFC 4122.
NAMESPACE = "6ba7b8149dad11d180b400c04fd430c8"
_BLOCK = 64  # of SHA-256, in bytes


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, lower-case hex."""
    return F.sha2(content, 256)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(path: Column, index: Column) -> Column:
    return uuid5(F.concat_ws("::", path, index.cast("string")))


def hmac_pads(secret: str) -> tuple[str, str]:
    """Hex of the inner and outer key pads of HMAC-SHA256."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(secret: str, body: Column) -> Column:
    """Hex HMAC-SHA256 of a body, text or binary. The key never leaves the two pads."""
    inner, outer = hmac_pads(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), body.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)
