"""Text expressions: trimming, sizes, snippets, URLs, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 400


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def snippet(text: Column, n: int = SNIPPET) -> Column:
    """The first n characters, with an ellipsis where more follow."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def redact_urls(text: Column) -> Column:
    """Credentials of every http(s) URL in a text become ***."""
    return F.regexp_replace(text, "(https?://)[^/@]+@", "$1***@")


def inject_token(url: Column, token: str) -> Column:
    """The token as user info of an http(s) URL; other URLs as they are."""
    return F.regexp_replace(url, "^(https?://)", F.concat(F.lit("$1"), F.lit(re.sub(r"([\\$])", r"\\\1", token)), F.lit("@")))


class GlobError(ValueError):
    pass


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob over whole relative paths.

    `*` and `?` may cross `/`, `**/` also stands for no folder at all, `{a,b}` are
    alternatives, `[...]` and `[!...]` classes, a backslash takes the next character as it is.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "^") else i + 1 if pattern[i + 1 : i + 2] != "]" else i + 2)
            if end < 0:
                raise GlobError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "\\":
            if i + 1 >= len(pattern):
                raise GlobError(f"nothing after the backslash of {pattern!r}")
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise GlobError(f"unclosed alternatives in {pattern!r}")
    return "(?s)^(?:" + "".join(out) + ")$"


def any_glob(patterns, strict: bool = True, fallback: str | None = None) -> str | None:
    """One expression for a set of globs, None for an empty set.

    strict: an invalid glob is an error; else it is left out, and `fallback` stands in where none is left.
    """
    good = []
    for p in patterns:
        try:
            good.append(glob_regex(p)[4:])
        except GlobError:
            if strict:
                raise
    if not good and fallback:
        good = [glob_regex(fallback)[4:]]
    return "(?s)" + "|".join(good) if good else None


def matches_any(path: Column, patterns, strict: bool = True) -> Column:
    """Whether a relative path matches one of the globs; no globs match nothing."""
    regex = any_glob(patterns, strict)
    return F.lit(False) if regex is None else path.rlike(regex)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_field(json: Column, path: str) -> Column:
    """Variant at a path (as `$.a`) of a JSON text, null where the text is no JSON or has nothing there."""
    return F.try_variant_get(F.try_parse_json(json), path, "variant")


def json_string(json: Column, path: str) -> Column:
    """The string at a path of a JSON text; null for values of other types."""
    return _let(json_field(json, path), lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))


def json_strings(json: Column, path: str) -> Column:
    """The strings of a list at a path of a JSON text, elements of other types left out; null for values that are no list."""
    items = _let(json_field(json, path), lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<variant>")))
    return F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), lambda x: x.isNotNull())
