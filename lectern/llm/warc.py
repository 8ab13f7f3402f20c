"""WARC derivative builder: responses to linked metadata and conversion records (operator 4).

For each captured response three WARC/1.1 records come out: the response itself, a
`metadata` record (application/warc-fields: the source's HTTP and WARC headers, as they were,
and facts about the capture) and a `conversion` record (text/plain). Both derivatives
carry WARC-Refers-To with the response's record id and the response's target URI and
date. Where the source has record ids, payload digests or WARC headers of its own, those are
kept. Ids that are made are UUIDs of version 5 from target, date and payload digest, so a rerun
makes the same ones; digests that are made are labelled base32 SHA-1. Markup is taken off in Python, in linear time; all else is JVM expressions.
"""

from __future__ import annotations

import json
import re
import zlib
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.llm._spark import session_for_texts

CRLF = "\r\n"
# Name space of URLs in RFC 4122, alphabet of RFC 4648 base32.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Elements whose content is no text (in this form for the SQL), elements that break lines.
_ELEMENTS = ("script", "style", "noscript", "template", "head")
_DROPPED = "(?is)<(?:!--.*?-->|script[ >].*?</script *>|style[ >].*?</style *>|noscript[ >].*?</noscript *>|template[ >].*?</template *>|head[ >].*?</head *>|!doctype[^>]*>)"
_BREAKS = "(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[ /][^>]*)?>"
_TAGS = "</?[A-Za-z][^>]*>"
# Fixed values of HTML5: runs of other text and references, names that need no semicolon, what 0x80 to 0x9F stand for (0 where for themselves).
_PIECES = "[^&]+|&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|&"
_BARE = "^&(" + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True)) + ")"
_C1 = (0x20AC, 0, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021, 0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, 0, 0x017D, 0, 0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, 0, 0x017E, 0x0178)
_OPENING = re.compile(f"<(?:(!--)|({'|'.join(_ELEMENTS)})[ >]|(!doctype))", re.I | re.A)
_CLOSING = {k: re.compile(f"</{k} *>", re.I | re.A) for k in _ELEMENTS} | {"!--": re.compile("-->"), "!doctype": re.compile(">")}
_PY_BREAKS, _PY_TAGS = re.compile(_BREAKS.replace("(?i)", ""), re.I | re.A), re.compile(_TAGS)
NAME_SLOTS = 1024  # the names are spread over so many small maps, as a map is searched from its start


def _named() -> str:
    """All names of HTML5 with their characters, as a JSON array of maps by CRC-32 of the name."""
    slots: list[dict[str, str]] = [{} for _ in range(NAME_SLOTS)]
    for name, chars in html5.items():
        slots[zlib.crc32(name.encode()) % NAME_SLOTS][name] = chars.replace("\xa0", " ")
    return json.dumps(slots)


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference; null, surrogates and what lies beyond Unicode are U+FFFD."""
    is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
    digits = F.regexp_replace(ref, "^&#[xX]?0*|;$", "")
    first = F.concat(F.lit("0"), F.substring(digits, 1, 8))  # eight digits are beyond Unicode in either base
    code = F.when(is_hex, F.conv(first, 16, 10)).otherwise(F.conv(first, 10, 10)).cast("bigint")
    c1 = F.try_element_at(F.array(*[F.lit(c) for c in _C1]), (F.least(F.greatest(code, F.lit(0x80)), F.lit(0x9F)) - 0x7F).cast("int"))
    code = F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), 0xFFFD).when(code.between(0x80, 0x9F) & (c1 > 0), c1).when(code == 0xA0, 0x20).otherwise(code)
    # The byte order mark first, or U+FEFF itself would be taken for one.
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")


def decoded(text: Column) -> Column:
    """Character references decoded once, as HTML5 has it in text; those to a no-break space are blanks.

    Named ones are all of HTML5's, the old names without a semicolon too, where the longest counts;
    numeric ones are decimal or hexadecimal. Names that HTML5 does not have and single ampersands stay.
    """
    table = F.from_json(F.lit(_named()), "array<map<string,string>>")
    of = lambda name: F.try_element_at(F.element_at(table, (F.crc32(name) % NAME_SLOTS + 1).cast("int")), name)

    def one(piece):
        bare = F.regexp_extract(piece, _BARE, 1)
        old = F.when(bare != "", F.concat(of(bare), F.substr(piece, F.length(bare) + 2)))
        return F.when(~piece.startswith("&"), piece).when(piece.startswith("&#"), _numbered(piece)).otherwise(F.coalesce(of(F.substr(piece, F.lit(2))), old, piece))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), one), "")


def without_markup(html: str) -> str:
    """Dropped elements as blanks, block ends as line breaks, other tags gone. The time is linear, whatever is never closed:
    where one search for an element's end fails, no later one is made, and behind the last > there are no tags."""
    out, at, endless = [], 0, set()
    for m in _OPENING.finditer(html):
        kind = m[m.lastindex].lower()
        if m.start() < at or kind in endless:
            continue
        if end := _CLOSING[kind].search(html, m.end()):
            out += (html[at : m.start()], " ")
            at = end.end()
        else:
            endless.add(kind)
    text = "".join((*out, html[at:]))
    for pattern, to in ((_PY_BREAKS, "\n"), (_PY_TAGS, "")):
        last = text.rfind(">") + 1
        text = pattern.sub(to, text[:last]) + text[last:]
    return text


@F.pandas_udf(StringType())
def _without_markup(html: pd.Series) -> pd.Series:
    return html.map(without_markup, na_action="ignore")


def html_text(html: Column) -> Column:
    """Readable text: dropped elements gone, block ends as line breaks, character references decoded, blanks squeezed."""
    t = decoded(_without_markup(html))
    t = F.regexp_replace(t, "[\\t\\r\\x0B\\f][ \\t\\r\\x0B\\f]*| [ \\t\\r\\x0B\\f]+", " ")  # single blanks are not touched
    t = F.regexp_replace(t, " ?\\n[ \\n]*", "\n")
    return F.btrim(t, F.lit(" \n"))


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1: each 10 digits are 40 bits, so 8 digits of base 32, spelt in its alphabet."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, i * 10 + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha1:"), base32(F.sha1(F.encode(block, "UTF-8"))))


def record_id(name: Column) -> Column:
    """<urn:uuid:...> of version 5 in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _fields(*pairs) -> Column:
    """`Name: value` lines; a pair whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in pairs])


# Header fields that each record states by itself.
OWN_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type", "Content-Length")


def derive(df: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", http_headers: str | None = None, date: str | None = None, source_id: str | None = None, source_digest: str | None = None, warc_headers: str | None = None, source_type: str = "text/html; charset=utf-8", default_date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Three rows for each response: response, metadata and conversion records.

    Columns: the id, record_type, record_id, refers_to (null for the response), target_uri,
    date, content_type, content_length (bytes of the block), block_digest, payload_digest
    (null for metadata), header and block; a record's bytes are header, CRLF, block, two CRLFs.
    Where df has no column of HTTP header lines, a minimal status line with the type and
    length is made. `source_id` and `source_digest` name columns of the source's record id and payload
    digest, which stand in the response and (the id) in both references to it as they are; nulls are made.
    `warc_headers` names a column of the source record's `Name: value` lines: the response keeps those that it does not
    state itself, the metadata record lists them all. A null payload or URL is empty; equal responses get equal made ids, as repeated
    captures of one date are one resource; an empty table gives no rows. No shuffle.
    """
    session_for_texts(df.sparkSession)
    optional = lambda c: df[f"`{c}`"].cast("string") if c else F.lit(None).cast("string")
    body = df.select(
        df[f"`{id_col}`"].alias("id"),
        F.coalesce(df[f"`{url}`"].cast("string"), F.lit("")).alias("uri"),
        F.coalesce(df[f"`{payload}`"].cast("string"), F.lit("")).alias("payload"),
        (F.coalesce(df[f"`{date}`"].cast("string"), F.lit(default_date)) if date else F.lit(default_date)).alias("date"),
        optional(http_headers).alias("given"),
        optional(source_id).alias("own_id"),
        optional(source_digest).alias("own_digest"),
        F.regexp_replace(F.regexp_replace(optional(warc_headers), "[\r\n]+$", ""), "\r?\n", "\r\n").alias("lines"),
    )
    made = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {source_type}{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF))
    given = F.concat(F.regexp_replace(F.regexp_replace("given", "[\r\n]+$", ""), "\r?\n", "\r\n"), F.lit(CRLF))
    body = body.withColumn("http", F.coalesce(given, made)).withColumn("payload_digest", F.coalesce("own_digest", digest(F.col("payload"))))
    name = F.concat_ws(" ", "uri", "date", "payload_digest")
    body = body.withColumn("rid", F.coalesce("own_id", record_id(F.concat(F.lit("response "), name)))).withColumn("mid", record_id(F.concat(F.lit("metadata "), name))).withColumn("cid", record_id(F.concat(F.lit("conversion "), name)))
    body = body.withColumn("text", html_text(F.col("payload"))).withColumn("text_digest", digest(F.col("text")))
    listed = lambda lines, name: F.regexp_replace(lines, "(^|\r\n)(?=[^\r\n])", f"$1{name}: ")
    source_header = listed(F.regexp_replace("http", "^HTTP/[^\r\n]*\r\n", ""), "source-header")
    warc_header = F.coalesce(F.concat(listed(F.nullif(F.col("lines"), F.lit("")), "source-warc-header"), F.lit(CRLF)), F.lit(""))
    # Of the source's lines those whose field the response does not state.
    others = F.filter(F.split("lines", CRLF), lambda x: (x != "") & ~F.lower(F.substring_index(x, ":", 1)).isin([f.lower() for f in OWN_FIELDS]))
    kept_lines = F.array_join(F.transform(others, lambda x: F.concat(x, F.lit(CRLF))), "")
    status = F.regexp_extract("http", "^(HTTP/[^\r\n]*)", 1)
    facts = F.concat(_fields(("source-status", status), ("source-length", F.octet_length("payload").cast("string")), ("source-payload-digest", F.col("payload_digest"))), source_header, warc_header)
    null = F.lit(None).cast("string")
    kinds = [
        F.struct(F.lit("response").alias("record_type"), F.col("rid").alias("record_id"), null.alias("refers_to"), F.lit("application/http; msgtype=response").alias("content_type"), F.col("payload_digest"), kept_lines.alias("more"), F.concat("http", F.lit(CRLF), "payload").alias("block")),
        F.struct(F.lit("metadata").alias("record_type"), F.col("mid").alias("record_id"), F.col("rid").alias("refers_to"), F.lit("application/warc-fields").alias("content_type"), null.alias("payload_digest"), null.alias("more"), facts.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("cid").alias("record_id"), F.col("rid").alias("refers_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text_digest").alias("payload_digest"), null.alias("more"), F.col("text").alias("block")),
    ]
    rows = body.select("id", "uri", "date", F.explode(F.array(*kinds)).alias("r")).select("id", "uri", "date", "r.*")
    rows = rows.withColumn("content_length", F.octet_length("block").cast("bigint"))
    rows = rows.withColumn("block_digest", F.when(F.col("record_type") == "conversion", F.col("payload_digest")).otherwise(digest(F.col("block"))))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _fields(("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Payload-Digest", F.col("payload_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string"))),
        F.coalesce("more", F.lit("")),
    )
    return rows.select(F.col("id").alias(id_col), "record_type", "record_id", "refers_to", F.col("uri").alias("target_uri"), "date", "content_type", "content_length", "block_digest", "payload_digest", header.alias("header"), "block")


def record_bytes(records: DataFrame) -> Column:
    """The records as they stand in a .warc file."""
    return F.encode(F.concat("header", F.lit(CRLF), "block", F.lit(CRLF + CRLF)), "UTF-8")


def _sql_base32(h: str) -> str:
    return " || ".join(f"substr('{BASE32}', ((('0x' || substr({h}, {i * 5 + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB SQL for derive() over `pages`, all references decoded; the names come from Python's table of HTML5."""
    flags = lambda p: (p.replace("(?is)", ""), "gis") if p.startswith("(?is)") else (p.replace("(?i)", ""), "gi" if p.startswith("(?i)") else "g")
    bare = "payload"
    for pattern, to in ((_DROPPED, "' '"), (_BREAKS, "chr(10)"), (_TAGS, "''")):
        p, f = flags(pattern)
        bare = f"regexp_replace({bare}, '{p}', {to}, '{f}')"
    text = rf"regexp_replace(decoded, '[ \t\r\x0B\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g')"
    text = rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"
    names = f"unnest([{', '.join(map(_quoted, html5))}]) AS name, unnest([{', '.join(_quoted(x.replace(chr(160), ' ')) for x in html5.values())}]) AS chars"
    first = "('0' || substr(regexp_replace(piece, '^&#[xX]?0*|;$', '', 'g'), 1, 8))"
    code = f"CASE WHEN lower(substr(piece, 3, 1)) = 'x' THEN ('0x' || {first})::BIGINT ELSE {first}::BIGINT END"
    fixed = f"CASE WHEN code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN 65533 WHEN code BETWEEN 128 AND 159 AND {list(_C1)}[code - 127] > 0 THEN {list(_C1)}[code - 127] WHEN code = 160 THEN 32 ELSE code END"
    crlf = "chr(13) || chr(10)"
    return f"""
    WITH p AS (
        SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload, '1970-01-01T00:00:00Z' AS date,
            'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} AS http,
            sha1(coalesce(html, '')) AS ph
        FROM pages),
    stripped AS (SELECT *, row_number() OVER () AS nr, regexp_extract_all({bare}, '{_PIECES}') AS pieces FROM p),
    named AS (SELECT {names}),
    parts AS (SELECT nr, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM stripped),
    refs AS (SELECT piece, CASE WHEN starts_with(piece, '&#') THEN {code} END AS code, regexp_extract(piece, '{_BARE}', 1) AS old FROM (SELECT DISTINCT piece FROM parts WHERE starts_with(piece, '&'))),
    meant AS (
        SELECT piece, CASE WHEN code IS NOT NULL THEN chr(({fixed})::INT) ELSE coalesce(a.chars, b.chars || substr(piece, length(old) + 2), piece) END AS chars
        FROM refs LEFT JOIN named a ON a.name = substr(piece, 2) LEFT JOIN named b ON b.name = old),
    joined AS (SELECT nr, string_agg(coalesce(chars, piece), '' ORDER BY i) AS decoded FROM parts LEFT JOIN meant USING (piece) GROUP BY nr),
    q AS (SELECT page_id, uri, payload, date, http, ph, 'sha1:' || {_sql_base32("ph")} AS pd, {text} AS txt FROM (SELECT stripped.*, coalesce(decoded, '') AS decoded FROM stripped LEFT JOIN joined USING (nr))),
    n AS (SELECT *, uri || ' ' || date || ' ' || pd AS name, sha1(txt) AS th FROM q),
    kinds AS (
        SELECT page_id, uri, date, name, 'response' AS record_type, 'application/http; msgtype=response' AS content_type, pd AS payload_digest, http || {crlf} || payload AS block FROM n
        UNION ALL
        SELECT page_id, uri, date, name, 'metadata', 'application/warc-fields', NULL,
            'source-status: HTTP/1.1 200 OK' || {crlf} || 'source-length: ' || strlen(payload) || {crlf} || 'source-payload-digest: ' || pd || {crlf}
            || 'source-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-header: Content-Length: ' || strlen(payload) || {crlf} FROM n
        UNION ALL
        SELECT page_id, uri, date, name, 'conversion', 'text/plain; charset=utf-8', 'sha1:' || {_sql_base32("th")}, txt FROM n),
    h AS (
        SELECT *, sha1(unhex('{URL_NAMESPACE}') || encode(record_type || ' ' || name)) AS own, sha1(unhex('{URL_NAMESPACE}') || encode('response ' || name)) AS resp, sha1(block) AS bh FROM kinds),
    u AS (
        SELECT *, '<urn:uuid:' || substr(own, 1, 8) || '-' || substr(own, 9, 4) || '-5' || substr(own, 14, 3) || '-' || substr('89ab', ('0x' || substr(own, 17, 1))::INT % 4 + 1, 1) || substr(own, 18, 3) || '-' || substr(own, 21, 12) || '>' AS record_id,
            CASE WHEN record_type <> 'response' THEN '<urn:uuid:' || substr(resp, 1, 8) || '-' || substr(resp, 9, 4) || '-5' || substr(resp, 14, 3) || '-' || substr('89ab', ('0x' || substr(resp, 17, 1))::INT % 4 + 1, 1) || substr(resp, 18, 3) || '-' || substr(resp, 21, 12) || '>' END AS refers_to,
            strlen(block)::BIGINT AS content_length, 'sha1:' || {_sql_base32("bh")} AS block_digest
        FROM h)
    SELECT page_id, record_type, record_id, refers_to, uri AS target_uri, date, content_type, content_length, block_digest, payload_digest,
        'WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
        || coalesce('WARC-Refers-To: ' || refers_to || {crlf}, '') || 'WARC-Target-URI: ' || uri || {crlf} || 'WARC-Date: ' || date || {crlf}
        || 'WARC-Block-Digest: ' || block_digest || {crlf} || coalesce('WARC-Payload-Digest: ' || payload_digest || {crlf}, '')
        || 'Content-Type: ' || content_type || {crlf} || 'Content-Length: ' || content_length || {crlf} AS header,
        block
    FROM u
    """
