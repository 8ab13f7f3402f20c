"""Section split and greedy packing of Markdown bodies.

Both are folds over arrays inside a row, so a document never leaves its partition. A
section is what lies between heading lines; sections are packed up to the target, sizes being
UTF-8 bytes of the trimmed text. Only documents with a section over the maximum go to Python,
for the force split, and those of very many sections, whose packing takes one pass there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern._workers import importable
from lectern.config import Chunking
from lectern.functions.text import byte_length

# Fixed value: the characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MANY_SECTIONS = 1000  # from here on the native fold, which copies the list of chunks it has, is slower than one pass in Python
LEAST_FRAGMENT = 200  # bytes; smaller parts of a split section join their successor
SECTION = "array<struct<text:string,line_start:bigint,line_end:bigint>>"
CHUNK = "array<struct<chunk_index:bigint,text:string,line_start:bigint,line_end:bigint>>"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sections(body: Column) -> Column:
    """Array of (text, line_start, line_end), lines from 1.

    A line that starts with # opens a section unless only blank lines stand before it. Every step is one pass over the lines.
    """
    text = F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), "\n\\z", "")

    def split(lines, heads):
        n = F.size(lines)
        before = F.coalesce(F.try_element_at(heads, F.lit(1)) - 1, n)  # lines before the first heading
        blank = ~F.exists(F.slice(lines, F.lit(1), before), lambda x: x.rlike(r"(?U)\S"))
        starts = F.concat(F.array(F.lit(1)), F.when(blank, F.slice(heads, F.lit(2), n)).otherwise(heads))
        ends = F.concat(F.transform(F.slice(starts, F.lit(2), n), lambda x: x - 1), F.array(n))

        def one(a, b):
            own = F.array_join(F.slice(lines, a, b - a + 1), "\n")
            return F.struct(F.regexp_replace(own, "^\n+", "").alias("text"), a.cast("bigint").alias("line_start"), b.cast("bigint").alias("line_end"))

        cut = let(F.struct(starts.alias("s"), ends.alias("e")), lambda x: F.zip_with(x["s"], x["e"], one))
        return F.when(blank & (F.size(heads) == 0), F.array().cast(SECTION)).otherwise(cut)

    def of_lines(lines):
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("#"), i + 1)), lambda x: x.isNotNull())
        return let(heads, lambda h: split(lines, h))

    return let(F.split(text, "\n"), of_lines)


def measured(secs: Column) -> Column:
    """Sections with `size`, bytes of the trimmed text, and `lead` and `trail`, bytes of the white space around it."""

    def measure(s):
        left = F.ltrim(s["text"], F.lit(WHITE_SPACE))
        both = F.rtrim(left, F.lit(WHITE_SPACE))
        a, b, c = byte_length(s["text"]), byte_length(left), byte_length(both)
        return F.struct(s["text"].alias("text"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), c.alias("size"), (a - b).alias("lead"), (b - c).alias("trail"))

    return F.transform(secs, measure)


def packed(secs: Column, target: int) -> Column:
    """Chunks of measured sections none of which is over the maximum: a section joins the last chunk if both fit in the target.

    The fold is over sizes; texts are joined once, when the chunks' first sections are known.
    """
    # The sections ride along in the accumulator: an outer column would be evaluated anew for each chunk.
    zero = F.struct(secs.alias("secs"), F.lit(0).alias("i"), F.lit(0).alias("size"), F.lit(0).alias("trail"), F.array().cast("array<int>").alias("starts"))

    def step(acc, s):
        fits = (acc["i"] > 0) & (acc["size"] + 2 + s["size"] <= target)
        size = F.when(fits, acc["size"] + acc["trail"] + 2 + s["lead"] + s["size"]).otherwise(s["size"])
        starts = F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"] + 1)))
        return F.struct(acc["secs"].alias("secs"), (acc["i"] + 1).alias("i"), size.alias("size"), s["trail"].alias("trail"), starts.alias("starts"))

    def build(acc):
        ends = F.concat(F.slice(acc["starts"], 2, F.greatest(F.size(acc["starts"]), F.lit(1))), F.array(acc["i"] + 1))

        def chunk_of(start, end):
            own = F.slice(acc["secs"], start, end - start)
            return F.struct(F.array_join(F.transform(own, lambda s: s["text"]), "\n\n").alias("text"), F.element_at(acc["secs"], start)["line_start"].alias("line_start"), F.element_at(acc["secs"], end - 1)["line_end"].alias("line_end"))

        return F.when(acc["i"] > 0, F.zip_with(acc["starts"], ends, chunk_of)).otherwise(F.array().cast(SECTION))

    return F.aggregate(secs, zero, step, build)


def numbered(chunks: Column, description: Column | None = None) -> Column:
    """Chunks with indexes from 0, the description before each text."""
    prefix = F.lit("") if description is None else F.coalesce(F.concat(description, F.lit("\n\n")), F.lit(""))
    return F.transform(chunks, lambda c, i: F.struct(i.cast("bigint").alias("chunk_index"), F.concat(prefix, c["text"]).alias("text"), c["line_start"].alias("line_start"), c["line_end"].alias("line_end")))


# -- force split ---------------------------------------------------------------------------------

_CLUSTER = regex.compile(r"\X")
_HEADING = re.compile(r"(?m)^(?=#{1,6}\s)")
_FENCED = re.compile(r"(?ms)^(```|~~~).*?^\1[^\n]*$")
# Images, links, code, strong and stressed text, automatic links. No pattern looks past a line or past another opening, so all are linear.
_INLINE = re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*(?: +\"[^\"\n]*\")? *\)|`[^`\n]+`|\*\*[^*\n]+\*\*|__[^_\n]+__|\*[^*\s][^*\n]*\*|<[^<>\s]+>")
_LEVELS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))


def _size(text: str) -> int:
    return len(text.strip(WHITE_SPACE).encode())


def force_split(text: str, most: int) -> list[str]:
    """Parts of at most `most` characters, in order; nothing but white space between parts is lost.

    Cuts fall at the coarsest level that helps: headings, blank lines (not inside fences that fit), inline elements,
    lines, sentences, words (none inside an inline element that fits), extended grapheme clusters, and characters where a cluster does
    not fit. Neighbours are joined while they fit.
    """
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    return [t.strip() for t in _join(text, _cut(text, 0, len(text), most, 0), most) if t.strip()]


def _outside(places: Iterable[int], spans: list[tuple[int, int]]) -> list[int]:
    """Places that are in none of the spans, both in order."""
    kept, k = [], 0
    for p in places:
        while k < len(spans) and spans[k][1] <= p:
            k += 1
        if k == len(spans) or p <= spans[k][0]:
            kept.append(p)
    return kept


def _clusters(text: str, a: int, b: int, most: int) -> list[int]:
    """Places to cut at: parts are filled with whole grapheme clusters, and a cluster of more than `most` characters is cut where it must be."""
    places, at, end = [], a, a  # the part begins at `at` and is full up to `end`
    for m in _CLUSTER.finditer(text, a, b):
        if m.end() - at > most:
            if end > at:
                places.append(end)
                at = end
            while m.end() - at > most:
                at += most
                places.append(at)
        end = m.end()
    return places


def _cut(text: str, a: int, b: int, most: int, level: int) -> list[tuple[int, int]]:
    if len(text[a:b].strip()) <= most:
        return [(a, b)]
    within = lambda spans: [(x, y) for x, y in spans if y - x <= most]
    if level == 0:
        places = [m.start() for m in _HEADING.finditer(text, a, b) if m.start() > a]
    elif level == 1:
        fences = within(m.span() for m in _FENCED.finditer(text, a, b))
        found = (m.end() for m in _LEVELS[0].finditer(text, a, b) if a < m.end() < b)
        places = sorted({*_outside(found, fences), *(x for f in fences for x in f if a < x < b)})
    else:
        inline = within(m.span() for m in _INLINE.finditer(text, a, b))
        if level == 2:
            places = sorted({x for s in inline for x in s if a < x < b})
        elif level <= len(_LEVELS) + 1:
            places = _outside((m.end() for m in _LEVELS[level - 2].finditer(text, a, b) if a < m.end() < b), inline)
        else:
            places = _clusters(text, a, b, most)
    edges = [a, *places, b]
    if len(edges) == 2:
        return _cut(text, a, b, most, level + 1)
    return [p for x, y in zip(edges, edges[1:]) for p in _cut(text, x, y, most, level + 1)]


def _join(text: str, parts: list[tuple[int, int]], most: int) -> list[str]:
    out = [parts[0]]
    for a, b in parts[1:]:
        if len(text[out[-1][0] : b].strip()) <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [text[a:b] for a, b in out]


def chunk_sections(secs: list[tuple[str, int, int]], most: int, target: int) -> list[tuple[str, int, int]]:
    """Packing of sections some of which may be over the maximum."""
    out: list[tuple[str, int, int]] = []
    open_: tuple[str, int, int] | None = None
    for text, start, end in secs:
        if _size(text) > most:
            if open_:
                out.append(open_)
                open_ = None
            held = ""
            for part in force_split(text, most):
                held = f"{held}\n\n{part}" if held else part
                if _size(held) >= LEAST_FRAGMENT:
                    out.append((held, start, end))
                    held = ""
            if held:  # the tail joins the last chunk if that stays within the maximum
                if out and _size(out[-1][0]) + 2 + _size(held) <= most:
                    out[-1] = (f"{out[-1][0]}\n\n{held}", out[-1][1], end)
                else:
                    out.append((held, start, end))
        elif open_ and _size(open_[0]) + 2 + _size(text) <= target:
            open_ = (f"{open_[0]}\n\n{text}", open_[1], end)
        else:
            if open_:
                out.append(open_)
            open_ = (text, start, end)
    if open_:
        out.append(open_)
    return out


def chunk(docs: DataFrame, config: Chunking | None = None, body: str = "body", description: str | None = "description") -> DataFrame:
    """docs plus `chunks`, an array of (chunk_index, text, line_start, line_end)."""
    config = config or Chunking()
    importable(docs.sparkSession)
    most, target = config.max_chunk_size, config.target
    prefix = F.col(description) if description and config.prepend_description else None

    def work(secs):
        over = F.exists(secs, lambda s: s["size"] > most) | (F.size(secs) > MANY_SECTIONS)
        return F.struct(F.when(~over, packed(secs, target)).alias("plain"), F.when(over, secs).alias("over"))

    @F.pandas_udf(SECTION)
    def split(column):
        import pandas as pd

        return pd.Series([None if row is None else [{"text": t, "line_start": a, "line_end": b} for t, a, b in chunk_sections([(s["text"], s["line_start"], s["line_end"]) for s in row], most, target)] for row in column])

    done = docs.withColumn("_work", let(measured(sections(F.coalesce(F.col(body), F.lit("")))), work))
    chunks = F.coalesce(F.col("_work.plain"), split.asNondeterministic()(F.col("_work.over")))  # so that it is not folded into later expressions
    return done.withColumn("_chunks", chunks).withColumn("chunks", numbered(F.col("_chunks"), prefix)).drop("_work", "_chunks")


def chunk_rows(chunked: DataFrame) -> DataFrame:
    """One row per chunk."""
    return chunked.select(*[c for c in chunked.columns if c != "chunks"], F.explode("chunks").alias("_c")).select("*", "_c.*").drop("_c")
