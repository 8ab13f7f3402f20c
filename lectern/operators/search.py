"""Filters, exact top-k search, batch search, rendering, facets and instructions.

Filters act on promoted columns by the type of the value; those of scalars reach the Parquet scan. Scoring is a JVM
expression; top-k is Spark's TakeOrderedAndProject. Batches of queries are matrix products (`blocks`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.functions.text import SNIPPET, json_string, json_strings, snippet
from lectern.operators import blocks
from lectern.operators.embedding import Embedder, embed_query

# Fixed limits of a request, sizes in bytes.
DEFAULT_LIMIT, MOST_LIMIT = 10, 50
QUERY_BYTES, FIELD_BYTES, MOST_TAGS, TAG_BYTES = 4096, 256, 20, 256
FACET_LIMIT = 50
BASE_INSTRUCTIONS = "Search a knowledge base of Markdown documents by meaning, with optional metadata filters."


class RequestError(ValueError):
    pass


@dataclass(frozen=True)
class SearchRequest:
    query: str
    domain: str | None = None
    type: str | None = None
    tags: Sequence[str] | None = None
    limit: int | None = None

    def check(self) -> None:
        """Sizes in bytes, limits inclusive."""
        size = lambda s: len(s.encode())
        if size(self.query) > QUERY_BYTES:
            raise RequestError(f"query exceeds {QUERY_BYTES} bytes")
        for name in ("domain", "type"):
            if (v := getattr(self, name)) is not None and size(v) > FIELD_BYTES:
                raise RequestError(f"{name} exceeds {FIELD_BYTES} bytes")
        if self.tags is not None:
            if len(self.tags) > MOST_TAGS:
                raise RequestError(f"more than {MOST_TAGS} tags")
            if any(size(t) > TAG_BYTES for t in self.tags):
                raise RequestError(f"a tag exceeds {TAG_BYTES} bytes")

    def filters(self) -> dict[str, Any]:
        return {k: v for k, v in (("domain", self.domain), ("type", self.type), ("tags", list(self.tags) if self.tags is not None else None)) if v is not None}


def resolve_limit(requested: int | None) -> int:
    """10 by default, 50 at most; 0 stays 0."""
    return min(DEFAULT_LIMIT if requested is None else requested, MOST_LIMIT)


def condition(df: DataFrame, key: str, value: Any) -> Column:
    """Predicate of one filter: equality for strings, integers and booleans, any-of for lists of strings.

    A list-valued field matches by any element, and only values of the filter's own type match. Fields are columns of their
    own, or the promoted columns of stored points; a field that is on no point matches nothing. Floats,
    integers over 64 bits, nulls, objects and mixed lists are errors.
    """
    many = isinstance(value, (list, tuple))
    if many and not all(isinstance(v, str) for v in value):
        raise RequestError(f"filter {key}: a list must hold strings only")
    if not many and not (isinstance(value, (bool, str)) or isinstance(value, int) and -(2**63) <= value < 2**63):
        raise RequestError(f"filter {key}: values of type {type(value).__name__} cannot be matched")
    if many and not value:
        return F.lit(False)
    kind = "s" if many or isinstance(value, str) else "b" if isinstance(value, bool) else "i"
    tests = []
    for name in (key, f"{kind}_{key}", f"{kind}list_{key}") if key not in df.columns else (key,):
        if name not in df.columns:
            continue
        column, is_list = F.col(f"`{name}`"), df.schema[name].dataType.typeName() == "array"
        if many:
            tests.append(F.arrays_overlap(column, F.array(*[F.lit(v) for v in value])) if is_list else column.isin(list(value)))
        else:
            tests.append(F.array_contains(column, F.lit(value).cast("bigint") if kind == "i" else F.lit(value)) if is_list else column == F.lit(value))
    return reduce(or_, tests) if tests else F.lit(False)


def where_all(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Rows that meet every filter; none means all rows."""
    conditions = [condition(df, k, v) for k, v in filters.items()]
    return df.where(reduce(and_, conditions)) if conditions else df


def top_k(points: DataFrame, vector: Sequence[float], k: int, filters: Mapping[str, Any] | None = None, column: str = "vector", id_col: str = "id") -> DataFrame:
    """The k points of highest cosine similarity with `score` and `rank`, ties to the smaller id."""
    scored = where_all(points, filters or {}).withColumn("score", vectors.cosine(F.col(column), vectors.literal(vector)))
    return ranked(scored, k, id_col)


def ranked(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    best = scored.orderBy(F.desc_nulls_last("score"), F.col(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), F.col(id_col))).cast("bigint"))


def top_k_batch(points: DataFrame, queries: DataFrame, k: int, column: str = "vector", id_col: str = "id") -> DataFrame:
    """For each row (query_id, qv) of queries its k nearest points: query_id, id, score, rank. Exact, in one pass over the points for each block of queries."""
    return blocks.nearest(points, queries, k, column, id_col)


def rendered(results: DataFrame) -> DataFrame:
    """results (rank, score, title, file_path, line_start, line_end, domain, type, tags, text) plus `rendered`."""
    string = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.concat(F.lit(" (lines "), F.col("line_start").cast("string"), F.lit("–"), F.col("line_end").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    optional = lambda name, c: F.when(c != "", F.concat(F.lit(f"**{name}**: "), c, F.lit("\n"))).otherwise(F.lit(""))
    shown = F.when(string("text") != "", F.concat(F.lit("\n"), snippet(string("text"), SNIPPET), F.lit("\n"))).otherwise(F.lit(""))
    body = F.concat(
        F.lit("## Result "), F.col("rank").cast("string"), F.lit("\n**Title**: "), F.coalesce(F.col("title"), F.lit("(untitled)")), F.lit("\n**Score**: "), F.format_string("%.4f", F.col("score")),
        F.lit("\n**File**: "), string("file_path"), lines, F.lit("\n"), optional("Domain", string("domain")), optional("Type", string("type")), optional("Tags", F.coalesce(F.array_join("tags", ", "), F.lit(""))), shown, F.lit("\n"),
    )
    return results.withColumn("rendered", body)


def result_text(results: DataFrame) -> str:
    """All results as one text; at most MOST_LIMIT rows reach the driver."""
    rows = rendered(results).orderBy("rank").select("rendered").collect()
    return "".join(r[0] for r in rows).strip() or "No results found."


def find(collection, embedder: Embedder, request: SearchRequest) -> str:
    """The text that answers a request on a store; title, domain, type and tags are shown where they are strings."""
    request.check()
    best = collection.nearest(embed_query(embedder, request.query), resolve_limit(request.limit), request.filters())
    text = lambda k: json_string(F.col("payload"), f"$.{k}")
    return result_text(best.withColumns({"title": text("title"), "domain": text("domain"), "type": text("type"), "tags": json_strings(F.col("payload"), "$.tags")}))


def facet(points: DataFrame, field: str, limit: int = FACET_LIMIT) -> DataFrame:
    """Distinct string values of a field by count, lists by element, a point counting once for each: value, count.

    Values of other types are not listed. The field is a column, or the promoted columns of stored points.
    """
    own = [field] if field in points.columns else [c for c in (f"s_{field}", f"slist_{field}") if c in points.columns]
    kinds = {c: points.schema[c].dataType.simpleString() for c in own}
    one, many = ([F.col(f"`{c}`") for c in own if kinds[c] == k] for k in ("string", "array<string>"))
    if many:
        listed = [F.coalesce(c, F.array().cast("array<string>")) for c in many] + [F.array(c) for c in one]
        values = points.select(F.explode(F.array_distinct(F.concat(*listed))).alias("value"))
    elif one:
        values = points.select(one[0].alias("value"))
    else:
        values = points.select(F.lit(None).cast("string").alias("value")).limit(0)
    return values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def instructions_text(facet_of: Callable[[str, int], DataFrame], fields: Sequence[str], base: str = BASE_INSTRUCTIONS) -> str:
    """The text of `instructions` from facets that a store maintains; no more than FACET_LIMIT values of a field reach the driver."""
    values = {f: [r["value"] for r in facet_of(f, FACET_LIMIT).collect()] for f in fields if f != "file_path"}
    return base + "".join(f"\nAvailable {f}: {', '.join(v)}" for f, v in values.items() if v)


def instructions(points: DataFrame, fields: Sequence[str], base: str = BASE_INSTRUCTIONS) -> DataFrame:
    """One row `text`: the base and, for each field but file_path that has values, a line of them."""
    lines = None
    for i, f in enumerate(x for x in fields if x != "file_path"):
        own = facet(points, f).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("count"), "value")))
        line = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), ", ").alias("v")).select(F.lit(i).alias("i"), F.when(F.col("v") != "", F.concat(F.lit(f"\nAvailable {f}: "), F.col("v"))).otherwise(F.lit("")).alias("line"))
        lines = line if lines is None else lines.unionByName(line)
    if lines is None:
        return points.sparkSession.createDataFrame([(base,)], "text string")
    return lines.agg(F.concat(F.lit(base), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "")).alias("text"))


