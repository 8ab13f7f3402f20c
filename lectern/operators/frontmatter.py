"""Frontmatter: split, YAML, defaults, required fields, lint.

The fence is found by JVM expressions; YAML needs Python and runs once per document in
Arrow batches, giving JSON. Defaults and rules work on the map of top-level keys.
"""

from __future__ import annotations

import datetime
import json
import math
import os
import subprocess
import tempfile
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern._workers import importable
from lectern.config import Frontmatter, Validation
from lectern.sources import trees

_FENCE = r"(?s)^---[ \t]*\r?\n(.*?)(?:(?<=\n)|(?<=^---\n))---[ \t]*(?:\r?\n|$)"
_MAP = "map<string,string>"


@cache
def _loader():
    """YAML's safe loader without timestamps, in C where that is there."""
    import yaml

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in base.yaml_implicit_resolvers.items()}
    return type("Loader", (base,), {"yaml_implicit_resolvers": resolvers})


def yaml_json(text: str) -> str | None:
    """JSON of a YAML mapping; None for anything else, malformed YAML included. Dates stay text, non-finite numbers are null."""
    import yaml

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set)):
            return [plain(v) for v in x]
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, (datetime.date, datetime.datetime)):
            return x.isoformat()
        if isinstance(x, int) and not isinstance(x, bool) and not -(2**63) <= x < 2**63:
            return float(x)
        return x if isinstance(x, (str, int, float, bool)) or x is None else str(x)

    try:
        value = yaml.load(text, _loader())
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    return json.dumps(plain(value), ensure_ascii=False) if isinstance(value, dict) else None


def parse(files: DataFrame) -> DataFrame:
    """files (file_path, content, ...) plus `body` and `fields`, a map from top-level key to the JSON of its value."""
    importable(files.sparkSession)
    # One search of each text; what is inside is read from the fence alone.
    fenced = files.withColumn("_fence", F.regexp_extract("content", _FENCE, 0))
    split = fenced.withColumn("_yaml", F.coalesce(F.regexp_extract("_fence", _FENCE, 1), F.lit(""))).withColumn("body", F.when(F.col("_fence") != "", F.substr("content", F.char_length("_fence") + 1)).otherwise(F.col("content"))).drop("_fence")

    @F.pandas_udf("string")
    def to_json(s):
        return s.map(lambda t: yaml_json(t) if t else None)

    variant = F.parse_json(F.coalesce(to_json("_yaml"), F.lit("{}")))
    pairs = split.withColumn("_v", variant)
    return pairs.withColumn("fields", F.expr("transform_values(CAST(_v AS map<string, variant>), (k, v) -> coalesce(to_json(v), 'null'))")).drop("_yaml", "_v")


def with_defaults(fields: Column, defaults: dict[str, str]) -> Column:
    """The map with each default whose key is absent; a present null stays."""
    if not defaults:
        return fields
    given = F.create_map(*[F.lit(x) for k, v in sorted(defaults.items()) for x in (k, json.dumps(v, ensure_ascii=False))])
    return F.map_concat(fields, F.map_filter(given, lambda k, _: ~F.map_contains_key(fields, k)))


def missing_errors(fields: Column, required) -> Column:
    """One message per absent required key, in the order of the settings; a null value passes."""
    if not required:
        return F.array().cast("array<string>")
    names = F.array(*[F.lit(x) for x in required])
    return F.transform(F.filter(names, lambda k: ~F.map_contains_key(fields, k)), lambda k: F.concat(F.lit("Missing required frontmatter field: '"), k, F.lit("'")))


def string_field(fields: Column, name: str) -> Column:
    """A field's value if it is a string, else null."""
    raw = fields[name]
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])


def lint(files: DataFrame, command, root: str = "") -> DataFrame:
    """files plus `lint_errors`: the command is run with each file's path, unless its `content` is null; no command is no check.

    Under a root that is not on a disk the command gets a copy of the file, of the same relative name, which the task makes from `content`.
    """
    if not command:
        return files.withColumn("lint_errors", F.array().cast("array<string>"))
    command = list(command)
    importable(files.sparkSession)

    columns, place = files.columns, files.columns.index("file_path")
    tree = trees.portable(root) if root else None
    on_disk = not root or isinstance(tree, trees.LocalTree)
    base = tree.root if root and on_disk else ""

    def check(path: str, shown: str) -> list[str]:
        try:
            done = subprocess.run([*command, path], capture_output=True, text=True)
        except OSError as e:
            return [f"Failed to run lint command: {e}"]
        return [] if done.returncode == 0 else [f"Lint command failed: {(done.stderr or done.stdout).strip().replace(path, shown)}"]

    def copied(path: str, content: str) -> list[str]:
        with tempfile.TemporaryDirectory() as folder:
            at = os.path.join(folder, path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8", newline="") as f:
                f.write(content)
            return check(at, f"{root.rstrip('/')}/{path}")

    def run(batches):
        for b in batches:
            paths = b.column(place).to_pylist()
            contents = b.column(columns.index("content")).to_pylist() if "content" in columns else [""] * len(paths)
            found = []
            for p, content in zip(paths, contents):
                at = f"{base}/{p}" if base else p
                found.append([] if content is None else check(at, at) if on_disk else copied(p, content))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*columns, "lint_errors"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, lint_errors array<string>")


def validate(parsed: DataFrame, rules: Frontmatter, validation: Validation | None = None, root: str = "") -> DataFrame:
    """parsed with defaults applied to `fields`, plus `errors` and `valid`. Lint runs whatever the required check found."""
    filled = parsed.withColumn("fields", with_defaults(F.col("fields"), dict(rules.defaults)))
    linted = lint(filled, validation.lint_command if validation else None, root)
    errors = F.concat(missing_errors(F.col("fields"), rules.required), F.col("lint_errors"))
    return linted.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("lint_errors")


def summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
