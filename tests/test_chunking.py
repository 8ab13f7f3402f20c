import random
import re
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import Chunking
from lectern.operators import chunking


def secs(spark, body):
    row = spark.createDataFrame([(body,)], "body string").select(chunking.sections(F.col("body")).alias("s")).first()
    return [(x["text"], x["line_start"], x["line_end"]) for x in row["s"]]


def chunks(spark, body, most, target, description=None, prepend=True):
    df = spark.createDataFrame([(body, description)], "body string, description string")
    return [tuple(c) for c in chunking.chunk(df, Chunking(most, target, prepend)).first()["chunks"]]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("# A\n\nContent A\n\n## B\n\nContent B", [("# A\n\nContent A\n", 1, 4), ("## B\n\nContent B", 5, 7)]),
        ("\n\n# A\ntext\n", [("# A\ntext", 1, 4)]),
        ("", []),
        ("  \n\t\n", []),
        ("intro\n#no space\n# x", [("intro", 1, 1), ("#no space", 2, 2), ("# x", 3, 3)]),
        ("a\r\n# b\r\nc", [("a", 1, 1), ("# b\nc", 2, 3)]),
        ("```\n# comment\n```", [("```", 1, 1), ("# comment\n```", 2, 3)]),
        ("  \n# A", [("  \n# A", 1, 2)]),
    ],
)
def test_sections(spark, body, expected):
    assert secs(spark, body) == expected


def restated(body):
    """The section rule line by line."""
    text = body.replace("\r\n", "\n")
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    out, cur, start = [], "", 1
    for n, line in enumerate(lines, 1):
        if line.startswith("#") and cur.strip():
            out.append((cur, start, n - 1))
            cur, start = line, n
        else:
            cur = f"{cur}\n{line}" if cur else line
    if cur.strip():
        out.append((cur, start, len(lines)))
    return out


def test_sections_of_random_documents(spark):
    rng = random.Random(5)
    bodies = ["\n".join(rng.choice(["# h", "## k", "", "text é", "  ", "#x", "more"]) for _ in range(rng.randrange(12))) + rng.choice(["", "\n"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", "body", chunking.sections(F.col("body")).alias("s"))
    for r in df.collect():
        assert [(x["text"], x["line_start"], x["line_end"]) for x in r["s"]] == restated(r["body"]), repr(r["body"])


def test_native_packing_equals_the_python_form(spark):
    rng = random.Random(6)
    bodies = ["\n".join(f"# {i}\n" + "é" * rng.randrange(60) for i in range(rng.randrange(8))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r["i"]: [(c["text"], c["line_start"], c["line_end"]) for c in r["chunks"]] for r in chunking.chunk(df, Chunking(10**6, 100), description=None).collect()}
    for i, b in enumerate(bodies):
        assert got[i] == chunking.chunk_sections(restated(b), 10**6, 100)


def test_description_and_indexes(spark):
    got = chunks(spark, "# A\nx\n# B\ny", 1500, 5, "About")
    assert [c[0] for c in got] == [0, 1] and got[0][1] == "About\n\n# A\nx"
    assert chunks(spark, "# A", 1500, 5, "About", prepend=False)[0][1] == "# A"


def test_target_is_inclusive_and_counts_bytes(spark):
    body = "# é\n# b"  # 4 bytes + 2 + 3 bytes
    assert len(chunks(spark, body, 100, 9)) == 1 and len(chunks(spark, body, 100, 8)) == 2


def test_force_split_bounds_and_keeps_text(spark):
    text = "# Big\n\n" + "\n\n".join(f"Paragraph {i}. " + "word " * 40 for i in range(30))
    got = chunks(spark, text, 500, 400)
    assert len(got) > 1 and all(len(c[1].encode()) <= 700 for c in got) and all((c[2], c[3]) == (1, 61) for c in got)
    assert "".join("".join(c[1] for c in got).split()) == "".join(text.split())


ATOMS = ["word ", "é", "e\u0301", "👩\u200d👩\u200d👧", "🇩🇪", "한", "\r\n", "\n", "\n\n", "A sentence ends here. ", "[a link](https://x.org/y) ", "`some code` ", "**two words** ", "![", "](", "* ", "<a@b.c> ", "x" * 30, "# h\n", "`", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=60), st.integers(8, 60))
def test_no_part_begins_inside_a_cluster_or_an_inline_element(atoms, most):
    """Checked on the parts alone: where they stand in the text, what they leave out, and what stands across each cut."""
    text = "".join(atoms).strip()
    parts, at, cuts = chunking.force_split(text, most), 0, []
    for p in parts:
        k = text.index(p, at)
        assert not text[at:k].strip() and 0 < len(p) <= most
        cuts.append((at, k))
        at = k + len(p)
    assert not text[at:].strip()
    clusters, held = [0], 0
    for c in regex.findall(r"\X", text):
        held += len(c)
        clusters.append(held)
    elements = [(m.start(), m.end()) for m in re.finditer(r"\[a link\]\(https://x.org/y\)|`some code`|\*\*two words\*\*|<a@b\.c>", text)]
    code = text.count("`") == 2 * text.count("`some code`") and "![" not in text and "](" not in text.replace("[a link](", "") and "* " not in text.replace("** ", "")
    for a, b in cuts[1:]:
        # A cluster that fits is whole; only one longer than a part may be cut.
        inside = [x for x in zip(clusters, clusters[1:]) if x[0] < a < x[1] and x[0] < b < x[1]]
        assert all(y - x > most for x, y in inside), (a, b)
        if code:
            assert not [e for e in elements if e[0] < a <= b < e[1] and e[1] - e[0] <= most], (a, b)


def by_the_rules(parts, before, most):
    """The documented merge of a split section's parts into the chunks before, one rule after the other."""
    size = lambda t: len(t.strip().encode())
    chunks, pending = list(before), None
    for p in parts:
        if pending is None and size(p) < 200:
            pending = p
        elif pending is None:
            chunks.append(p)
        elif size(pending + "\n\n" + p) < 200:
            pending += "\n\n" + p
        else:
            chunks.append(pending + "\n\n" + p)
            pending = None
    if pending is not None:
        if chunks and size(chunks[-1]) + 2 + size(pending) <= most:
            chunks[-1] += "\n\n" + pending
        else:
            chunks.append(pending)
    return chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=12), st.integers(0, 490))
def test_parts_are_merged_by_the_rules(sizes, before):
    text = "\n\n".join("x" * n for n in sizes)
    most = 501
    first = "# " + "y" * before
    got = [t for t, _, _ in chunking.chunk_sections([(first, 1, 1), (text, 2, 9)], most, 1)]
    want = by_the_rules(chunking.force_split(text, most), [first], most) if len(text) > most else [first, text]
    assert got == want


@pytest.mark.parametrize("junk", ["[", "`", "*a", "<", "![](", "_", "[x](", "é"])
def test_broken_inline_elements_take_linear_time(junk):
    began = time.monotonic()
    assert "".join(chunking.force_split(junk * 100_000, 1000)) == junk * 100_000
    assert time.monotonic() - began < 10


@pytest.mark.parametrize("text", ["x" * 1000, "é" * 700, "a b " * 300, "```\n" + "code\n" * 200 + "```"])
def test_force_split_parts(text):
    parts = chunking.force_split(text, 100)
    assert all(0 < len(p) <= 100 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())


def test_small_tail_joins_the_chunk_before():
    got = chunking.chunk_sections([("# A " + "a" * 300, 1, 1), ("# B\n\n" + ("b" * 390 + "\n\n") * 2 + "tail", 2, 6)], 400, 400)
    assert got[-1][0].endswith("tail") and len(got) == 3


def test_very_many_sections(spark):
    body = "\n".join(f"# {i}\ntext" for i in range(20_000))
    assert secs(spark, body) == restated(body)
    got = [c[1:] for c in chunks(spark, body, 1500, 100)]
    assert got == chunking.chunk_sections(restated(body), 1500, 100)


def test_the_split_query_equals_plain_code(spark):
    from lectern.plans import catalog, corpus
    from tests.oracle import SF

    got = {}
    for r in catalog.QUERIES["split_chunks"](spark, SF).collect():
        got.setdefault(r["file_path"], {})[r["chunk_index"]] = (r["text"], r["line_start"], r["line_end"])
    config, over = Chunking(), 0
    for r in corpus.corpus(spark, SF).collect():
        prefix = f"{r['description']}\n\n" if r["description"] else ""
        whole = restated(r["body"])
        over += any(len(t.strip().encode()) > config.max_chunk_size for t, _, _ in whole)
        want = [(prefix + t, a, b) for t, a, b in chunking.chunk_sections(whole, config.max_chunk_size, config.target)]
        assert [got.get(r["file_path"], {})[i] for i in range(len(want))] == want and len(got.get(r["file_path"], {})) == len(want)
    assert over
