"""Spelling variant grouping (operator 12): words one edit apart, by merging an errata trie.

The words form a trie, held as a table of its edges. From each node the edge to the child with most
words is heavy, the others are light; a word meets at most log2 of the number of words light edges. Where a word leaves
the heavy path it is merged, small to large, into what the path leads to with one edit: its light
character replaced by the heavy one, skipped, or preceded by the heavy one. What it becomes is looked up among the words. Light
subtrees of a node are merged with each other with that character skipped on both sides. Two words that are one edit
apart differ first at some node, which at least one of them leaves by a light edge (or ends at), so their
terminals coincide in one of these merges; and whatever coincides is one edit apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._spark import Scope, cut

LETTERS = "a-zÀ-ÿ"  # of a run, once A-Z are lowered
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST = 6, 5  # code points of a word; its occurrences
EVERY = 199  # one run in so many loses a character
TIMES = 5  # how much more frequent a form is than its variant


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the runs of letters in all texts, some of them misspelt by a checksum of id and run.

    Null texts have no runs; a null id counts as an empty one. Every row counts, repeated ones too. Other columns are not
    read; an empty table gives no words.
    """
    low = F.translate(docs[f"`{text}`"].cast("string"), UPPER, LOWER)
    # Shorter runs make no word, with or without a character less. A match starts where a run does, or the run is too short.
    runs = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    cut_at = (h % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), cut_at), F.col("run").substr(cut_at + 2, F.length("run")))
    words = runs.select(F.when(h % EVERY == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


def _tree(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes of words (word, i, ch), and the trie's edges (node, ch, heavy): `heavy` is the node's heavy character."""
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    at = at.select("word", "i", F.expr("left(word, i)").alias("node"), F.expr("substring(word, i + 1, 1)").alias("ch"))
    counted = at.groupBy("node", "ch").agg(F.count("*").alias("below"))
    # As many rows to a node as it has children, which the alphabet bounds.
    heavy = F.first("ch").over(Window.partitionBy("node").orderBy(F.desc("below"), "ch"))
    return at, cut(counted.select("node", "ch", heavy.alias("heavy")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of words (column `word`, distinct, none empty) that are one inserted, deleted or replaced code point apart."""
    at, tree = _tree(words)
    light = tree.where("ch <> heavy").select(F.col("node").alias("_node"), F.col("ch").alias("_ch"), "heavy")
    # A word takes part once for each light edge on its way: no more often than log2 of the number of words.
    left = cut(at.join(light, (F.col("node") == F.col("_node")) & (F.col("ch") == F.col("_ch"))).select("word", "node", F.expr("substring(word, i + 1)").alias("rest"), "heavy"))
    after = F.expr("substring(rest, 2)")
    ends = tree.where("ch = heavy").select(F.col("node").alias("_node"), "heavy")
    longer = words.join(ends, F.col("word") == F.col("_node")).select("word", F.concat("word", "heavy").alias("to"))
    edited = left.select("word", F.explode(F.array(F.concat("node", "heavy", after), F.concat("node", after), F.concat("node", "heavy", "rest"))).alias("to")).unionByName(longer)
    found = edited.join(words.select(F.col("word").alias("_word")), F.col("to") == F.col("_word")).select("word", "to")
    skipped = left.select("word", "node", after.alias("after"))
    other = skipped.select(F.col("word").alias("to"), F.col("node").alias("_node"), F.col("after").alias("_after"))
    # At most one word of a group for each letter of the alphabet.
    beside = skipped.join(other, (F.col("node") == F.col("_node")) & (F.col("after") == F.col("_after")) & (F.col("word") < F.col("to"))).select("word", "to")
    return found.unionByName(beside).select(F.least("word", "to").alias("a"), F.greatest("word", "to").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following the forms ends. Forms grow in count, so there are no rings; each round doubles the steps."""
    links = cut(forms.select("word", F.col("form").alias("to")))
    while True:
        further = links.select(F.col("word").alias("_word"), F.col("to").alias("_to"))
        links = cut(links.join(further, F.col("to") == F.col("_word"), "left").select("word", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", F.col("to").alias("root"))
        links = links.drop("moved")


def variants(counts: DataFrame) -> DataFrame:
    """One row for each word of counts (word, n): its near words, the form that it is a variant of, and where forms lead.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least
    five times the word's; else null. `root` is the last form, or the word itself. Rows of one word are added up; null and
    empty words are left out; no words give no rows. Other columns are not read.
    """
    with Scope() as scope:
        words = cut(counts.where("word <> ''").groupBy(counts["word"]).agg(F.sum("n").cast("bigint").alias("n")))
        pairs = cut(near_pairs(words.select("word")))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        other = words.select(F.col("word").alias("_other"), F.col("n").alias("m"))
        best = both.join(other, F.col("b") == F.col("_other")).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
        rows = words.join(best, F.col("word") == F.col("a"), "left")
        is_form = -F.col("best.less") >= TIMES * F.col("n")
        rows = cut(rows.select("word", "n", F.when(is_form, F.col("best.form")).alias("form"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
        roots = _roots(rows.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
        return scope.keep(rows.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


#: DuckDB SQL of the query's rows. The checksum is the reflected CRC of polynomial 0xEDB88320, byte by byte; near words share a string with one place left out.
ORACLE_SQL = rf"""
WITH RECURSIVE bits(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id::VARCHAR AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents),
long AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL),
hex AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM long),
codes AS (SELECT id, run, n, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM hex),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM codes, crc),
words AS (
    SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {FEWEST}),
holes AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.head || h.tail
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.head || h.tail),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= {TIMES} * w.n THEN b.m END AS form_n,
        CASE WHEN b.m >= {TIMES} * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form
    FROM words w LEFT JOIN best b ON b.word = w.word),
path AS (SELECT word, word AS at, 0 AS k FROM formed UNION ALL SELECT p.word, f.form, k + 1 FROM path p JOIN formed f ON f.word = p.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(p.at, p.k) AS root, f.n, f.n_near, f.form_n FROM formed f JOIN path p ON p.word = f.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""
