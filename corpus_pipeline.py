"""Corpus pipeline: documents to a deduplicated, clean, mixed and sharded training set.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
stage's rows as Parquet in the shared scratch folder and reads them again for the next.
"""

from __future__ import annotations

from lectern.llm import decontaminate, jaccard, mixing, sharding, toxicity
from lectern.llm._spark import cut


def drop_toxic(spark, docs, sf_dir):
    """Toxicity (operator 2): documents that score at the threshold or over go.

    Null and empty texts score as no evidence and stay where that is under the threshold; equal texts, repeated rows among
    them, go or stay together; rows with null ids are scored like others; an empty table gives an empty one, with all columns. No labels,
    or labels of one class only, make a constant score.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark, docs, sf_dir):
    """N-gram Jaccard join (operator 9): the first document of each group stays.

    First is the smallest id, nulls last, then the smallest hash of the text; of repeated rows one stays. Texts that are null, empty
    or without words are in no group and all stay; an empty table gives an empty one, with all columns.
    """
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Benchmark decontamination (operator 8): documents that cover half of an item or more go.

    Null and empty texts stay, and null and empty items meet nothing; repeated rows go or stay together, repeated items change
    nothing; ids are not looked at; an empty table gives an empty one, with all columns.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Mixing (operator 7): each document as often as the mix holds it.

    A null source is a source, the last in order. Null and empty texts have no words, so no word of theirs is drawn, but they are drawn
    as documents by their source's rate. Repeated rows are documents of their own; equal ones are interchangeable. Null ids
    are ids; an empty table gives an empty one, with all columns.
    """
    return mixing.mixed_rows(docs)


def place_in_shards(spark, docs, sf_dir):
    """Sharding (operator 3): the shard of every row, by its id; null ids as the empty string, equal ids together.

    A column named `shard` is replaced; an empty table gives an empty one.
    """
    return sharding.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Training a classifier and the cube method's draws have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
