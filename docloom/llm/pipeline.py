"""Corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from docloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from docloom.llm.common import cut_alone_at, remove
from docloom.llm.queries import quality_model, tokenizer


def good(spark, docs, sf_dir):
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, quality_model(spark, sf_dir))


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark, docs, sf_dir):
    """Each document as often as the schedule plays it."""
    return mixing.mixed_rows(docs)


def tokens(spark, docs, sf_dir):
    """Token ids and figures of each row of the mix."""
    return bpe.encode_documents(docs, *tokenizer(), with_ids=True)


STAGES = [("quality classifier", good), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixed), ("byte-level BPE", tokens)]


def run(spark, sf_dir):
    """All stages over documents; each one's rows are written and read again by the next, and deleted when that has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs, path = cut_alone_at(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{i}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the merge replay have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
