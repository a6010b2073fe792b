"""The corpus pipeline: stages over ``documents``, each written before the next."""

from __future__ import annotations

from stratalog.llm import packing, pii, simhash, toxicity
from stratalog.llm.common import discard, materialize, read
from stratalog.llm.queries import CATEGORIES, low_quality_and_toxic, tokenizer_path


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain finds toxic go."""
    chain = toxicity.fit(docs, low_quality_and_toxic(read(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.score(docs, chain).filter("p_toxic < 0.5").select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays: SimHash of five-word
    shingles, candidates by ball hashing, similarity 0.8 verified."""
    return simhash.keep_one(docs, width=5, similarity=0.8)


def replace_personal_data(spark, docs, sf_dir):
    """Personal data becomes surrogates; n_chars follows the new text."""
    from pyspark.sql import functions as F

    out = pii.replace(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark, docs, sf_dir):
    """Documents become sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), end=2, limit=1024)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("personal_data", replace_personal_data), ("packing", pack_sequences)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # the first are the input's own files, which stay
    return STAGES[-1][1](spark, docs, sf_dir)
